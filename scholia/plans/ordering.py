"""Sorts, limits, top-k, digests (F) and set operations (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordinals, ranking
from ..operators.digests import ordered_digest
from .registry import Tables, query
from .windows import _RANKED, supplier_ranking


@query("SELECT l_suppkey, l_orderkey, l_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS rank FROM lineitem) WHERE rank <= 10")
def f1_top_k(spark, sf):
    return ranking.ranked(Tables(spark, sf).lineitem, "l_suppkey", "l_orderkey", "l_extendedprice", 10).select("l_suppkey", "l_orderkey", "l_partkey", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber DESC, rank) AS position FROM ({_RANKED}) WHERE rank <= 50")
def f2_stable_resort(spark, sf):
    head = supplier_ranking(Tables(spark, sf).lineitem).where("rank <= 50")
    return head.select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_linenumber"), "rank")).cast("long").alias("position"))


@query(f"SELECT r.l_suppkey, r.rank, r.l_partkey, p_name FROM ({_RANKED}) r JOIN part ON r.l_partkey = p_partkey AND p_size > 5 WHERE rank > 10 AND rank <= 30")
def f3_page_with_gaps(spark, sf):
    t = Tables(spark, sf)
    return ranking.page(supplier_ranking(t.lineitem), "rank", 10, 20).join(t.part.where("p_size > 5"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "rank", "l_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice < 300000 OR (o_totalprice = 300000 AND o_orderkey > 100)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def f4_keyset_page(spark, sf):
    after = (F.col("o_totalprice") < 300000) | ((F.col("o_totalprice") == 300000) & (F.col("o_orderkey") > 100))
    return Tables(spark, sf).orders.where(after).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query(f"SELECT l_suppkey, count(*) FILTER (WHERE rank <= 100) AS candidates, count(*) FILTER (WHERE rank <= 50) AS head, count(*) FILTER (WHERE rank <= 200) AS cached FROM ({_RANKED}) GROUP BY 1")
def f5_branch_cuts(spark, sf):
    r = F.col("rank")
    return supplier_ranking(Tables(spark, sf).lineitem).where("rank <= 200").groupBy("l_suppkey").agg(F.count_if(r <= 100).alias("candidates"), F.count_if(r <= 50).alias("head"), F.count("*").alias("cached"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 25")
def f6_sample_limit(spark, sf):
    return Tables(spark, sf).customer.orderBy(F.col("c_custkey").cast("string")).limit(25).select("c_custkey", "c_name")


@query("""SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-30' THEN 'today' WHEN ts >= TIMESTAMP '2024-01-23' THEN 'previous 7 days' ELSE 'older' END AS bucket FROM events""")
def f7_list_buckets(spark, sf):
    ts = F.col("ts").cast("timestamp")
    today = F.lit("2024-01-30").cast("timestamp")
    return Tables(spark, sf).events.select("event_id", F.when(ts >= today, "today").when(ts >= today - F.expr("interval 7 days"), "previous 7 days").otherwise("older").alias("bucket"))


@query("SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS transcript FROM conversations GROUP BY 1")
def f8_ordered_rows(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("x"))))
    return Tables(spark, sf).conversations.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").cast("binary")).alias("transcript"))


@query("SELECT 'conversations' AS name, count(*) AS rows, sha256(string_agg(k || chr(9) || sha256(text) || chr(10), '' ORDER BY k)) AS digest FROM (SELECT conv_id * 1000 + turn AS k, text FROM conversations)")
def f9_ordered_digest(spark, sf):
    own = Tables(spark, sf).conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return ordered_digest(own, "k", "text", "conversations")


@query("""WITH a AS (SELECT l_suppkey, l_orderkey AS d, l_extendedprice AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS r FROM lineitem), b AS (SELECT l_suppkey, l_orderkey AS d, l_extendedprice AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC) AS r FROM lineitem)
SELECT a.l_suppkey, count(*) FILTER (WHERE a.d <> b.d) AS moved, count(*) FILTER (WHERE abs(a.s - b.s) > 1e-5) AS violations FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.r = b.r GROUP BY 1""")
def f10_same_ranking(spark, sf):
    own = Tables(spark, sf).lineitem.select("l_suppkey", F.col("l_orderkey").alias("d"), F.col("l_extendedprice").alias("s"))
    rank = lambda order, p: own.select("l_suppkey", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("s"), order)).alias("r"), F.col("d").alias(f"d{p}"), F.col("s").alias(f"s{p}"))
    both = rank(F.asc("d"), 1).join(rank(F.desc("d"), 2), ["l_suppkey", "r"])
    return both.groupBy("l_suppkey").agg(F.count_if(F.col("d1") != F.col("d2")).alias("moved"), F.count_if(F.abs(F.col("s1") - F.col("s2")) > 1e-5).alias("violations"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+')[1:12], ' ') AS query FROM documents WHERE doc_id % greatest((SELECT count(*) // 5 FROM documents), 1) = 0")
def f11_canaries(spark, sf):
    """Every (N // 5)-th document by id, with its first twelve words as a query."""
    docs = Tables(spark, sf).documents
    step = max(docs.count() // 5, 1)
    return docs.where(F.col("doc_id") % step == 0).select("doc_id", F.array_join(F.slice(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0)), 1, 12), " ").alias("query"))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95_linear, list_sort(list(l_extendedprice))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95_index FROM lineitem GROUP BY 1")
def f12_percentiles(spark, sf):
    lines, by = Tables(spark, sf).lineitem, ["l_returnflag"]
    median = ordinals.order_statistics(lines, by, "l_quantity", {"median": (0.5, "linear")})
    price = ordinals.order_statistics(lines, by, "l_extendedprice", {"p95_linear": (0.95, "linear"), "p95_index": (0.95, "index")})
    return median.join(price, "l_returnflag").select("l_returnflag", F.round("median", 6).alias("median"), F.round("p95_linear", 4).alias("p95_linear"), "p95_index")


@query("""WITH pool AS (SELECT l_suppkey AS q, l_partkey AS d FROM lineitem WHERE l_linestatus = 'F' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount >= 0.05), rel AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS d FROM lineitem WHERE l_returnflag = 'R')
SELECT rel.q AS l_suppkey, count(*) AS relevant, round(count(pool.d) / count(*), 6) AS pool_recall FROM rel LEFT JOIN pool ON rel.q = pool.q AND rel.d = pool.d GROUP BY 1""")
def g1_candidate_pool_recall(spark, sf):
    own = Tables(spark, sf).lineitem
    pool = own.where("l_linestatus = 'F'").select("l_suppkey", "l_partkey").union(own.where("l_discount >= 0.05").select("l_suppkey", "l_partkey")).distinct().withColumn("y", F.lit(1))
    rel = own.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    return rel.join(pool, ["l_suppkey", "l_partkey"], "left").groupBy("l_suppkey").agg(F.count("*").alias("relevant"), F.round(F.count("y") / F.count("*"), 6).alias("pool_recall"))


_BRANCHES = """SELECT l_orderkey AS q, l_partkey AS d, 'price' AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS r FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, 'quantity', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) FROM lineitem"""


def branches(lineitem):
    rank = lambda c, name: lineitem.select("l_orderkey", "l_partkey", F.lit(name).alias("branch"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(c), "l_partkey")).alias("rank"))
    return rank("l_extendedprice", "price").union(rank("l_quantity", "quantity"))


@query(f"""SELECT q AS l_orderkey, d AS l_partkey, round(score, 8) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM (SELECT q, d, sum(1.0 / (60 + r)) AS score FROM (SELECT q, d, b, min(r) AS r FROM ({_BRANCHES}) GROUP BY 1, 2, 3) GROUP BY 1, 2)) WHERE rank <= 5""")
def g2_union_retriever(spark, sf):
    out = ranking.fuse(branches(Tables(spark, sf).lineitem), "l_orderkey", "l_partkey", "branch", limit=5)
    return out.select("l_orderkey", "l_partkey", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, 'common' AS part FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'missing' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def g3_common_and_missing(spark, sf):
    t = Tables(spark, sf)
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.intersect(b).withColumn("part", F.lit("common")).union(a.subtract(b).withColumn("part", F.lit("missing")))


@query("SELECT l_orderkey, list_sort(list_filter(list(DISTINCT l_suppkey), lambda x: x % 3 <> 0)) AS unknown FROM lineitem GROUP BY 1")
def g4_validate_citations(spark, sf):
    own = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("cited"))
    allowed = F.filter("cited", lambda x: x % 3 == 0)
    return own.select("l_orderkey", F.sort_array(F.array_except("cited", allowed)).alias("unknown"))


@query("""SELECT o AS l_orderkey, list(s ORDER BY f) AS suppliers FROM (SELECT l_orderkey AS o, l_suppkey AS s, min(n) AS f FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def g5_ordered_distinct(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.array_distinct(F.transform(rows, lambda x: x["l_suppkey"])).alias("suppliers"))


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS queries_without_qrels, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS qrels_without_query, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS queries_without_split""")
def g6_dataset_closure(spark, sf):
    t = Tables(spark, sf)
    lost = lambda a, x, b, y, name: a.select(F.col(x).alias("k")).join(b.select(F.col(y).alias("k")), "k", "left_anti").agg(F.count("*").alias(name))
    return lost(t.orders, "o_orderkey", t.lineitem, "l_orderkey", "queries_without_qrels").crossJoin(lost(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "qrels_without_query")).crossJoin(lost(t.orders, "o_custkey", t.customer, "c_custkey", "queries_without_split"))
