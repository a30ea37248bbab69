"""Window and analytic operators (E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking
from .joins import _CHOSEN, chosen_order
from .registry import Tables, query


@query(f"SELECT o_custkey, o_orderkey FROM ({_CHOSEN})")
def e1_chosen_version(spark, sf):
    return chosen_order(Tables(spark, sf).orders).select("o_custkey", "o_orderkey")


_SEEDED = "row_number() OVER (PARTITION BY {p} ORDER BY md5(doc_id || 'seed'), doc_id)"


@query(f"SELECT doc_id, source, lang FROM (SELECT *, {_SEEDED.format(p='lang, source')} AS b FROM (SELECT *, {_SEEDED.format(p='source, lang, n_chars % 10')} AS a FROM documents) WHERE a <= 2) WHERE b <= 5")
def e2_stratified_sample(spark, sf):
    order = (F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("seed")).cast("binary")), F.col("doc_id"))
    first = Tables(spark, sf).documents.withColumn("a", F.row_number().over(Window.partitionBy("source", "lang", F.col("n_chars") % 10).orderBy(*order))).where("a <= 2")
    return first.withColumn("b", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where("b <= 5").select("doc_id", "source", "lang")


@query(f"SELECT doc_id, lang FROM (SELECT *, {_SEEDED.format(p='lang')} AS n FROM documents) WHERE n <= 50")
def e3_hash_sample(spark, sf):
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("seed")).cast("binary")), "doc_id")
    return Tables(spark, sf).documents.withColumn("n", F.row_number().over(w)).where("n <= 50").select("doc_id", "lang")


@query("""SELECT l_suppkey, l_partkey, l_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey) AS g FROM lineitem) WHERE g = 1) WHERE rank <= 10""")
def e4_best_chunk_per_paper(spark, sf):
    return ranking.best_per_group(Tables(spark, sf).lineitem, "l_suppkey", "l_partkey", "l_orderkey", "l_extendedprice", 10).select("l_suppkey", "l_partkey", "l_orderkey", F.col("rank").cast("long").alias("rank"))


_FIRST = "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS r FROM lineitem GROUP BY 1, 2"


@query(f"SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, l_suppkey) AS rank FROM ({_FIRST})")
def e5_first_occurrence(spark, sf):
    rows = Tables(spark, sf).lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("rank"))
    return ranking.first_occurrence(rows, "l_orderkey", "l_suppkey").withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT conv_id, turn, n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, k) AS n FROM (SELECT conv_id, md5(text) AS k, max(turn) AS turn FROM conversations GROUP BY 1, 2)) WHERE n <= 3""")
def e6_carried_evidence(spark, sf):
    own = Tables(spark, sf).conversations.groupBy("conv_id", F.md5(F.col("text").cast("binary")).alias("k")).agg(F.max("turn").alias("turn"))
    return own.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "k"))).where("n <= 3").select("conv_id", "turn", "n")


@query("""SELECT conv_id, turn, md5(q) AS question, md5(a) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM (SELECT conv_id, turn, role, text AS q, lead(text) OVER w AS a, lead(role) OVER w AS next_role FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant') WHERE n <= 3""")
def e7_history_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = Tables(spark, sf).conversations.where("role <> 'system'").withColumns({"a": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    last = pairs.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 3")
    return last.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("question"), F.md5(F.col("a").cast("binary")).alias("answer"))


_RANKED = "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem"


def supplier_ranking(lineitem):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return lineitem.withColumn("rank", F.row_number().over(w).cast("long"))


@query(f"SELECT l_suppkey, l_partkey, rank, position FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY rank) AS n FROM ({_RANKED})) WHERE n <= 3) WHERE position <= 12")
def e8_caps(spark, sf):
    return ranking.capped(supplier_ranking(Tables(spark, sf).lineitem), "l_suppkey", "l_partkey", "rank", 3, 12).select("l_suppkey", "l_partkey", "rank", F.col("position").cast("long").alias("position"))


@query("""WITH RECURSIVE items AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, CAST(l_quantity AS BIGINT) AS t FROM lineitem),
f AS (SELECT q, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, false AS took FROM (SELECT DISTINCT q FROM items) UNION ALL
 SELECT f.q, x.i, CASE WHEN f.used + x.t <= 60 THEN f.used + x.t ELSE f.used END, f.used + x.t <= 60 FROM f JOIN items x ON x.q = f.q AND x.i = f.i + 1)
SELECT q AS l_orderkey, row_number() OVER (PARTITION BY q ORDER BY i) AS position, i AS item, used FROM f WHERE took""")
def e9_budget_fill(spark, sf):
    rows = Tables(spark, sf).lineitem.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")))
    out = ranking.fill_budget(rows, "l_orderkey", F.col("i"), F.col("i"), F.col("l_quantity"), 60)
    return out.withColumn("position", F.col("position").cast("long"))


@query(f"SELECT f.l_orderkey, f.l_suppkey, f.rank FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, l_suppkey) AS rank FROM ({_FIRST})) f WHERE EXISTS (SELECT 1 FROM lineitem g WHERE g.l_orderkey = f.l_orderkey AND g.l_suppkey = f.l_suppkey AND g.l_returnflag = 'R')")
def e10_gold_ranks(spark, sf):
    t = Tables(spark, sf)
    ranks = ranking.first_occurrence(t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("rank")), "l_orderkey", "l_suppkey")
    return ranks.join(t.lineitem.where("l_returnflag = 'R'"), ["l_orderkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_suppkey", F.col("rank").cast("long").alias("rank"))


@query("""SELECT l_orderkey, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def e11_better_branch_chunk(spark, sf):
    order = F.struct("l_linenumber", F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("b"), "l_partkey")
    return Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min_by("l_partkey", order).alias("l_partkey"))


@query("""SELECT user_id, k, read, row_number() OVER (PARTITION BY user_id ORDER BY first, k) AS rank FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, min(event_id) AS first, bool_or(event_type = 'click') AS read FROM events GROUP BY 1, 2)""")
def e12_merge_references(spark, sf):
    own = Tables(spark, sf).events.groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.min("event_id").alias("first"), F.max(F.col("event_type") == "click").alias("read"))
    return own.select("user_id", "k", "read", F.row_number().over(Window.partitionBy("user_id").orderBy("first", "k")).cast("long").alias("rank"))


@query("SELECT l_orderkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY r, l_suppkey) AS number FROM (" + _FIRST + ")")
def e13_citation_numbers(spark, sf):
    own = Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("r"))
    return own.select("l_orderkey", "l_suppkey", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("r", "l_suppkey")).cast("long").alias("number"))


@query("SELECT l_orderkey, list(l_suppkey ORDER BY (NOT cited), r, l_suppkey) AS passages FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS r, bool_or(l_returnflag = 'R') AS cited FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def e14_passages_of(spark, sf):
    own = Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("r"), F.max(F.col("l_returnflag") == "R").alias("cited"))
    return own.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("cited")).alias("c"), "r", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("passages"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) <= 100 AS dev FROM documents")
def e15_deterministic_split(spark, sf):
    """The first 100 ids by digest; found by a limit, so no single task sorts all rows."""
    own = Tables(spark, sf).documents.select("doc_id", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("h"))
    dev = own.orderBy("h", "doc_id").limit(100).select("doc_id", F.lit(True).alias("d"))
    return own.join(F.broadcast(dev), "doc_id", "left").select("doc_id", F.coalesce("d", F.lit(False)).alias("dev"))


@query("""SELECT type, qid, CASE WHEN n <= 20 THEN 'dev' ELSE 'test' END AS split FROM (SELECT type, qid, row_number() OVER (PARTITION BY type ORDER BY qid) AS n FROM (SELECT DISTINCT lang AS type, left(sha256(text), 16) AS qid FROM documents)) WHERE n <= 60""")
def e16_sample_queries(spark, sf):
    own = Tables(spark, sf).documents.select(F.col("lang").alias("type"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("qid")).distinct()
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("qid"))).where("n <= 60")
    return ranked.select("type", "qid", F.when(F.col("n") <= 20, "dev").otherwise("test").alias("split"))


@query("""SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS age_us, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS last_hour FROM events""")
def e17_code_ages(spark, sf):
    own = Tables(spark, sf).events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hour = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return own.select("event_id", (F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))).alias("age_us"), (F.count("*").over(hour) - 1).alias("last_hour"))


@query("SELECT conv_id, coalesce(max(turn), -1) + 1 AS next_turn FROM conversations GROUP BY 1")
def e18_next_ordinal(spark, sf):
    return Tables(spark, sf).conversations.groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_turn"))
