"""Aggregations (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical
from ..operators.ordinals import order_statistics
from .registry import Tables, query


@query("""SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total_length, round(sum(n) / count(*), 6) AS avgdl FROM (SELECT len(regexp_extract_all(lower(text), '[0-9a-z]+')) AS n FROM documents)""")
def d1_bm25_statistics(spark, sf):
    _, _, stats = lexical.fit(Tables(spark, sf).documents, "doc_id", "text")
    return stats.withColumn("avgdl", F.round("avgdl", 6))


def coverage(docs, labels):
    """Per language and source: documents, labelled ones, good ones, toxic ones and the labelled share (null without any)."""
    own = docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    out = own.groupBy("lang", "source").agg(F.count("*").alias("papers"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("failed"))
    return out.withColumn("pct", F.round(100.0 * F.col("good") / F.nullif("labelled", F.lit(0)), 6))


_COVERAGE = """SELECT lang, source, count(*) AS papers, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS failed,
 round(100.0 * count(*) FILTER (WHERE quality = 1) / nullif(count(quality), 0), 6) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"""


@query(_COVERAGE)
def d2_coverage_rows(spark, sf):
    t = Tables(spark, sf)
    return coverage(t.documents, t.labels)


@query(f"SELECT CAST(sum(papers) AS BIGINT) AS papers, CAST(sum(labelled) AS BIGINT) AS labelled, CAST(sum(good) AS BIGINT) AS good, count(DISTINCT lang) AS langs FROM ({_COVERAGE})")
def d3_coverage_totals(spark, sf):
    t = Tables(spark, sf)
    return coverage(t.documents, t.labels).agg(F.sum("papers").alias("papers"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.countDistinct("lang").alias("langs"))


@query("""SELECT event_type AS model, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) FILTER (WHERE value < 2) AS failed, count(*) FILTER (WHERE user_id % 7 = 0) AS unsettled,
 CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(coalesce(CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(value AS DECIMAL(12,6)) END, CAST(1.5 AS DECIMAL(12,6)))) AS DOUBLE) AS cost FROM events GROUP BY 1, 2""")
def d4_spend_report(spark, sf):
    cost = F.coalesce(F.when(F.col("user_id") % 7 != 0, F.col("value").cast("decimal(12,6)")), F.lit("1.5").cast("decimal(12,6)"))
    tokens = F.get_json_object("props", "$.k").cast("long")
    return Tables(spark, sf).events.groupBy(F.col("event_type").alias("model"), F.to_date("ts").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("value") < 2).alias("failed"), F.count_if(F.col("user_id") % 7 == 0).alias("unsettled"), F.sum(tokens).alias("tokens"), F.sum(cost).cast("double").alias("cost"))


@query("SELECT user_id, CAST(sum(CAST(value AS DECIMAL(12,6))) AS DOUBLE) AS spent FROM events WHERE event_type = 'purchase' GROUP BY 1")
def d5_run_spend(spark, sf):
    return Tables(spark, sf).events.where("event_type = 'purchase'").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(12,6)")).cast("double").alias("spent"))


@query("""SELECT event_type, key AS stage, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM (SELECT event_type, 'k' AS key, CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events) GROUP BY 1, 2""")
def d6_chat_stats(spark, sf):
    stages = Tables(spark, sf).events.select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("stage", "v")).where("v is not null")
    counts = stages.groupBy("event_type", "stage").agg(F.count("*").alias("n"))
    places = order_statistics(stages, ["event_type", "stage"], "v", {"p50": (0.5, "linear"), "p95": (0.95, "linear")}).withColumnsRenamed({"event_type": "_type", "stage": "_stage"})
    joined = counts.join(places, F.col("event_type").eqNullSafe(F.col("_type")) & F.col("stage").eqNullSafe(F.col("_stage")))
    return joined.select("event_type", "stage", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT c_nationkey, string_agg(c_name, '; ' ORDER BY c_custkey) AS names FROM customer GROUP BY 1")
def d7_ordered_string_agg(spark, sf):
    Tables(spark, sf).customer.createOrReplaceTempView("scholia_customer")
    return spark.sql("SELECT c_nationkey, listagg(c_name, '; ') WITHIN GROUP (ORDER BY c_custkey) AS names FROM scholia_customer GROUP BY c_nationkey")


@query("""SELECT n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM nation GROUP BY 1""")
def d8_ordered_json_agg(spark, sf):
    return Tables(spark, sf).nation.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("nations"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS unfinished, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def d9_status_histogram(spark, sf):
    return Tables(spark, sf).orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("unfinished"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


_FAMILY = "SELECT event_type AS variant, user_id AS family, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"SELECT variant, round(avg(m), 6) AS mean, count(*) AS families, CAST(sum(n) AS BIGINT) AS queries, round(min(m), 6) AS worst FROM ({_FAMILY}) GROUP BY 1")
def d10_summarize_families(spark, sf):
    family = Tables(spark, sf).events.groupBy(F.col("event_type").alias("variant"), F.col("user_id").alias("family")).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return family.groupBy("variant").agg(F.round(F.avg("m"), 6).alias("mean"), F.count("*").alias("families"), F.sum("n").alias("queries"), F.round(F.min("m"), 6).alias("worst"))


@query("""SELECT l_returnflag AS variant, 'status' AS facet, l_linestatus AS value, round(avg(l_discount), 6) AS mean, count(*) AS queries FROM lineitem GROUP BY 1, 3
UNION ALL SELECT l_returnflag, 'line', CAST(l_linenumber AS VARCHAR), round(avg(l_discount), 6), count(*) FROM lineitem GROUP BY 1, 3""")
def d11_facets(spark, sf):
    rows = Tables(spark, sf).lineitem.select(F.col("l_returnflag").alias("variant"), "l_discount", F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("string").alias("line"))
    tall = rows.unpivot(["variant", "l_discount"], ["status", "line"], "facet", "value")
    return tall.groupBy("variant", "facet", "value").agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.count("*").alias("queries"))


@query("""SELECT l_returnflag AS variant, l_linestatus AS query_set, l_linenumber AS specificity, round(avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END), 6) AS within, round(avg(CASE WHEN l_quantity > 10 AND l_quantity <= 40 THEN 1.0 ELSE 0.0 END), 6) AS beyond,
 round(avg(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END), 6) AS absent FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), (l_returnflag, l_linenumber))""")
def d12_stage_losses(spark, sf):
    rows = Tables(spark, sf).lineitem.select(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("query_set"), F.col("l_linenumber").alias("specificity"), "l_quantity")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    q = F.col("l_quantity")
    v, a, b = F.col("variant"), F.col("query_set"), F.col("specificity")
    return rows.groupingSets([[v], [v, a], [v, b]], v, a, b).agg(share(q <= 10).alias("within"), share((q > 10) & (q <= 40)).alias("beyond"), share(q > 40).alias("absent"))


def rank_band(rank):
    """The band of a one-based rank; null is absent."""
    return F.when(rank.isNull(), "absent").when(rank <= 1, "1").when(rank <= 5, "2-5").when(rank <= 10, "6-10").when(rank <= 20, "11-20").when(rank <= 50, "21-50").when(rank <= 100, "51-100").otherwise("absent")


@query("""SELECT l_returnflag AS variant, CASE WHEN l_quantity <= 1 THEN '1' WHEN l_quantity <= 5 THEN '2-5' WHEN l_quantity <= 10 THEN '6-10' WHEN l_quantity <= 20 THEN '11-20' WHEN l_quantity <= 50 THEN '21-50' WHEN l_quantity <= 100 THEN '51-100' ELSE 'absent' END AS band, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def d13_rank_buckets(spark, sf):
    return Tables(spark, sf).lineitem.groupBy(F.col("l_returnflag").alias("variant"), rank_band(F.col("l_quantity")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, list(l_orderkey ORDER BY l_orderkey) AS missed, CAST(round(avg(l_discount) * count(*)) AS BIGINT) AS found FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def d14_misses(spark, sf):
    """Sums of floats hang on their order, and a half may fall on either side: each group's are added up in the order of the file, as they stand."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "l_orderkey", "l_discount")
    own = Tables(spark, sf).lineitem.where("l_quantity > 45").select("l_suppkey", place.alias("x")).groupBy("l_suppkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    given = F.filter(F.transform("x", lambda x: x["l_discount"]), lambda x: x.isNotNull())
    total = F.aggregate(given, F.lit(0.0), lambda s, x: s + x)
    keys = F.array_sort(F.transform("x", lambda x: x["l_orderkey"]))
    return own.select("l_suppkey", keys.alias("missed"), F.round(total / F.nullif(F.size(given), F.lit(0)) * F.size("x")).cast("long").alias("found"))


@query("""SELECT o_orderpriority AS type, count(*) AS cases, count(*) FILTER (WHERE o_orderstatus <> 'P') AS judged, round(avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END), 6) AS accuracy, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END), 6) AS abstention, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1""")
def d15_summarize_qa(spark, sf):
    verdict = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    return Tables(spark, sf).orders.groupBy(F.col("o_orderpriority").alias("type")).agg(
        F.count("*").alias("cases"), F.count(verdict).alias("judged"), F.round(F.avg(verdict), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("o_totalprice") > 100000, 1.0).otherwise(0.0)), 6).alias("abstention"), F.round(F.sum("o_totalprice"), 2).alias("cost"))


@query("""SELECT l_linestatus, round(count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.05) / nullif(count(*) FILTER (WHERE l_discount > 0.05), 0), 6) AS precision, round(count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.05) / nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0), 6) AS recall,
 round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1""")
def d16_summarize_turns(spark, sf):
    said, true = F.col("l_discount") > 0.05, F.col("l_returnflag") == "R"
    own = Tables(spark, sf).lineitem
    shares = own.groupBy("l_linestatus").agg(
        F.round(F.count_if(said & true) / F.nullif(F.count_if(said), F.lit(0)), 6).alias("precision"), F.round(F.count_if(said & true) / F.nullif(F.count_if(true), F.lit(0)), 6).alias("recall"))
    places = order_statistics(own, ["l_linestatus"], "l_extendedprice", {"p50": (0.5, "linear"), "p95": (0.95, "linear")}).withColumnRenamed("l_linestatus", "_status")
    joined = shares.join(places, F.col("l_linestatus").eqNullSafe(F.col("_status")), "left")
    return joined.select("l_linestatus", "precision", "recall", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("SELECT round(avg(CASE WHEN s > 0 THEN r * 1.0 / s END), 6) AS mean_supported, round(avg(CASE WHEN s > 0 THEN CASE WHEN r = s THEN 1.0 ELSE 0.0 END END), 6) AS fully, count(*) AS answers FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 5) AS r, count(*) AS s FROM lineitem GROUP BY 1)")
def d17_faithfulness(spark, sf):
    own = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 5).alias("r"), F.count("*").alias("s"))
    rate = F.col("r") / F.nullif("s", F.lit(0))
    return own.agg(F.round(F.avg(rate), 6).alias("mean_supported"), F.round(F.avg(F.when(rate == 1, 1.0).otherwise(0.0)), 6).alias("fully"), F.count("*").alias("answers"))


@query("SELECT event_type AS variant, lang AS query_set, count(*) AS n, round(avg(value), 6) AS score FROM events JOIN documents ON user_id = doc_id GROUP BY ROLLUP (event_type, lang) HAVING event_type IS NOT NULL")
def d18_section_scores(spark, sf):
    t = Tables(spark, sf)
    rows = t.events.join(t.documents.select("doc_id", "lang"), F.col("user_id") == F.col("doc_id")).select(F.col("event_type").alias("variant"), F.col("lang").alias("query_set"), "value")
    return rows.rollup("variant", "query_set").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("score")).where("variant is not null")


@query("""SELECT lang, count(*) AS chunks, round(median(n), 6) AS median, round(avg(n), 6) AS mean, list_sort(list(n))[CAST(floor(0.9 * count(*)) AS BIGINT) + 1] AS p90, max(n) AS longest, round(100.0 * avg(CASE WHEN mid THEN 1.0 ELSE 0.0 END), 6) AS mid_end
FROM (SELECT lang, len(regexp_extract_all(text, '\\S+')) AS n, NOT regexp_matches(rtrim(text, ' '), '([.!?:]|\\."|\\.''|\\.\\)|”)$') AS mid FROM documents) GROUP BY 1""".replace("\\\\", "\\"))
def d19_chunk_statistics(spark, sf):
    from ..functions.text import ends_mid_sentence, words

    rows = Tables(spark, sf).documents.select("lang", F.size(words(F.col("text"))).cast("long").alias("n"), ends_mid_sentence(F.col("text")).alias("mid"))
    own = rows.groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("longest"), F.round(100 * F.avg(F.when(F.col("mid"), 1.0).otherwise(0.0)), 6).alias("mid_end"))
    placed = order_statistics(rows, ["lang"], "n", {"median": (0.5, "linear"), "p90": (0.9, "index")}).withColumnRenamed("lang", "l")
    return own.join(placed, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l").withColumn("median", F.round("median", 6))


@query("""SELECT policy, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS longest FROM (
 SELECT 'small' AS policy, least(64, w - s) AS n FROM (SELECT w, unnest(generate_series(0, greatest(CAST(ceil((w - 64) / 56.0) AS BIGINT), 0) * 56, 56)) AS s FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS w FROM documents) WHERE w > 0)
 UNION ALL SELECT 'large', least(256, w - s) FROM (SELECT w, unnest(generate_series(0, greatest(CAST(ceil((w - 256) / 224.0) AS BIGINT), 0) * 224, 224)) AS s FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS w FROM documents) WHERE w > 0)) GROUP BY 1""".replace("\\\\", "\\"))
def d20_compare_policies(spark, sf):
    from ..operators.chunking import fixed_windows

    docs = Tables(spark, sf).documents
    both = fixed_windows(docs, "doc_id", "text", 64, 8).withColumn("policy", F.lit("small")).union(fixed_windows(docs, "doc_id", "text", 256, 32).withColumn("policy", F.lit("large")))
    return both.groupBy("policy").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("longest"))


@query("SELECT p_brand || ' ' || p_type AS slice, count(*) AS n FROM part GROUP BY 1")
def d21_relabel_summary(spark, sf):
    return Tables(spark, sf).part.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("slice")).agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS answers, count(*) FILTER (WHERE event_type = 'error') AS pending FROM events GROUP BY 1, 2")
def d22_answer_usage(spark, sf):
    return Tables(spark, sf).events.groupBy("user_id", F.to_date(F.date_trunc("day", "ts")).alias("day")).agg(F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("answers"), F.count_if(F.col("event_type") == "error").alias("pending"))


@query("SELECT list_sort(list(DISTINCT lang)) AS langs, CAST(count(DISTINCT source) AS BIGINT) AS sources, count(*) AS total FROM documents")
def d23_coverage_summary(spark, sf):
    return Tables(spark, sf).documents.agg(F.sort_array(F.collect_set("lang")).alias("langs"), F.countDistinct("source").alias("sources"), F.count("*").alias("total"))


@query("SELECT event_type, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95_index, max(value) AS worst FROM events GROUP BY 1")
def d24_latency_by_index(spark, sf):
    return order_statistics(Tables(spark, sf).events, ["event_type"], "value", {"p95_index": (0.95, "index"), "worst": (1.0, "index")})


@query("SELECT c_nationkey AS family, count(DISTINCT c_mktsegment) AS splits, count(*) AS n, count(DISTINCT c_mktsegment) = 1 AS ok FROM customer GROUP BY 1")
def d25_family_spans_one_split(spark, sf):
    return Tables(spark, sf).customer.groupBy(F.col("c_nationkey").alias("family")).agg(F.countDistinct("c_mktsegment").alias("splits"), F.count("*").alias("n"), (F.countDistinct("c_mktsegment") == 1).alias("ok"))


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linestatus <> 'F' AND l_shipdate < TIMESTAMP '1997-01-01'")
def d26_pending_distinct(spark, sf):
    return Tables(spark, sf).lineitem.where("l_linestatus <> 'F' and l_shipdate < timestamp_ntz'1997-01-01'").select("l_suppkey").distinct().orderBy("l_suppkey")
