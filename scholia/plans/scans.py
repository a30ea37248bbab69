"""Scans, sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers
from .registry import Tables, query


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_brand = 'Brand#4' AND p_size = 11")
def a1_registry_scan(spark, sf):
    return readers.read_registry(spark, f"{sf}/part.parquet", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], {"p_brand": "Brand#4", "p_size": 11}, "p_partkey")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS present, sha256(d.text) AS sha256, CAST(strlen(d.text) AS BIGINT) AS n_bytes FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def a2_index_with_presence(spark, sf):
    t = Tables(spark, sf)
    own = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))
    return own.join(t.labels.select("doc_id").distinct().withColumn("p", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("p", F.lit(False)).alias("present"), "sha256", "n_bytes")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a3_download_plan(spark, sf):
    t = Tables(spark, sf)
    return readers.missing(t.documents.select("doc_id"), t.labels, "doc_id")


@query("SELECT item_id, text FROM benchmark")
def a4_jsonl_source(spark, sf):
    path = readers.scratch(spark)
    rows = Tables(spark, sf).benchmark.select(F.to_json(F.struct("item_id", "text")).alias("value"))
    notes = spark.createDataFrame([("# a comment",), ("",), ("   ",)], "value string")
    rows.union(notes).write.text(path)
    return readers.read_jsonl(spark, path, "item_id long, text string")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, split_part(regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1), '/', 1) AS lang,
 TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS BIGINT) AS page FROM pages""")
def a5_normalize_source(spark, sf):
    url = F.col("url")
    path = F.ltrim(F.parse_url(url, F.lit("PATH")), F.lit("/"))
    return Tables(spark, sf).pages.select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.coalesce(F.split_part(path, F.lit("/"), F.lit(1)), F.lit("")).alias("lang"), F.parse_url(url, F.lit("QUERY"), F.lit("page")).cast("long").alias("page"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS epoch_ms FROM events")
def a6_unwrap_json_source(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return Tables(spark, sf).events.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), ms.alias("epoch_ms"))


@query("SELECT item_id AS id, text AS summary FROM benchmark WHERE text IS NOT NULL")
def a7_xml_feed(spark, sf):
    path = readers.scratch(spark)
    Tables(spark, sf).benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("summary")).write.format("xml").options(rootTag="feed", rowTag="entry").save(path)
    return spark.read.format("xml").options(rowTag="entry", ignoreSurroundingSpaces="false").schema("id long, summary string").load(path)


@query("SELECT s_nationkey, s_suppkey, s_name FROM supplier")
def a8_json_listing(spark, sf):
    path = readers.scratch(spark)
    own = Tables(spark, sf).supplier
    listing = own.groupBy("s_nationkey").agg(F.collect_list(F.struct("s_suppkey", "s_name")).alias("papers"))
    listing.write.json(path)
    back = spark.read.schema("s_nationkey int, papers array<struct<s_suppkey:long,s_name:string>>").json(path)
    return back.select("s_nationkey", F.explode("papers").alias("p")).select("s_nationkey", "p.*")


@query("""WITH k AS (SELECT lower(p_name) AS title, min(p_partkey) AS first_id FROM part GROUP BY 1)
SELECT p.p_partkey, coalesce(e.p_partkey, k.first_id) AS found FROM part p LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) e USING (p_partkey) LEFT JOIN k ON lower(p.p_name) = k.title""")
def a9_lookup_by_id_then_title(spark, sf):
    part = Tables(spark, sf).part
    by_id = part.where("p_size <= 25").select("p_partkey", F.col("p_partkey").alias("e"))
    by_title = part.groupBy(F.lower("p_name").alias("title")).agg(F.min("p_partkey").alias("first_id"))
    found = part.join(by_id, "p_partkey", "left").join(by_title, F.lower("p_name") == F.col("title"), "left")
    return found.select("p_partkey", F.coalesce("e", "first_id").alias("found"))


@query("SELECT doc_id, text, sha256(text) AS text_sha256 FROM documents")
def a11_verified_snapshot_scan(spark, sf):
    path = readers.scratch(spark)
    readers.write_snapshot(Tables(spark, sf).documents.select("doc_id", "text"), path, "doc_id", "text", 5000)
    return readers.read_snapshot(spark, path, "text")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority, c_mktsegment, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def a12_five_way_scan(spark, sf):
    t = Tables(spark, sf)
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment", "n_name")


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters FROM documents")
def a13_rolling_shards(spark, sf):
    return readers.write_snapshot(Tables(spark, sf).documents.select("doc_id", "text"), readers.scratch(spark), "doc_id", "text", 2000)


@query("""SELECT 'documents' AS name, count(*) AS rows, sha256(coalesce(string_agg(doc_id || chr(9) || sha256(text) || chr(10), '' ORDER BY doc_id), '')) AS digest FROM documents
UNION ALL SELECT 'benchmark', count(*), sha256(coalesce(string_agg(item_id || chr(9) || sha256(text) || chr(10), '' ORDER BY item_id), '')) FROM benchmark""")
def a14_manifest(spark, sf):
    from ..operators.digests import ordered_digest

    t = Tables(spark, sf)
    return ordered_digest(t.documents, "doc_id", "text", "documents").union(ordered_digest(t.benchmark, "item_id", "text", "benchmark"))


@query("SELECT 0 AS wrong, count(*) > 0 AS has_files FROM region")
def a15_validate_manifest(spark, sf):
    path = readers.scratch(spark)
    Tables(spark, sf).documents.write.option("maxRecordsPerFile", 3000).parquet(path)
    manifest = readers.file_digests(spark, f"{path}/*.parquet")
    again = readers.file_digests(spark, f"{path}/*.parquet").withColumnRenamed("sha256", "now").withColumnRenamed("length", "size")
    both = manifest.join(again, "name", "full")
    return both.agg(F.count_if(~(F.col("sha256").eqNullSafe(F.col("now"))) | ~F.col("length").eqNullSafe(F.col("size"))).cast("int").alias("wrong"), (F.count("*") > 0).alias("has_files"))


@query("""WITH x AS (SELECT p_partkey, unnest(string_split('brand:' || lower(p_brand) || ' type:' || lower(p_type), ' ')) AS alias FROM part)
SELECT split_part(alias, ':', 1) AS namespace, split_part(alias, ':', 2) AS value, min(p_partkey) AS owner FROM x GROUP BY 1, 2""")
def a16_restore_identifiers(spark, sf):
    alias = F.explode(F.split(F.concat(F.lit("brand:"), F.lower("p_brand"), F.lit(" type:"), F.lower("p_type")), " ")).alias("alias")
    rows = Tables(spark, sf).part.select("p_partkey", alias)
    return rows.groupBy(F.substring_index("alias", ":", 1).alias("namespace"), F.substring_index("alias", ":", -1).alias("value")).agg(F.min("p_partkey").alias("owner"))


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS term FROM documents) GROUP BY term")
def a17_vocabulary_save_load(spark, sf):
    from ..operators.lexical import fit

    _, df, _ = fit(Tables(spark, sf).documents, "doc_id", "text")
    return readers.round_trip(df, "parquet")


@query("SELECT b.item_id, b.text, md5(b.text) AS text_md5 FROM benchmark b")
def a18_hydrate_text_free(spark, sf):
    own = Tables(spark, sf).benchmark
    free = readers.round_trip(own.select("item_id", F.md5(F.col("text").cast("binary")).alias("text_md5")), "json")
    whole = own.join(free, "item_id", "left")
    return whole.where(F.coalesce(F.assert_true(F.col("text_md5").isNotNull(), F.lit("text is missing")).cast("string"), F.lit("")) == "").select("item_id", "text", "text_md5")


@query("SELECT l_orderkey AS query_id, l_partkey AS corpus_id, CAST(l_linenumber AS INTEGER) AS score FROM lineitem")
def a19_qrels_tsv(spark, sf):
    rows = Tables(spark, sf).lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("corpus_id"), F.col("l_linenumber").cast("int").alias("score"))
    return readers.round_trip(rows, "csv", sep="\t", header="true")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def a20_keyed_objects(spark, sf):
    t = Tables(spark, sf)
    # each row is an object of one key, so no table is in one object
    obj = lambda df, k, v: df.select(F.to_json(F.create_map(F.col(k).cast("string"), F.col(v).cast("string"))).alias("j")).select(F.explode(F.from_json("j", "map<string,string>")).alias("id", v))
    names, keys, regions = obj(t.nation, "n_nationkey", "n_name"), obj(t.nation, "n_nationkey", "n_regionkey"), obj(t.region, "r_regionkey", "r_name")
    joined = names.join(keys, "id").join(regions.withColumnRenamed("id", "n_regionkey"), "n_regionkey")
    return joined.select("id", F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query("SELECT l_orderkey AS query_id, list(l_partkey ORDER BY l_extendedprice DESC, l_partkey) AS ranked FROM lineitem GROUP BY 1")
def a21_run_outputs(spark, sf):
    order = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("s"), F.col("l_partkey").alias("p"))))
    rows = Tables(spark, sf).lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.transform(order, lambda x: x["p"]).alias("ranked"))
    return readers.round_trip(rows, "parquet")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def a22_backup_restore_csv(spark, sf):
    return readers.round_trip(Tables(spark, sf).customer.select("c_custkey", "c_name", "c_acctbal"), "csv", header="true")


@query("""WITH c AS (SELECT DISTINCT sha256(text) AS k FROM documents JOIN labels USING (doc_id)) SELECT d.doc_id, c.k IS NOT NULL AS hit FROM documents d LEFT JOIN c ON sha256(d.text) = c.k""")
def a23_embedding_cache(spark, sf):
    t = Tables(spark, sf)
    keyed = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    store = keyed.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select("k").distinct()
    return readers.cached(keyed, store, ["k"]).select("doc_id", "hit")


@query("SELECT conv_id, turn, sha256('{\"role\":\"' || role || '\",\"turn\":' || turn || '}') AS cache_key FROM conversations")
def a24_response_cache_key(spark, sf):
    return Tables(spark, sf).conversations.select("conv_id", "turn", F.sha2(F.to_json(F.struct("role", "turn")).cast("binary"), 256).alias("cache_key"))


@query(r"""SELECT page_id, CASE WHEN html IS NULL THEN 'missing' WHEN length(trim(html)) = 0 THEN 'empty' WHEN NOT regexp_matches(html, '(?i)<html') THEN 'not_html' WHEN length(html) > 100000 THEN 'oversized' ELSE 'ok' END AS status,
 CAST(len(string_split(coalesce(html, ''), '<p>')) - 1 AS BIGINT) AS paragraphs FROM pages""")
def a25_page_adapter(spark, sf):
    html = F.col("html")
    status = F.when(html.isNull(), "missing").when(F.length(F.trim(html)) == 0, "empty").when(~html.rlike("(?i)<html"), "not_html").when(F.length(html) > 100000, "oversized").otherwise("ok")
    return Tables(spark, sf).pages.select("page_id", status.alias("status"), (F.size(F.split(F.coalesce(html, F.lit("")), "<p>")) - 1).cast("long").alias("paragraphs"))


