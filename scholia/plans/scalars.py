"""Scalar functions (H), each over a whole table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import readers
from .registry import Tables, query


@query("SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS w FROM documents)")
def h1_tokenize(spark, sf):
    w = T.tokens(T.nfkc(F.col("text")))
    return Tables(spark, sf).documents.select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query()
def h2_whitespace_spans(spark, sf):
    import re

    @F.pandas_udf("array<array<int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [list(m.span()) for m in re.finditer(r"\S+", t or "")])

    readers.bounded_batches(spark)
    return Tables(spark, sf).documents.select("doc_id", spans("text").alias("spans"))


@query("SELECT doc_id, nullif(replace(lower(trim(regexp_replace(split_part(text, '.', 1), '\\s+', ' ', 'g'))), 'ß', 'ss'), '') AS title_key FROM documents".replace("\\\\", "\\"))
def h3_normalize_title(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", T.title_key(F.split_part("text", F.lit("."), F.lit(1))).alias("title_key"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN '10.' || CAST(1000 + p_partkey AS VARCHAR) || '/' || lower(p_brand) END AS doi FROM part")
def h4_normalize_doi(spark, sf):
    bare = F.concat(F.lit("10."), (F.lit(1000) + F.col("p_partkey")).cast("string"), F.lit("/"), F.col("p_brand"))
    raw = F.when(F.col("p_partkey") % 4 == 0, bare).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" https://doi.org/"), bare)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("DOI: "), bare)).otherwise(F.concat(F.lit("11."), bare))
    return Tables(spark, sf).part.select("p_partkey", T.normalize_doi(raw).alias("doi"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN '2101.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') END AS id, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size AS INTEGER) END AS version FROM part")
def h5_normalize_arxiv(spark, sf):
    bare = F.concat(F.lit("2101."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("arXiv:"), bare)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/"), bare, F.lit("v"), F.col("p_size").cast("string"))).otherwise(F.lit("no id"))
    return Tables(spark, sf).part.select("p_partkey", T.normalize_arxiv(raw).alias("a")).select("p_partkey", "a.id", "a.version")


@query("SELECT user_id, count(*) AS ids, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) % 3) > 1 AS conflict FROM events GROUP BY 1")
def h6_external_ids(spark, sf):
    ids = Tables(spark, sf).events.select("user_id", F.explode(F.from_json("props", "map<string,long>")).alias("ns", "v"))
    return ids.groupBy("user_id").agg(F.count("*").alias("ids"), (F.countDistinct(F.col("v") % 3) > 1).alias("conflict"))


@query("SELECT c_nationkey, list(trim(c_name) ORDER BY c_custkey) AS authors FROM customer GROUP BY 1")
def h7_split_authors(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    line = F.concat(F.lit(" ; "), F.array_join(rows, " ;  "), F.lit(";;"))
    return Tables(spark, sf).customer.groupBy("c_nationkey").agg(T.split_authors(line).alias("authors"))


@query("SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN p_name ELSE p_name || chr(10) || p_type END AS paper_text FROM part")
def h8_paper_text(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", T.paper_text(F.col("p_name"), F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type"))).alias("paper_text"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS digest FROM part""")
def h9_canonical_json_digest(spark, sf):
    canonical = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return Tables(spark, sf).part.select("p_partkey", F.sha2(canonical.cast("binary"), 256).alias("digest"))


@query("""WITH s AS (SELECT p_partkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_partkey || '|' || p_brand || '|' || p_size)) AS h FROM part), v AS (SELECT p_partkey, h, lower(to_hex(('0x' || h[17:18])::INTEGER & 63 | 128)) AS b FROM s)
SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lpad(b, 2, '0') || h[19:20] || '-' || h[21:32] AS chunk_id FROM v""")
def h10_chunk_id(spark, sf):
    name = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand", F.col("p_size").cast("string"))
    return Tables(spark, sf).part.select("p_partkey", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", name).alias("chunk_id"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(160), ' '), 'œ', 'oe')) AS digest FROM documents")
def h11_storable_text(spark, sf):
    out = F.replace(F.col("text"), F.lit("\u0000"), F.lit(""))
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), (" ", " "), ("œ", "oe")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return Tables(spark, sf).documents.select("doc_id", F.md5(out.cast("binary")).alias("digest"))


@query(r"SELECT c_custkey, regexp_replace('A ' || c_mktsegment || ' b', '([A-Z]-?)\s+([A-Z]{2,})', '\1\2', 'g') AS joined FROM customer")
def h12_small_caps(spark, sf):
    line = F.concat(F.lit("A "), F.col("c_mktsegment"), F.lit(" b"))
    return Tables(spark, sf).customer.select("c_custkey", F.regexp_replace(line, "(?<![A-Za-z])([A-Z]-?)\\s+([A-Z]{2,})", "$1$2").alias("joined"))


@query(r"SELECT page_id, CASE WHEN length(k) >= 12 THEN k END AS furniture_key FROM (SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '[0-9]+', '', 'g'), '\s+', ' ', 'g'))) AS k FROM pages)")
def h13_furniture_key(spark, sf):
    k = F.lower(T.collapse(F.regexp_replace("url", "\\d+", "")))
    return Tables(spark, sf).pages.select("page_id", F.when(F.length(k) >= 12, k).alias("furniture_key"))


@query(r"SELECT doc_id, NOT regexp_matches(ltrim(text, ' '), '^[\p{Lu}\p{Nd}\p{P}\p{S}]') AS starts_mid FROM documents")
def h14_mid_sentence(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", T.starts_mid_sentence(F.col("text")).alias("starts_mid"))


@query()
def h15_split_sentences(spark, sf):
    from ..operators.chunking import split_sentences

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_sentences(t or ""))

    readers.bounded_batches(spark)
    return Tables(spark, sf).documents.select("doc_id", split("text").alias("sentences"))


@query()
def h16_split_paragraphs(spark, sf):
    from ..operators.chunking import split_paragraphs

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_paragraphs(t or ""))

    readers.bounded_batches(spark)
    return Tables(spark, sf).documents.select("doc_id", split("text").alias("paragraphs"))


@query(r"""SELECT item_id, list_filter(list_transform(flatten(list_transform(list_filter(string_split(text, chr(10)), lambda l: NOT starts_with(ltrim(l, ' '), '#')), lambda l: string_split(regexp_replace(l, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda s: array_to_string(regexp_extract_all(lower(s), '[0-9a-z]+'), ' ')),
 lambda s: len(regexp_extract_all(s, '[0-9a-z]+')) >= 3 AND len(regexp_extract_all(s, '[0-9a-z]+')) <= 120) AS sentences FROM benchmark""")
def h17_normalized_sentences(spark, sf):
    return Tables(spark, sf).benchmark.select("item_id", T.naive_sentences(F.col("text")).alias("sentences"))


def longest_run(sentences, chunk):
    """The most consecutive sentences that the chunk contains as whole words."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    padded = F.concat(F.lit(" "), chunk, F.lit(" "))

    def step(s, x):
        run = F.when(F.contains(padded, F.concat(F.lit(" "), x, F.lit(" "))), s["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(sentences, start, step, lambda s: s["best"])


@query()
def h18_longest_run(spark, sf):
    own = Tables(spark, sf).benchmark
    return own.select("item_id", longest_run(T.naive_sentences(F.col("text")), F.array_join(T.tokens(F.col("text")), " ")).alias("run"))


@query(r"""WITH g AS (SELECT DISTINCT array_to_string(w[k : k + 7], ' ') AS gram FROM (SELECT w, unnest(generate_series(1, greatest(len(w) - 7, 0))) AS k FROM (SELECT regexp_extract_all(lower(text), '[0-9a-z]+') AS w FROM benchmark))),
d AS (SELECT doc_id, array_to_string(w[k : k + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 7, 0))) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS w FROM documents)))
SELECT doc_id, count(DISTINCT gram) AS shared FROM d JOIN g USING (gram) GROUP BY 1""")
def h19_copied_run_test(spark, sf):
    """Texts that share a run of eight words with the benchmark: word 8-grams, told apart by 128 bits of hash, in an equi-join."""
    t = Tables(spark, sf)

    def grams(df, *keys):
        w = T.tokens(F.col("text"))
        at = F.when(F.size("w") >= 8, F.sequence(F.lit(1), F.size("w") - 7))
        own = F.transform(at, lambda k: F.struct(F.xxhash64(F.slice("w", k, F.lit(8))).alias("g"), F.xxhash64(F.lit(1), F.slice("w", k, F.lit(8))).alias("h")))
        return df.select(*keys, w.alias("w")).select(*keys, F.inline(own))

    # what the benchmark has is written first, so that the join knows its size; only what is found is made distinct
    asked = readers.round_trip(grams(t.benchmark).distinct(), "parquet")
    return grams(t.documents, "doc_id").join(asked, ["g", "h"], "left_semi").distinct().groupBy("doc_id").agg(F.count("*").alias("shared"))


@query(r"""SELECT conv_id, turn, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(q), '[0-9a-z]+'), lambda x: length(x) >= 5)), regexp_extract_all(lower(a), '[0-9a-z]+'))) > 0 AS leaks
FROM (SELECT conv_id, turn, role, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) WHERE a IS NOT NULL""")
def h20_leaks(spark, sf):
    from pyspark.sql import Window

    own = Tables(spark, sf).conversations.withColumn("a", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("a is not null")
    distinctive = F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 5)
    return own.select("conv_id", "turn", F.arrays_overlap(distinctive, T.tokens(F.col("a"))).alias("leaks"))


@query("SELECT l_linenumber, round(ln(1 + (7 - l_linenumber + 0.5) / (l_linenumber + 0.5)), 6) AS idf, round(avg(l_quantity * 2.2 / (l_quantity + 1.2 * (0.25 + 0.75 * l_linenumber / 4.0))), 6) AS weight FROM lineitem GROUP BY 1")
def h21_term_weight(spark, sf):
    from ..operators.lexical import idf, term_weight

    return Tables(spark, sf).lineitem.groupBy("l_linenumber").agg(F.round(F.avg(term_weight(F.col("l_quantity"), F.col("l_linenumber"), F.lit(4.0))), 6).alias("weight")).select("l_linenumber", F.round(idf(F.lit(7), F.col("l_linenumber")), 6).alias("idf"), "weight")


@query("SELECT event_id, greatest(least(60.0, pow(2.0, greatest(1, user_id % 10))), coalesce(CASE WHEN event_type = 'error' THEN value END, 0)) AS backoff FROM events")
def h22_backoff(spark, sf):
    return Tables(spark, sf).events.select("event_id", T.backoff_seconds(F.col("user_id") % 10, F.when(F.col("event_type") == "error", F.col("value"))).alias("backoff"))


@query("SELECT doc_id, CAST(ceil(n_chars / 3.0) AS BIGINT) AS tokens, CAST(CAST(ceil(n_chars / 3.0) AS BIGINT) * CAST(0.000002 AS DECIMAL(12,6)) AS DOUBLE) AS usd FROM documents")
def h23_estimate_usd(spark, sf):
    n = F.ceil(F.col("n_chars") / 3.0)
    return Tables(spark, sf).documents.select("doc_id", n.alias("tokens"), (n * F.lit("0.000002").cast("decimal(12,6)")).cast("double").alias("usd"))


@query("SELECT l_orderkey, f AS permutation FROM (SELECT l_orderkey, list_concat(a, list_filter(range(1, 8), lambda x: NOT list_contains(a, x))) AS f FROM (SELECT l_orderkey, list(n ORDER BY r, n) AS a FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, min(l_partkey) AS r FROM lineitem GROUP BY 1, 2) GROUP BY 1))")
def h24_parse_permutation(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("r", "n")))
    own = Tables(spark, sf).lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("r")).groupBy("l_orderkey").agg(rows.alias("rows"))
    answer = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["n"].cast("string")), "] > ["), F.lit("] > [99]"))
    return own.select("l_orderkey", T.parse_permutation(answer, F.lit(7)).cast("array<long>").alias("permutation"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS verdict, false AS equivalent FROM events")
def h25_parse_verdict(spark, sf):
    answer = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    inner = F.regexp_extract(answer, "(?s)```(?:json)?\\s*(.*?)\\s*```", 1)
    parsed = F.from_json(inner, "k long, equivalent boolean", {"mode": "PERMISSIVE"})
    return Tables(spark, sf).events.select("event_id", parsed.alias("p")).select("event_id", F.col("p.k").alias("verdict"), F.coalesce("p.equivalent", F.lit(False)).alias("equivalent"))


@query("""SELECT l_orderkey, len(ids) = 0 AS uncited, len(list_filter(ids, lambda x: x > 90)) > 0 AS unknown, len(list_distinct(ids)) < len(ids) AS duplicate FROM (SELECT l_orderkey, list(l_suppkey) AS ids FROM lineitem GROUP BY 1)""")
def h26_check_claims(spark, sf):
    own = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("ids"))
    return own.select("l_orderkey", (F.size("ids") == 0).alias("uncited"), F.exists("ids", lambda x: x > 90).alias("unknown"), (F.size(F.array_distinct("ids")) < F.size("ids")).alias("duplicate"))


@query(r"""WITH l AS (SELECT conv_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY turn) AS x FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN starts_with(right(x, 500), chr(10)) THEN right(x, 499) ELSE right(x, 500) END AS history FROM l""")
def h27_format_history(spark, sf):
    """The turns of each conversation, oldest first, cut from the front to 500 characters."""
    return T.format_history(Tables(spark, sf).conversations, "conv_id", "turn", "role", "text", 500)


@query("SELECT conv_id, left(trim(text), 40) AS title FROM conversations WHERE turn = 0")
def h28_chat_title(spark, sf):
    return Tables(spark, sf).conversations.where("turn = 0").select("conv_id", F.left(F.trim("text"), F.lit(40)).alias("title"))


@query("SELECT event_id, epoch_us(date_trunc('day', ts)) // 1000000 AS day_start, epoch_us(date_trunc('month', ts)) // 1000000 AS month_start, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def h29_dates(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return Tables(spark, sf).events.select("event_id", F.unix_seconds(F.date_trunc("day", ts)).alias("day_start"), F.unix_seconds(F.date_trunc("month", ts)).alias("month_start"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value, CAST(1 AS INTEGER) AS n_keys FROM events")
def h30_json_functions(spark, sf):
    return Tables(spark, sf).events.select("event_id", F.explode(F.from_json("props", "map<string,long>")).alias("key", "value"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query("SELECT n_regionkey, CASE WHEN len(x) = 1 THEN x[1] ELSE array_to_string(x[1 : len(x) - 1], ', ') || ' and ' || x[len(x)] END AS phrase FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS x FROM nation GROUP BY 1)")
def h31_list_in_words(spark, sf):
    own = Tables(spark, sf).nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("x"))
    phrase = F.when(F.size("x") == 1, F.element_at("x", 1)).otherwise(F.concat(F.array_join(F.slice("x", F.lit(1), F.size("x") - 1), ", "), F.lit(" and "), F.element_at("x", -1)))
    return own.select("n_regionkey", phrase.alias("phrase"))


@query(r"SELECT page_id, NOT (starts_with(p, '/') OR regexp_matches(p, '(^|/)\.\.(/|$)') OR contains(p, '\')) AS safe FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '../' || url ELSE url END AS p FROM pages)")
def h32_safe_member_path(spark, sf):
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("../"), F.col("url"))).otherwise(F.col("url"))
    return Tables(spark, sf).pages.select("page_id", (~(p.startswith("/") | p.rlike("(^|/)\\.\\.(/|$)") | F.contains(p, F.lit("\\")))).alias("safe"))


@query("SELECT page_id, CASE WHEN ends_with(regexp_extract(url, '^https?://([^/?#]+)', 1), '.example.com') THEN nullif(regexp_extract(url, '[?&]ref=([^&]*)', 1), '') END AS ref FROM pages")
def h33_host_checked_parameter(spark, sf):
    host = F.parse_url("url", F.lit("HOST"))
    return Tables(spark, sf).pages.select("page_id", F.when(F.endswith(host, F.lit(".example.com")), F.parse_url("url", F.lit("QUERY"), F.lit("ref"))).alias("ref"))


@query("SELECT vec_id, round(log2(1 + vec_id), 6) AS log2, round(sqrt(vec_id), 6) AS root, round(cos(vec_id), 6) AS cosine, round(sin(vec_id), 6) AS sine FROM embeddings")
def h34_math(spark, sf):
    v = F.col("vec_id")
    return Tables(spark, sf).embeddings.select("vec_id", F.round(F.log2(1 + v), 6).alias("log2"), F.round(F.sqrt(v), 6).alias("root"), F.round(F.cos(v), 6).alias("cosine"), F.round(F.sin(v), 6).alias("sine"))
