"""Projections, filters and predicates (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from .registry import Tables, query


def _year():
    return F.year("o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) <= 1998 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' AND NOT (o_totalprice < 1000)")
def b1_payload_filter(spark, sf):
    keep = rules.payload_filter(_year(), F.col("o_orderpriority"), 1996, 1998, ["1-URGENT", " 2-HIGH ", ""], [F.col("o_orderstatus") == "F", ~(F.col("o_totalprice") < 1000)])
    return Tables(spark, sf).orders.where(keep).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1997")
def b2_open_bound_filter(spark, sf):
    return Tables(spark, sf).orders.where(rules.payload_filter(_year(), F.col("o_orderpriority"), low=1997)).select("o_orderkey")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'fr') AND l.quality = 1")
def b3_evidence_filter(spark, sf):
    t = Tables(spark, sf)
    return t.documents.join(t.labels, "doc_id").where(F.col("lang").isin("en", "fr") & (F.col("quality") == 1)).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND source <> 'src0'")
def b4_chunk_filter(spark, sf):
    t = Tables(spark, sf)
    return t.documents.where("source <> 'src0'").join(t.labels.where("toxic = 0"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT o_orderkey, coalesce(o_orderstatus = 'F' AND o_totalprice > 0 AND year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT', false) AS eligible FROM orders")
def b5_is_eligible(spark, sf):
    ok = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0) & (_year() == 1997) & (F.col("o_orderpriority") == "1-URGENT")
    return Tables(spark, sf).orders.select("o_orderkey", F.coalesce(ok, F.lit(False)).alias("eligible"))


#: Labels, and by hand what the rules must make of them.
TRACKS = {
    "ICX 2024  Poster": ("main", "accepted"), "Submitted to ICX 2024": ("main", "under_review"), "ICX 2024 Workshop on Things Poster": ("workshop", "accepted"),
    "Findings of the Association": ("findings", "accepted"), "Proceedings of the Workshop on X": ("workshop", "accepted"), "Shared Task Overview": ("shared_task", "accepted"),
    "Industry Track Papers": ("industry", "accepted"), "System Demonstrations": ("demo", "accepted"), "Tutorial Abstracts": ("tutorial", "accepted"), "main": ("main", "accepted"), "Main volume": ("other", "accepted"),
    "Proceedings of the 61st Annual Meeting of the Association for Computational Linguistics (Volume 1: Long Papers)": ("main", "accepted"),
    "Proceedings of the 2023 Conference on Empirical Methods in Natural Language Processing": ("main", "accepted"),
    "Proceedings of the 2023 Conference on Empirical Methods": ("other", "accepted"), "": ("unknown", "unknown"), "notable top 5%": ("main", "accepted"), "Accept (findings)": ("findings", "accepted"),
}
DECISIONS = {
    "Accept (Oral)": ("accepted", "oral"), "Desk_Rejected": ("desk_rejected", None), "Reject": ("rejected", None), "Withdrawn submission": ("withdrawn", None), "ICX 2024 poster": ("accepted", "poster"),
    "notable spotlight or oral": ("accepted", "oral"), "Under Review": ("under_review", None), "pending": ("under_review", None), "": ("unknown", None), "main": ("unknown", None), "Rejected after desk check": ("desk_rejected", None),
}


def _table(values: dict[str, tuple], *names: str) -> str:
    """SQL for a table of labels, numbered, with what the model makes of each, as stated by hand."""
    rows = ", ".join(f"({k}, {', '.join('NULL' if v is None else repr(v) for v in own)})" for k, own in enumerate(values.values()))
    return f"(VALUES {rows}) AS expected(n, {', '.join(names)})"


def _numbered_label(t, values: dict[str, tuple]):
    return t.events.select("event_id", F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("event_id") % len(values) + 1).cast("int")).alias("label"))


@query(f"SELECT event_id, track, decision FROM events JOIN {_table(TRACKS, 'track', 'decision')} ON event_id % {len(TRACKS)} = n")
def b6_classify_track(spark, sf):
    return _numbered_label(Tables(spark, sf), TRACKS).select("event_id", rules.classify_track(F.col("label")).alias("c")).select("event_id", "c.track", "c.decision")


@query(f"SELECT event_id, decision, presentation FROM events JOIN {_table(DECISIONS, 'decision', 'presentation')} ON event_id % {len(DECISIONS)} = n")
def b7_presentation_type(spark, sf):
    own = _numbered_label(Tables(spark, sf), DECISIONS)
    return own.select("event_id", rules.normalize_decision(F.col("label")).alias("decision"), rules.presentation_type(F.col("label")).alias("presentation"))


@query(f"SELECT event_id FROM events JOIN {_table(TRACKS, 'track', 'decision')} ON event_id % {len(TRACKS)} = n WHERE track = 'main' AND decision = 'accepted'")
def b8_eligible_rows(spark, sf):
    c = rules.classify_track(F.col("label"))
    return _numbered_label(Tables(spark, sf), TRACKS).where((c["track"] == "main") & (c["decision"] == "accepted")).select("event_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.source IS DISTINCT FROM 'src0' AND l.quality IS NOT DISTINCT FROM 1")
def b9_public_export_rows(spark, sf):
    t = Tables(spark, sf)
    keep = ~F.col("source").eqNullSafe("src0") & F.col("quality").eqNullSafe(1)
    return t.documents.join(t.labels, "doc_id", "left").where(keep).select("doc_id")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(head, '^(?i:appendix)\b') THEN false WHEN regexp_matches(head, '^(?i:references|bibliography)\b') THEN true ELSE regexp_matches(head, '\((?:19|20)[0-9]{2}\)|\[[0-9]+\]') END AS misread
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS head FROM documents)""")
def b10_misread_reference(spark, sf):
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    rule = F.when(head.rlike("^(?i:appendix)\\b"), False).when(head.rlike("^(?i:references|bibliography)\\b"), True).otherwise(head.rlike("\\((?:19|20)[0-9]{2}\\)|\\[[0-9]+\\]"))
    return Tables(spark, sf).documents.select("doc_id", rule.alias("misread"))


@query(r"SELECT p_partkey, regexp_matches(trim('Proceedings of the ' || p_name), '^Proceedings of the\b') AND p_type = 'SMALL' AS volume FROM part")
def b11_proceedings_volume(spark, sf):
    title, abstract = F.concat(F.lit("Proceedings of the "), F.col("p_name")), F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    return Tables(spark, sf).part.select("p_partkey", (F.trim(title).rlike("^Proceedings of the\\b") & (F.coalesce(F.trim(abstract), F.lit("")) == "")).alias("volume"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\blicensed? under\b') AND NOT regexp_matches(text, '(?i)\bcc by\b')")
def b12_regex_candidates(spark, sf):
    return Tables(spark, sf).documents.where(F.col("text").rlike("(?i)\\blicensed? under\\b") & ~F.col("text").rlike("(?i)\\bcc by\\b")).select("doc_id")


@query("SELECT o_orderkey AS query_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')")
def b13_select_queries(spark, sf):
    t = Tables(spark, sf)
    positive = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus <> 'P'").join(positive, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("query_id"))


@query("SELECT event_id, value FROM events WHERE event_type = 'view'")
def b14_text_slice(spark, sf):
    return Tables(spark, sf).events.where("event_type = 'view'").select("event_id", "value")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'small')")
def b15_match_all_words(spark, sf):
    words = F.split(F.lower(F.trim(F.lit(" Ring  SMALL "))), "\\s+")
    return Tables(spark, sf).part.where(F.forall(words, lambda w: F.contains(F.lower("p_name"), w))).select("p_partkey")


@query("SELECT p_size, list_sort(list(DISTINCT p_brand)) AS brands, list_sort(list(DISTINCT p_type)) AS types FROM part WHERE p_retailprice >= 950 GROUP BY p_size")
def b16_facets(spark, sf):
    return Tables(spark, sf).part.where("p_retailprice >= 950").groupBy("p_size").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"), F.sort_array(F.collect_set("p_type")).alias("types"))


@query("SELECT event_id, value FROM events WHERE value > 25.0")
def b17_score_floor(spark, sf):
    return Tables(spark, sf).events.where(rules.above_floor(F.col("value"), 25.0)).select("event_id", "value")


@query("""SELECT event_id, list_filter([CASE WHEN value >= 1 THEN NULL ELSE 'value' END, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE 'type' END, CASE WHEN user_id IS NOT NULL THEN NULL ELSE 'user' END], lambda x: x IS NOT NULL) AS problems FROM events""")
def b18_validate_records(spark, sf):
    checks = [("value", F.col("value") >= 1), ("type", F.col("event_type").isin("view", "click")), ("user", F.col("user_id").isNotNull())]
    return Tables(spark, sf).events.select("event_id", rules.problems(checks).alias("problems"))
