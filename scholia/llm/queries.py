"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import branchmerge, chunks, decontaminate, licenses, mixing, neardup, pieces, quality, sharding, suffixes, tokenfiles, toxicity, whitening
from .textkit import held_out_column, read, small_batches


def op1_neardup(spark, sf_dir):
    small_batches(spark)
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).drop("h1", "h2")


def op2_chunks(spark, sf_dir):
    small_batches(spark)
    found = chunks.substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_chunks", "n_copied", "n_removed", "n_runs", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark, sf_dir):
    small_batches(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels))
    return scored.withColumn("held_out", held_out_column("doc_id", 4, 2)).withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op4_tokens(spark, sf_dir):
    import public_tokenizers

    small_batches(spark)
    folder = tokenfiles.new_folder(spark)
    files = tokenfiles.write_token_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_token_files(spark, folder, files, with_ids=False).drop("ids")


def op5_suffixes(spark, sf_dir):
    small_batches(spark)
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op6_mixing(spark, sf_dir):
    small_batches(spark)
    return mixing.score_documents(read(spark, sf_dir, "documents"))


def op7_pieces(spark, sf_dir):
    import public_tokenizers

    small_batches(spark)
    return pieces.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).drop("ids")


def op8_licenses(spark, sf_dir):
    small_batches(spark)
    return licenses.contract(licenses.license_scan(read(spark, sf_dir, "documents")))


def op9_decontaminate(spark, sf_dir):
    small_batches(spark)
    return decontaminate.contract(decontaminate.find_windows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op10_quality(spark, sf_dir):
    small_batches(spark)
    return quality.quality_rules(read(spark, sf_dir, "documents")).drop("repeat_spans")


def op11_merge(spark, sf_dir):
    return branchmerge.contract(branchmerge.merge_branches(read(spark, sf_dir, "documents")))


def op12_whitening(spark, sf_dir):
    small_batches(spark, 4096)
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op13_sharding(spark, sf_dir):
    return sharding.contract(sharding.shards(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_neardup, op2_chunks, op3_toxicity, op4_tokens, op5_suffixes, op6_mixing, op7_pieces, op8_licenses, op9_decontaminate, op10_quality, op11_merge, op12_whitening, op13_sharding)}

ORACLE_SQL = {
    "op9_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
