"""Entity resolution: aliases, candidates, connected components, merges and root following."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import scratch


def document_aliases(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = 60) -> DataFrame:
    """(id, ns, v): the digest of the whole text and that of its lower-cased head."""
    whole = F.struct(F.lit("text").alias("ns"), F.md5(F.col(text).cast("binary")).alias("v"))
    start = F.struct(F.lit("head").alias("ns"), F.md5(F.substring(F.lower(text), 1, head).cast("binary")).alias("v"))
    return docs.select(F.col(key).alias("id"), F.explode(F.array(whole, start)).alias("a")).select("id", "a.ns", "a.v")


#: Records of more authors than this are compared pair by pair instead of by the subsets of their authors.
SUBSETS_OF = 6


def _cut(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _around(rows: DataFrame, *keys: str) -> DataFrame:
    """(id, g, n, x): for each of the rows (id, keys, year, g) the number n of rows with its keys and a year at most one apart, itself among them, and the exclusive or x of their ids; a null year is near every year.

    Counts are brought to the years around them and looked up once; both sides of that join are
    written tables or scans, as large as they come, and neither is broadcast.
    """
    at = lambda year: F.struct(year.isNull().alias("any"), F.coalesce(year, F.lit(0).cast("long")).alias("y")).alias("at")
    year = F.col("year")
    counts = _cut(rows.groupBy(*keys, "year").agg(F.count("*").alias("n"), F.bit_xor("id").alias("x")))
    spread = F.array_union(F.when(year.isNull(), F.array().cast("array<long>")).otherwise(F.array(year - 1, year, year + 1)), F.array(F.lit(None).cast("long")))
    near = _cut(counts.select(*keys, F.explode(spread).alias("to"), "n", "x").groupBy(*keys, at(F.col("to"))).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x")))
    found = rows.select("id", *keys, at(year)).join(near.hint("merge"), [*keys, "at"]).select("id", "g", "n", "x")
    undated = counts.where(year.isNull()).drop("year")
    if undated.isEmpty():
        return found
    return found.unionByName(rows.where(year.isNotNull()).select("id", *keys).join(undated.hint("merge"), list(keys)).select("id", "g", "n", "x"))


def near_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, x): for each (id, key, year, groups of (tag, members)) the records of another id with its key, a year at most one apart and a group of its own.

    A record counts once for each group that both have; x is the exclusive or of their ids, so the
    one id where n is 1.  Nothing is paired: records are counted by (key, group, year), looked up
    by the same, and what the id itself has there is taken off: of an id that stands once, the
    record; of others what is counted by id.  A null year is near every year.
    """
    own = records.where("key is not null and id is not null").withColumn("year", F.col("year").cast("long"))
    records = _cut(own.select("id", "key", "year", "groups"))
    each = lambda rows: rows.select("id", "key", "year", F.explode("groups").alias("g"))
    near = _around(each(records), "key", "g")
    twice = _cut(records.groupBy("id").count().where("count > 1").select("id"))
    if twice.isEmpty():
        near = near.select("id", "g", (F.col("n") - 1).alias("n"), F.col("x").bitwiseXOR(F.col("id")).alias("x"))
    else:
        once = each(records.join(twice.hint("merge"), "id", "left_anti")).select("id", "g", F.lit(-1).cast("long").alias("n"), F.col("id").alias("x"))
        itself = _around(each(records.join(twice.hint("merge"), "id", "left_semi")), "id", "key", "g").select("id", "g", (-F.col("n")).alias("n"), "x")
        near = near.unionByName(once).unionByName(itself)
    return near.select("id", "g.tag", "n", "x").groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))


def _subsets(members: Column) -> Column:
    """All subsets of a sorted array but the empty one, as (tag: size, members)."""
    grown = F.aggregate(members, F.array(F.array().cast("array<string>")), lambda s, m: F.concat(s, F.transform(s, lambda x: F.concat(x, F.array(m)))))
    return F.transform(F.filter(grown, lambda x: F.size(x) > 0), lambda x: F.struct(F.size(x).alias("tag"), x.alias("members")))


def title_candidates(records: DataFrame) -> DataFrame:
    """For each (id, key, year, authors): the one record with the same key, a year at most one apart and most shared authors; none on a tie.

    Ids are integers.  Records that share a key are not paired: those that hold a subset of a
    record's authors are counted, and those that share most hold exactly one subset of that size.
    Only pairs with a record of more than SUBSETS_OF authors are joined, by the authors they share.
    """
    known = records.select(F.col("id").cast("long").alias("id"), "key", "year", F.array_sort(F.array_compact(F.array_distinct(F.col("authors").cast("array<string>")))).alias("authors")).where("size(authors) > 0")
    few = F.size("authors") <= SUBSETS_OF
    # a small file of many records is one task, so they are spread before subsets are made
    near = near_counts(known.where(few).repartition("id").select("id", "key", "year", _subsets(F.col("authors")).alias("groups")), ["id", "tag"]).where("n > 0").withColumnRenamed("tag", "overlap")
    every, several = near, known.where(~few)
    if not several.isEmpty():
        one, two = known.withColumn("row", F.monotonically_increasing_id()), several.withColumn("row", F.monotonically_increasing_id())
        a = one.select("id", "key", "year", "row", few.alias("few"), F.explode("authors").alias("author"))
        b = two.select(F.col("id").alias("cand"), "key", F.col("year").alias("other"), F.col("row").alias("at"), F.explode("authors").alias("author"))
        years = F.col("year").isNull() | F.col("other").isNull() | (F.abs(F.col("year") - F.col("other")) <= 1)
        shared = a.join(b.hint("merge"), ["key", "author"]).where((F.col("id") != F.col("cand")) & years).groupBy("row", "at", "id", "cand", "few").agg(F.count("*").cast("int").alias("overlap"))
        # a pair of a short and a long record counts for both, one of two long ones stands here both ways
        long = shared.select("id", "cand", "overlap").unionByName(shared.where("few").select(F.col("cand").alias("id"), F.col("id").alias("cand"), "overlap"))
        every = near.unionByName(long.groupBy("id", "overlap").agg(F.count("*").alias("n"), F.bit_xor("cand").alias("x")))
    levels = every.groupBy("id", "overlap").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))
    most = levels.groupBy("id").agg(F.max(F.struct("overlap", "n", "x")).alias("m"))
    return most.select("id", "m.overlap", F.when(F.col("m.n") == 1, F.col("m.x")).alias("best"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the least id reachable over edges (u, v); nodes (id) without edges are their own root.

    Minimum labels with pointer jumping; each round is written to the shared folder, so lineage stays
    short and a lost executor costs one round.
    """
    cut = _cut
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = cut(labels.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")))
        if not step.where("root <> old").limit(1).count():
            return labels
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        labels = cut(step.join(jump, "root", "left").select("id", F.least("root", F.coalesce("next", "root")).alias("root")))


def alias_edges(aliases: DataFrame) -> DataFrame:
    """Star edges (u, v) from each alias's least id to its other holders: linear in the aliases."""
    owner = aliases.groupBy("ns", "v").agg(F.min("id").alias("u"))
    return aliases.join(owner, ["ns", "v"]).where("id <> u").select("u", F.col("id").alias("v"))


def follow_roots(redirects: DataFrame, depth: int = 32) -> DataFrame:
    """(id, root, hops) along redirects (id, target); a chain longer than depth, or a cycle, ends there with null root."""
    step = redirects.select("id", F.col("target").alias("root"), F.lit(1).alias("hops"))
    jumps = redirects.select(F.col("id").alias("root"), F.col("target").alias("next"))
    out = step
    for _ in range(depth):
        out = out.join(jumps, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
        if not out.join(jumps, "root", "left_semi").limit(1).count():
            return out
    return out.withColumn("root", F.when(F.col("hops") < depth, F.col("root")))


def first_non_null(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each column the first value that is not null in arrival order."""
    return rows.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
