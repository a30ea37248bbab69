"""Resolution of source records to papers in arrival order, as joins instead of one record after another.

A record joins the paper that owns its identifiers, or the one paper with its title and compatible
metadata, or founds a paper.  What it does depends on earlier records only, so the outcome of all
records is the one fixed point of deciding() over a guess of it: every round decides all records
against the last round's outcome, in a few joins, and a record is right as soon as those it depends
on are.  To keep rounds few, chains of owners are shortened between them, and the title step only
looks at sure founders: of those that found no paper of their title, one for each title, year and
first author is made sure in a round, so that the others may join it in the next.  In the last round
every founder is sure and nothing changes.  Records equal in everything but id and arrival are one
source record: later ones get the outcome of the first.

Each table that a hot key is looked up in has one row for the key and is written first, so that
Spark can split the other side.  The title step compares records without a known identifier with the
papers (not the records) that share their title and an author, or have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import scratch

# Namespaces whose identifiers name a work, in its published and its preprint form.
STRONG = ("doi", "arxiv")

#: Columns of records: `at` is any type with an order and tells all records apart.
RECORD = ("id", "at", "keys", "title_key", "year", "authors")


def _cut(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ns(keys: Column) -> Column:
    return F.transform(keys, lambda k: k["ns"])


def _compatible_years(paper_year: Column, year: Column) -> Column:
    return paper_year.isNull() | year.isNull() | (paper_year == year)


def deciding(records: DataFrame, state: DataFrame) -> DataFrame:
    """Each record's outcome (id, paper, how, one, other, tie) if earlier records had the outcome in state (id, paper, sure; null paper: conflict)."""
    members = _cut(records.join(state.where("paper is not null").select("id", "paper"), "id"))
    owners = _cut(members.select("at", "paper", F.explode("keys").alias("k")).groupBy("k.ns", "k.value").agg(F.min_by("paper", "at").alias("paper"), F.min("at").alias("since")))
    first = lambda ok, value=None: F.min(F.when(ok, F.col("at"))) if value is None else F.min_by(value, F.when(ok, F.col("at")))
    facts = members.groupBy("paper").agg(
        first(F.col("year").isNotNull()).alias("year_since"), first(F.col("year").isNotNull(), "year").alias("paper_year"), first(F.size("authors") > 0).alias("authors_since"),
        *[first(F.array_contains(_ns(F.col("keys")), s)).alias(f"{s}_since") for s in STRONG],
    )
    founders = records.join(state.select("id", "sure"), "id").select(F.col("id").alias("paper"), F.col("title_key").alias("paper_title"), F.col("at").alias("founded"), "sure")
    papers = _cut(facts.join(founders, "paper"))
    names = _cut(members.select("at", "paper", F.explode("authors").alias("author")).groupBy("paper", "author").agg(F.min("at").alias("since")))

    asked = records.select("id", "at", F.explode("keys").alias("k")).select("id", "at", "k.ns", "k.value")
    roots = asked.join(owners, ["ns", "value"]).where("since < at").groupBy("id").agg(F.min("paper").alias("paper"), F.max("paper").alias("last"))
    known = _cut(records.join(roots, "id"))

    torn = known.where("paper <> last")
    strong = F.arrays_overlap(_ns(F.col("keys")), F.array(*map(F.lit, STRONG)))
    torn = torn.select("id", F.lit(None).cast("long").alias("paper"), F.when(strong, "contradictory_strong_ids").otherwise("contradictory_identifiers").alias("how"), F.col("paper").alias("one"), F.col("last").alias("other"), F.lit(False).alias("tie"))

    single = known.where("paper = last").join(papers, "paper")
    shared = single.select("id", "at", "paper", F.explode("authors").alias("author")).join(names, ["paper", "author"]).where("since < at").select("id").distinct()
    single = single.join(shared.withColumn("shares", F.lit(True)), "id", "left")
    unnamed = (F.size("authors") == 0) | F.col("authors_since").isNull() | (F.col("authors_since") >= F.col("at"))
    year_then = F.when(F.col("year_since") < F.col("at"), F.col("paper_year"))
    fits = F.col("title_key").eqNullSafe(F.col("paper_title")) & _compatible_years(year_then, F.col("year")) & (unnamed | F.coalesce("shares", F.lit(False)))
    single = single.select("id", F.when(fits, F.col("paper")).alias("paper"), F.when(fits, "joined").otherwise("incompatible_metadata").alias("how"), F.when(~fits, F.col("paper")).alias("one"), F.lit(None).cast("long").alias("other"), F.lit(False).alias("tie"))

    strays = _cut(records.join(known.select("id"), "id", "left_anti"))
    return torn.unionByName(single).unionByName(_by_title(strays, papers, names))


def _by_title(strays: DataFrame, papers: DataFrame, names: DataFrame) -> DataFrame:
    """Records without a known identifier: joined to the one best paper of their title, or founders."""
    titled = papers.withColumnRenamed("paper_title", "title_key").where("sure and title_key <> ''")
    then = lambda c: F.col(c).isNotNull() & (F.col(c) < F.col("at"))
    shared = strays.select("id", "at", "title_key", F.explode("authors").alias("author")).join(names.join(titled.select("paper", "title_key"), "paper"), ["title_key", "author"]).where("since < at")
    shared = shared.groupBy("id", "paper").agg(F.count("*").alias("overlap"))
    with_authors = strays.join(shared, "id").join(titled.drop("title_key"), "paper")
    without = strays.join(titled, "title_key").where((F.col("founded") < F.col("at")) & ((F.size("authors") == 0) | ~then("authors_since"))).withColumn("overlap", F.lit(0).cast("long"))
    theirs = F.filter(F.array(*[F.when(then(f"{s}_since"), F.lit(s)) for s in STRONG]), lambda x: x.isNotNull())
    own = F.array_intersect(_ns(F.col("keys")), F.array(*map(F.lit, STRONG)))
    crossing = (F.size(theirs) == 1) & (F.size(own) == 1) & ~F.arrays_overlap(theirs, own)
    fits = crossing | _compatible_years(F.when(then("year_since"), F.col("paper_year")), F.col("year"))
    cols = ["id", "paper", "overlap"]
    pairs = with_authors.where(fits).select(*cols).union(without.where(fits).select(*cols))
    best = pairs.groupBy("id", "overlap").agg(F.count("*").alias("n"), F.min("paper").alias("paper")).groupBy("id").agg(F.max(F.struct("overlap", "n", "paper")).alias("b"))
    best = best.select("id", F.when(F.col("b.n") == 1, F.col("b.paper")).alias("paper"), (F.col("b.n") > 1).alias("tie"))
    none = F.lit(None).cast("long")
    return strays.select("id").join(best, "id", "left").select("id", F.coalesce("paper", "id").alias("paper"), F.when(F.col("paper").isNull(), "created").otherwise("joined_by_title").alias("how"), none.alias("one"), none.alias("other"), F.coalesce("tie", F.lit(False)).alias("tie"))


def _next_state(records: DataFrame, found: DataFrame, state: DataFrame) -> DataFrame:
    """The outcome with owners of owners looked through, and with more sure founders: those without title, with several equal papers, and one of each title, year and first author."""
    onward = found.select(F.col("id").alias("paper"), F.col("paper").alias("next"))
    made = found.where("how = 'created'").join(state.select("id", F.col("sure").alias("was")), "id").join(records.select("id", "at", "title_key", "year", F.array_min("authors").alias("author")), "id")
    open_ = made.where("not was and not tie and title_key <> ''").groupBy("title_key", "year", "author").agg(F.min_by("id", "at").alias("id"))
    sure = made.where("was or tie or title_key is null or title_key = ''").select("id").union(open_.select("id")).withColumn("sure", F.lit(True))
    short = found.join(onward, "paper", "left").select("id", F.when(F.col("paper").isNotNull(), F.coalesce("next", "paper")).alias("paper"), "how", "one", "other")
    return short.join(sure, "id", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))


def source_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of each group of records with equal content, and (id, first) of all."""
    content = F.sha2(F.to_json(F.struct("keys", "title_key", "year", "authors")), 256)
    rows = _cut(records.select(*RECORD, content.alias("content")))
    first = _cut(rows.groupBy("content").agg(F.min_by("id", "at").alias("first")))
    pointers = _cut(rows.select("id", "content").join(first, "content").select("id", "first"))
    return _cut(rows.join(pointers.where("id = first").select("id"), "id").select(*RECORD)), pointers


def resolve(records: DataFrame) -> DataFrame:
    """(id, paper, how, one, other): the paper's id is its founder's; conflicts have no paper but the one or two that they collide with.

    how: created, joined (by an identifier), joined_by_title, contradictory_strong_ids,
    contradictory_identifiers or incompatible_metadata; a replay has what its first record has, and
    a founder's replay has joined.  Records without title only meet by identifiers; null arrays
    are empty, identifiers with a null part are left out.
    """
    clean = records.withColumn("keys", F.array_distinct(F.filter(F.coalesce("keys", F.array()), lambda k: k["ns"].isNotNull() & k["value"].isNotNull()))).withColumn("authors", F.array_distinct(F.array_compact(F.coalesce("authors", F.array().cast("array<string>")))))
    first, pointers = source_records(clean)
    none = F.lit(None).cast("long")
    state = first.select("id", F.col("id").alias("paper"), F.lit("created").alias("how"), none.alias("one"), none.alias("other"), F.lit(False).alias("sure"))
    while True:
        found = _cut(deciding(first, state))
        moved = found.alias("f").join(state.alias("s"), "id").where("not (f.paper <=> s.paper and f.how <=> s.how and f.one <=> s.one and f.other <=> s.other) or (f.how = 'created' and not s.sure)")
        if moved.isEmpty():
            break
        state = _cut(_next_state(first, found, state))
    named = found.withColumnRenamed("id", "first")
    replay = (F.col("id") != F.col("first")) & (F.col("how") == "created")
    return pointers.join(named, "first").select("id", "paper", F.when(replay, "joined").otherwise(F.col("how")).alias("how"), "one", "other")


def conflicts(resolved: DataFrame) -> DataFrame:
    """The review table: a row for each record that no paper took, keyed by what makes it unique."""
    return resolved.where("paper is null").select(F.col("id").alias("record"), F.col("how").alias("reason"), "one", "other")
