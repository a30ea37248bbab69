"""Follow-up questions: pairs of one paper that share a name, and the rules that a rewritten second question must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import scratch

# What counts as a word, and words of titles that name nothing.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-\.]*[A-Za-z0-9]|[A-Za-z0-9]"
STOP = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "through", "to", "toward", "towards", "using", "via", "with", "without")


def words_of(text: Column) -> Column:
    """All words, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def marked(text: Column) -> Column:
    """Distinct words that name something: two capitals, a digit or a hyphen in them."""
    named = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike("[A-Z].*[A-Z]|[0-9]|-"))
    return F.array_distinct(F.transform(named, lambda t: F.lower(t)))


def shared_names(first: Column, second: Column) -> Column:
    """Names of the second question that the first has too."""
    return F.array_intersect(marked(second), words_of(first))


def distinctive_terms(title: Column, first: Column, second: Column) -> Column:
    """What names the paper: its title's names, and those that the questions share."""
    return F.array_union(marked(title), shared_names(first, second))


def _bigrams(words: Column) -> Column:
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.concat_ws(" ", F.element_at(words, k), F.element_at(words, k + 1)))


def leaks(rewrite: Column, terms: Column, title: Column) -> Column:
    """Whether a rewrite still names the paper: one of the terms, or two words that follow one another in the title's content."""
    content = F.filter(words_of(title), lambda t: ~t.isin(*STOP) & (F.length(t) > 2))
    return F.arrays_overlap(words_of(rewrite), terms) | F.arrays_overlap(_bigrams(words_of(rewrite)), _bigrams(content))


def drops_subject(rewrite: Column, first: Column, second: Column) -> Column:
    """Whether a rewrite lost a name of the second question that the first does not have; one character is no name of its own."""
    own = F.filter(F.array_except(marked(second), words_of(first)), lambda t: F.length(t) > 1)
    return F.size(F.array_except(own, words_of(rewrite))) > 0


def draw(seed: int, item: Column) -> Column:
    """The place of an item in the seeded order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), item.cast("string")).cast("binary"), 256)


def pairs_sharing_names(questions: DataFrame, seed: int) -> DataFrame:
    """(paper, first, second): of each paper (paper, id, text) one pair whose second question has a name from the first.

    The second is the first in the seeded order of all that share a name with another question, the
    first the first in that order of those it shares one with.  Papers without pairs have no row,
    repeated rows are one question.  Only sums of a paper's words are shuffled: their least and
    greatest places (60 bits of the order, 64 of the id's hash, which tell whether two questions hold
    a word), so partial aggregation takes the common words; then one question of each paper meets the others.
    """
    keyed = questions.where("paper is not null and id is not null and text is not null").select("paper", "id", "text", draw(seed, F.col("id")).alias("key"))
    placed = keyed.withColumn("place", F.conv(F.substring("key", 1, 15), 16, 10).cast("long"))
    words = placed.select("paper", "place", F.xxhash64("id").alias("h"), marked(F.col("text")).alias("names"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    named = F.when(F.array_contains("names", F.col("term")), F.col("place"))
    ends = [F.min("place").alias("p0"), F.max("place").alias("p1"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("named").alias("named")]
    shared = words.select("paper", "term", "place", "h", named.alias("named")).groupBy("paper", "term").agg(*ends).where("named is not null and (p0 <> p1 or h0 <> h1)")
    spark = questions.sparkSession
    path, places = scratch(spark), scratch(spark)
    shared.groupBy("paper").agg(F.min("named").alias("place")).write.parquet(places)  # its size is known to the join then
    second = placed.join(spark.read.parquet(places), ["paper", "place"])
    second = second.groupBy("paper").agg(F.min(F.struct("key", "id", marked(F.col("text")).alias("names"))).alias("b"))
    second.select("paper", F.col("b.id").alias("second"), F.col("b.names").alias("names")).write.parquet(path)
    others = keyed.join(spark.read.parquet(path), "paper").where(F.arrays_overlap(words_of(F.col("text")), F.col("names")) & (F.col("id") != F.col("second")))
    chosen = others.groupBy("paper", "second").agg(F.min(F.struct("key", "id")).alias("b"))
    return chosen.select("paper", F.col("b.id").alias("first"), "second")


def split_pairs(pairs: DataFrame, seed: int, development: int, frozen: int) -> DataFrame:
    """The first pairs of the seeded order of papers are development, the next frozen; the others are left out."""
    first = pairs.withColumn("key", draw(seed, F.col("paper"))).orderBy("key", "paper").limit(development + frozen)
    place = F.row_number().over(Window.orderBy("key", "paper"))  # of as many rows as the two splits have
    return first.withColumn("split", F.when(place <= development, "development").otherwise("frozen")).drop("key")


def kept(conversations: DataFrame, followup: str = "followup") -> DataFrame:
    """Conversations (title, first, second and the follow-up) with whether the follow-up is usable, and why not."""
    own = [F.col(c) for c in (followup, "title", "first", "second")]
    rewrite, title, first, second = own
    problem = F.when(F.coalesce(F.trim(rewrite), F.lit("")) == "", "empty").when(leaks(rewrite, distinctive_terms(title, first, second), title), "leaks").when(drops_subject(rewrite, first, second), "drops_subject")
    return conversations.withColumn("problem", problem)


def register(conversations: DataFrame, path: str, followup: str = "followup") -> None:
    """Write what is scored later: ids and split, each with the digest of its follow-up."""
    conversations.select("conversation_id", "split", F.sha2(F.col(followup).cast("binary"), 256).alias("rewrite_sha256")).write.parquet(path)


def read_registered(registered: DataFrame, texts: DataFrame, split: str, followup: str = "followup") -> DataFrame:
    """The texts of a split's conversations; a missing or changed one is an error as it is read."""
    wanted = registered.where(F.col("split") == split).select("conversation_id", "rewrite_sha256")
    joined = wanted.join(texts, "conversation_id", "left")
    there = F.assert_true(F.col(followup).isNotNull(), F.concat(F.lit("conversation_text_missing:"), F.col("conversation_id").cast("string")))
    same = F.assert_true(F.sha2(F.col(followup).cast("binary"), 256) == F.col("rewrite_sha256"), F.concat(F.lit("conversation_text_changed:"), F.col("conversation_id").cast("string")))
    return joined.where(F.coalesce(there.cast("string"), same.cast("string"), F.lit("")) == "").drop("rewrite_sha256")
