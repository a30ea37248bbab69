"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns REPLICAS places on a ring of CELLS cells; a row's id hashes to a cell, and the row
goes to the next place clockwise.  A shard takes rows up to its capacity: in rounds, every cell in
ring order offers its rows, in the order of (hash, id, text hash), to the place it has come to; what
a full shard cannot take continues clockwise to the next place of a shard that has room.  Without
slack the capacities are the row count divided by the number of shards, rounded up for the first
shards and down for the others, so that counts differ by one at most (the law `rows`).

Which rows a cell gives to which shard depends only on how many rows each cell has.  So the rows are
ranked by one range shuffle of their ids and hashes (texts are not moved), the counts of CELLS cells
are folded on the driver, and the resulting intervals of ranks are joined back by cell.  Everything
that is broadcast or folded has a size set by CELLS, REPLICAS and the number of shuffle partitions.
A cell of any size, such as one id that holds a third of all rows, is ranked over many tasks.

Defined results: a null id has one place on the ring like any other id; a null text has no bytes;
repeated rows are rows of their own; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import cut

CELL_BITS = 14
CELLS = 1 << CELL_BITS
REPLICAS = 128

Interval = tuple[int, int, int, int, int]  # cell, first rank, end rank, shard, slot of the first


def ring(shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(cell, shard) of all places in ring order; a place whose cell is taken moves to the next free one, so more shards leave earlier places alone."""
    if shards < 1 or shards * replicas > CELLS // 2:
        raise ValueError("the ring has no room for so many places")
    owner: dict[int, int] = {}
    for shard in range(shards):
        for k in range(replicas):
            cell = xxhash.xxh64_intdigest(f"{shard}:{k}") >> (64 - CELL_BITS)
            while cell in owner:
                cell = (cell + 1) % CELLS
            owner[cell] = shard
    return sorted(owner.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard may take: at most one apart, or with slack all that many times the mean."""
    if slack:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def intervals(counts: dict[int, int], shards: int, slack: float = 0.0) -> list[Interval]:
    """Which ranks of each cell go to which shard, and from which slot on."""
    places = ring(shards)
    cells, owner = [c for c, _ in places], [s for _, s in places]
    room, used, out = capacities(sum(counts.values()), shards, slack), [0] * shards, []
    waiting = [(c, 0, n, bisect_left(cells, c) % len(cells)) for c, n in sorted(counts.items()) if n]
    while waiting:
        left = []
        for cell, low, high, place in waiting:
            shard = owner[place]
            taken = min(room[shard], high - low)
            if taken:
                out.append((cell, low, low + taken, shard, used[shard]))
                used[shard] += taken
                room[shard] -= taken
            if low + taken < high:
                left.append((cell, low + taken, high, place))
        onward = _next_with_room(owner, room) if left else []
        waiting = [(cell, low, high, onward[place]) for cell, low, high, place in left]
    return out


def _next_with_room(owner: list[int], room: list[int]) -> list[int]:
    """For each place the next one clockwise whose shard has room."""
    onward, ahead = [0] * len(owner), 0
    for k in range(2 * len(owner) - 1, -1, -1):
        place = k % len(owner)
        onward[place] = ahead
        if room[owner[place]]:
            ahead = place
    return onward


def shards(docs: DataFrame, n: int = 8, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    place = F.xxhash64(F.col(doc_id).cast("string"))
    # the last key tells rows apart that are equal in all others, so that a hot row is split over tasks
    rows = cut(docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int").alias("cell"), place.alias("place"), F.xxhash64(text).alias("content"), F.monotonically_increasing_id().alias("row"),
    ), "rows")
    order = ["cell", "place", "doc_id", "content", "row"]
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    ranked = cut(ranked.select("doc_id", "size", "text_crc32", "cell", F.shiftright("seq", 33).cast("int").alias("part"), F.col("seq").bitwiseAND((1 << 33) - 1).alias("at")), "ranked")
    found = spark.createDataFrame(_stretches(ranked, n, slack), "cell int, part int, first long, end long, shard int, shift long")
    spans = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("end"))
    joined = ranked.alias("r").join(F.broadcast(found).alias("f"), (F.col("r.cell") == F.col("f.cell")) & (F.col("r.part") == F.col("f.part")) & spans)
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))


def _stretches(ranked: DataFrame, n: int, slack: float) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, part, first, end, shard, shift): rows of a sorted part from first to end - 1 go to the shard, at their number plus shift.

    A part is one partition of the range shuffle and a cell is in few of them: the list has at most a
    row for each cell, each part and each interval.
    """
    by_cell = defaultdict(list)
    for r in ranked.groupBy("cell", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect():
        by_cell[r["cell"]].append((r["part"], r["first"], r["n"]))
    owned = defaultdict(list)
    for cell, low, high, shard, slot in intervals({c: sum(x[2] for x in parts) for c, parts in by_cell.items()}, n, slack):
        owned[cell].append((low, high, shard, slot))
    out = []
    for cell, parts in by_cell.items():
        before = 0
        for part, first, rows in sorted(parts):
            for low, high, shard, slot in owned[cell]:
                a, b = max(low, before), min(high, before + rows)
                if a < b:
                    shift = first - before
                    out.append((cell, part, a + shift, b + shift, shard, slot - low - shift))
            before += rows
    return out


def contract(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
