"""Three-way merge of two branches by a uniform cell model.

A version of a table is a set of cells (path, value).  A path is a row's key, a kind and a name: the
row itself, one of its columns, one of its lines, or the gap after a line, into which a branch may
insert.  The base has all its cells; a branch has the cells it changed (without a value: removed)
and leaves the rest as they are.  merge_cells() takes the cells of all versions in one table, groups
them by path, pivots the versions, resolves each path and reassembles the rows.

Rules: a path changed by one branch, or by both alike, is one clean change; otherwise it is one
conflict (two edits, an edit and a removal, or two insertions) and the left branch's state holds.  A
column is changed only if its value differs from the base's.  A branch that removes a row has only
that cell; it is an edit-delete conflict if the other branch keeps the row with changes, and clean
otherwise; nothing else of that row counts.  A row added by a branch is one cell, whose value is the
whole row; of several that one branch adds under one id the greatest (as JSON) holds.

All cells of a row meet in one task, so one shuffle serves both groupings.  A base row is told apart
from others with its id by its number in the scan, so an id that holds a third of all rows is spread
like any other; added rows are pre-aggregated by id, and are a row for each id and task at most.

Defined results: nulls in the merged columns are empty texts; a null id stands as the empty text in
the codes, keeps its row, and adds none, nor does an id whose sum leaves the range of a long; rows
that repeat an id (or all of a row) are merged each for itself; a row added under an id that the base
has is a row of its own; an empty text is one empty line; an empty table gives no rows; other
columns are not carried.  The table should be a stored one: the number in the scan is part of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW, COLUMN, LINE, GAP = 0, 1, 2, 3
COLUMNS = ("lang", "source")
KEY = ("doc_id", "row")
MODULUS = 17
_CELL = "struct<version:string,kind:tinyint,name:int,value:string>"


def _cell(version: str, kind: int, name: Column | int, value: Column | str | None) -> Column:
    """A cell; without a value it is gone in this version."""
    name = F.lit(name) if isinstance(name, int) else name
    value = F.lit(value).cast("string") if value is None or isinstance(value, str) else value
    return F.struct(F.lit(version), F.lit(kind), name, value).cast(_CELL)


def _present(*cells: Column) -> Column:
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def code(branch: str, doc_id: Column, name: Column) -> Column:
    """The branch's code for one row, column or line."""
    return F.crc32(F.concat(F.lit(f"{branch}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), name.cast("string")).cast("binary")) % MODULUS


def _edited(own: Column, value: Column) -> Column:
    return F.when(own == 1, F.concat(value, F.lit("!"))).when(own == 2, F.concat(value, F.lit("?")))


def _coded(docs: DataFrame) -> DataFrame:
    """Rows with empty texts for nulls, and the branches' codes of row and columns."""
    rows = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*COLUMNS, "text")])
    return rows.select("*", *[code(b, F.col("doc_id"), F.lit(c)).alias(f"{b}_{c}") for b in "LR" for c in ("row", *COLUMNS)])


def version_cells(docs: DataFrame) -> DataFrame:
    """The union of base, left and right cells of the rows of documents, the branches as the codes say.

    A column of the result for each part of the path: doc_id, row, kind and name; then version and value.
    """
    rows = _coded(docs.select("doc_id", *COLUMNS, "text")).withColumn("row", F.monotonically_increasing_id())
    own = [_cell("B", ROW, 0, "")]
    for b in "LR":
        dropped = F.col(f"{b}_row") == 0
        own.append(F.when(dropped, _cell(b, ROW, 0, None)))
        own += [F.when(~dropped & (F.col(f"{b}_{c}") < 3), _cell(b, COLUMN, k, F.coalesce(_edited(F.col(f"{b}_{c}"), F.col(c)), F.lit("")))) for k, c in enumerate(COLUMNS)]
    own += [_cell("B", COLUMN, k, F.col(c)) for k, c in enumerate(COLUMNS)]
    # lines first, each with its codes; the row's own cells come with line 0
    kept = {b: F.col(f"{b}_row") != 0 for b in "LR"}
    lines = rows.select(*KEY, *[k.alias(f"{b}_kept") for b, k in kept.items()], _present(*own).alias("own"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("*", *[F.when(F.col(f"{b}_kept"), code(b, F.col("doc_id"), F.col("at"))).otherwise(F.lit(MODULUS)).alias(f"{b}_code") for b in "LR"])
    cells = [_cell("B", LINE, F.col("at"), F.col("line"))]
    for b in "LR":
        c = F.col(f"{b}_code")
        cells += [F.when(c < 3, _cell(b, LINE, F.col("at"), _edited(c, F.col("line")))), F.when((c == 3) | (c == 4), _cell(b, GAP, F.col("at"), F.when(c == 3, F.lit("!")).otherwise(F.lit("?"))))]
    every = F.concat(_present(*cells), F.when(F.col("at") == 0, F.col("own")).otherwise(F.array().cast(f"array<{_CELL}>")))
    return lines.select(*KEY, F.inline(every))


def _resolve(paths: DataFrame) -> DataFrame:
    """Each path's merged value and what it counts as; the pivoted columns are base, left, right, has_left and has_right."""
    base, left, right = F.col("base"), F.col("left"), F.col("right")
    moved = {b: F.col(f"has_{b}") & ~F.col(b).eqNullSafe(base) for b in ("left", "right")}
    both = moved["left"] & moved["right"]
    clash = both & ~left.eqNullSafe(right)
    gone = left.isNull() | right.isNull()
    kind = F.when(~moved["left"] & ~moved["right"], F.lit(None)).when(~clash, "clean").when(base.isNull(), "insert_insert").when(gone, "edit_delete").otherwise("edit_edit")
    value = F.when(moved["left"], left).when(moved["right"], right).otherwise(base)
    return paths.withColumn("count_as", kind).withColumn("value", value)


def _pivot(cells: DataFrame, *path: str) -> DataFrame:
    """One row for each path, the versions beside each other."""
    at = lambda v: F.max(F.when(F.col("version") == v, F.col("value")))
    has = lambda v: F.coalesce(F.bool_or(F.col("version") == v), F.lit(False))
    return cells.groupBy(*path).agg(at("B").alias("base"), at("L").alias("left"), at("R").alias("right"), has("L").alias("has_left"), has("R").alias("has_right"))


_COUNTS = ("clean", "edit_edit", "edit_delete", "insert_insert")


def merge_cells(cells: DataFrame) -> DataFrame:
    """Merged base rows: doc_id, the columns, text, present, and the four counts."""
    cells = cells.repartition(*KEY)
    paths = _resolve(_pivot(cells, *KEY, "kind", "name"))
    inner = F.col("kind") != ROW
    dropped = lambda b: F.coalesce(F.bool_or((F.col("kind") == ROW) & F.col(f"has_{b}") & F.col(b).isNull()), F.lit(False))
    column = lambda k: F.max(F.when((F.col("kind") == COLUMN) & (F.col("name") == k), F.col("value")))
    part = F.when((F.col("kind") >= LINE) & F.col("value").isNotNull(), F.struct("name", "kind", "value"))
    rows = paths.groupBy(*KEY).agg(
        dropped("left").alias("gone_left"), dropped("right").alias("gone_right"), *[column(k).alias(c) for k, c in enumerate(COLUMNS)], F.array_sort(F.collect_list(part)).alias("parts"),
        *[F.count_if(inner & (F.col("count_as") == c)).alias(c) for c in _COUNTS],
    )
    gone = F.col("gone_left") | F.col("gone_right")
    changed = F.col("clean") + F.col("edit_edit") + F.col("edit_delete") + F.col("insert_insert") > 0
    # the branch that keeps a row dropped by the other is alone in its cells, so the merged cells are its state
    present = ~gone | (F.col("gone_right") & ~F.col("gone_left") & changed)
    alone = {"clean": (~changed).cast("long"), "edit_edit": F.lit(0), "edit_delete": changed.cast("long"), "insert_insert": F.lit(0)}
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return rows.select(
        "doc_id", *[F.when(present, F.col(c)).alias(c) for c in COLUMNS], F.when(present, text).alias("text"), present.alias("present"),
        *[F.when(gone, alone[c]).otherwise(F.col(c)).cast("long").alias(f"n_{c}") for c in _COUNTS],
    )


def added_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, version, value) of the rows that branches add; the value is the whole row as JSON."""
    rows = _coded(docs.select("doc_id", *COLUMNS, F.lit("").alias("text")))
    new = {"L": F.bitwise_not(F.col("doc_id").cast("long")), "R": F.try_subtract(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(4).cast("long"))}
    one = lambda b: F.when(F.col(f"{b}_row").isin(3, 4) & new[b].isNotNull(), F.struct(new[b].alias("doc_id"), F.lit(b).alias("version"), F.to_json(F.struct(*COLUMNS, F.when(F.col(f"{b}_row") == 3, F.lit("!")).otherwise(F.lit("?")).alias("text"))).alias("value")))
    return rows.select(F.inline(_present(one("L"), one("R"))))


def merge_added(cells: DataFrame) -> DataFrame:
    """Added rows, merged whole by id, in the columns of merge_cells()."""
    rows = _resolve(_pivot(cells, "doc_id"))
    value = F.from_json("value", ", ".join(f"{c} string" for c in (*COLUMNS, "text")))
    return rows.select("doc_id", value.alias("v"), "count_as").select("doc_id", *[f"v.{c}" for c in (*COLUMNS, "text")], F.lit(True).alias("present"), *[(F.col("count_as") == c).cast("long").alias(f"n_{c}") for c in _COUNTS])


def merge_branches(docs: DataFrame) -> DataFrame:
    """Every row of documents and every added one after the merge: doc_id, lang, source, text, present, n_clean, n_edit_edit, n_edit_delete, n_insert_insert."""
    return merge_cells(version_cells(docs)).unionByName(merge_added(added_cells(docs)))


def contract(merged: DataFrame) -> DataFrame:
    return merged.select("doc_id", *COLUMNS, F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *[f"n_{c}" for c in _COUNTS])
