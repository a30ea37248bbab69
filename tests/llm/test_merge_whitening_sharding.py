"""The branch merge, whitening and sharding against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholia.llm import branchmerge, sharding, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, version string, value string, cell int, shard int, x binary"


def table(spark, rows, parts=3):
    """(doc_id, text, lang, source) with extra columns whose names clash with those inside."""
    return spark.createDataFrame([(*r, 7, 7, "n", "n", 7, 7, None) for r in rows], SCHEMA).repartition(parts)


def lots(n=400, seed=5):
    r = random.Random(seed)
    text = lambda: "\n".join(" ".join(r.choice("abcdef") for _ in range(r.randrange(4))) for _ in range(r.randrange(1, 12)))
    rows = [(i, text(), r.choice(["en", "de", "", None]), r.choice(["web", None])) for i in range(n)]
    return [*rows, (n, None, None, None), (n + 1, "", "en", "s"), (n + 2, "\n\n", "en", "s"), (n + 3, "line\n" * 3000, "en", "s"), (None, "no id\nat all", "en", "s"), (2**63 - 1, "last", "en", "s"), (-(2**63), "first", "en", "s")]


# three-way merge


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 17


def branch(b, row):
    """What a branch makes of a row: None if dropped, else columns, lines and gaps that it changed; and the row it adds."""
    doc_id, text, lang, source = row
    own = code(b, doc_id, "row")
    new = None if doc_id is None else (-1 if b == "L" else -5) - doc_id
    added = (new, (lang or "", source or "", "!" if own == 3 else "?")) if own in (3, 4) and new is not None and -(2**63) <= new < 2**63 else None
    if own == 0:
        return None, added
    change = {}
    for name, v in (("lang", lang or ""), ("source", source or "")):
        c = code(b, doc_id, name)
        after = {0: "", 1: v + "!", 2: v + "?"}.get(c, v)
        if after != v:
            change[name] = after
    for k, v in enumerate((text or "").split("\n")):
        c = code(b, doc_id, k)
        if c < 3:
            change["line", k] = {0: None, 1: v + "!", 2: v + "?"}[c]
        elif c < 5:
            change["gap", k] = "!?"[c - 3]
    return change, added


def merged(row):
    doc_id, text, lang, source = row
    (left, _), (right, _) = branch("L", row), branch("R", row)
    n = Counter()
    if left is None or right is None:
        other = right if left is None else left
        n["edit_delete" if other else "clean"] += 1
        if not other or left is None:
            return (doc_id, None, None, None, n)
        left, right, n2 = other, {}, n
    else:
        n2 = None
    state = {"lang": lang or "", "source": source or ""} | {("line", k): v for k, v in enumerate((text or "").split("\n"))}
    last = len((text or "").split("\n"))
    for path in {*left, *right}:
        if path in left and path in right and left[path] != right[path]:
            n["insert_insert" if path[0] == "gap" else "edit_delete" if None in (left[path], right[path]) else "edit_edit"] += 1
        else:
            n["clean"] += 1
        state[path] = left[path] if path in left else right[path]
    if n2 is not None:
        n = Counter({"edit_delete": 1})
    out = [v for k in range(last) for v in (state["line", k], state.get(("gap", k))) if v is not None]
    return (doc_id, state["lang"], state["source"], "\n".join(out), n)


def added_rows(rows):
    by = defaultdict(lambda: {"L": [], "R": []})
    for row in rows:
        for b in "LR":
            if new := branch(b, row)[1]:
                by[new[0]][b].append(new[1])
    import json

    key = lambda v: json.dumps(dict(zip(("lang", "source", "text"), v, strict=True)), separators=(",", ":"), ensure_ascii=False)
    for i, sides in by.items():
        left, right = (max(sides[b], key=key, default=None) for b in "LR")
        clash = left is not None and right is not None and left != right
        yield (i, *(left or right), Counter({"insert_insert" if clash else "clean": 1}))


def expected(rows):
    kinds = ("clean", "edit_edit", "edit_delete", "insert_insert")
    every = [*map(merged, rows), *added_rows(rows)]
    return sorted(((i, a, b, t if t is None else hashlib.sha256(t.encode()).hexdigest(), *(n[k] for k in kinds)) for i, a, b, t, n in every), key=repr)


@pytest.mark.parametrize("rows", [lots(), lots(60, 2) * 2, [(5, "same", "en", "s")] * 50, [(i, "x", None, None) for i in range(3000)]], ids=["many", "repeated", "one id", "short"])
def test_merge_equals_plain(spark, rows):
    got = branchmerge.contract(branchmerge.merge_branches(table(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_merge_meets_every_case(spark):
    """The rows of the plain comparison hold each kind of count, and drops that the other branch kept with and without changes."""
    every = expected([*lots(), *((i, "x", None, None) for i in range(3000))])
    assert all(sum(r[k] for r in every) for k in (4, 5, 6, 7))
    assert any(r[1:4] == (None,) * 3 and r[6] for r in every) and any(r[1:4] == (None,) * 3 and not r[6] for r in every) and any(r[0] < 0 and r[7] for r in every if r[0] is not None)


def test_merge_of_an_empty_table_and_of_a_long_text(spark):
    assert branchmerge.merge_branches(table(spark, [])).count() == 0
    rows = [(1, "a line of some length\n" * 200_000, "en", "s"), (2, "x" * 2_000_000, "en", "s")]
    got = branchmerge.contract(branchmerge.merge_branches(table(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_merge_of_given_cells(spark):
    """Cells of any source: an edit against a removal, equal insertions, and a row that only the right side drops."""
    cells = [
        (1, 0, 0, 0, "B", ""), (1, 0, 1, 0, "B", "en"), (1, 0, 1, 1, "B", "s"), (1, 0, 2, 0, "B", "one"), (1, 0, 2, 1, "B", "two"), (1, 0, 2, 0, "L", None), (1, 0, 2, 0, "R", "uno"), (1, 0, 3, 1, "L", "new"), (1, 0, 3, 1, "R", "new"),
        (2, 1, 0, 0, "B", ""), (2, 1, 1, 0, "B", "en"), (2, 1, 1, 1, "B", "s"), (2, 1, 2, 0, "B", "gone"), (2, 1, 0, 0, "R", None),
    ]
    got = {r["doc_id"]: r for r in branchmerge.merge_cells(spark.createDataFrame(cells, "doc_id long, row long, kind byte, name int, version string, value string")).collect()}
    assert (got[1]["text"], got[1]["n_clean"], got[1]["n_edit_delete"], got[1]["n_edit_edit"]) == ("two\nnew", 1, 1, 0)
    assert (got[2]["present"], got[2]["text"], got[2]["n_clean"], got[2]["n_edit_delete"]) == (False, None, 1, 0)


# whitening

EMB = "vec_id long, embedding array<float>, label int, n long, x long, component int, piece string, block long"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 1, 1, 1, "s", 1) for i, v in rows], EMB).repartition(parts)


def plain_whitening(rows, k=4):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, total = len(fit), fit.sum(axis=0)
    c = fit - total / n
    cov = c.T @ c / n
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    out = defaultdict(list)
    for i, x in good:
        d = sum((n * a - int(s)) ** 2 for a, s in zip(x, total, strict=True))
        w = (np.array(x) - total / n) @ vecs[:, order] / np.sqrt(values[order])
        out[i].append((d, w, values[order] / np.trace(cov)))
    return n, out


def embeddings(n, dims, seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims)).astype(np.float32) @ np.diag(np.linspace(0.3, 0.02, dims)).astype(np.float32)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    bad = [(n, None), (n + 1, [float("nan")] * dims), (n + 2, [None, *[0.0] * (dims - 1)]), (n + 3, [float("inf")] * dims), (n + 4, [])]
    return [*rows, *bad, *[(n + 5 + k, rows[0][1]) for k in range(40)], (None, rows[1][1]), (3, rows[2][1])]


@pytest.mark.parametrize(("n", "dims", "tile"), [(300, 20, 16), (300, 7, 3), (50, 64, 16), (200, 16, 16)])
def test_whitening_equals_plain(spark, n, dims, tile):
    rows = embeddings(n, dims)
    got = whitening.whitened(vectors(spark, rows), tile=tile).collect()
    count, want = plain_whitening(rows)
    by = defaultdict(list)
    for r in got:
        assert r["n"] == count and r["identity_error"] < 1e-9
        by[r["vec_id"]].append(r)
    assert set(by) == set(want) and all(len(by[i]) == 4 * len(want[i]) for i in by)
    signs = {r["component"]: np.sign(r["whitened"] * want[4][0][1][r["component"] - 1]) for r in by[4]}
    for i, answers in want.items():
        left = sorted((d, k + 1, round(float(w[k]), 7), round(float(e[k]), 9)) for d, w, e in answers for k in range(4))
        right = sorted((r["deviation"], r["component"], round(float(r["whitened"] * signs[r["component"]]), 7), round(r["explained"], 9)) for r in by[i])
        assert np.allclose(left, right, rtol=1e-9, atol=2e-7)


def test_whitening_of_few_dimensions_ranks_and_rows(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whitened(vectors(spark, [(1, [0.5, 0.25])] * 3)).collect()
    assert len(one) == 6 and all(r["whitened"] == 0 and r["explained"] == 0 and r["n"] == 1 and r["deviation"] == 0 for r in one)
    flat = whitening.whitened(vectors(spark, [(i, [i / 16, i / 8, 1.0]) for i in range(10)])).collect()
    assert len(flat) == 30 and max(abs(r["whitened"]) for r in flat if r["component"] > 1) < 1e-6 and flat[0]["identity_error"] < 1e-9
    mixed = whitening.whitened(vectors(spark, [*((i, [i / 7, (i * i % 5) / 3]) for i in range(9)), (99, [1.0])])).collect()
    assert {r["vec_id"] for r in mixed} == set(range(9))


def test_whitening_of_extreme_entries(spark):
    rows = [(1, [3e38, -3e38]), (2, [-3e38, 3e38]), (3, [0.0, -0.0])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] != 3) and {r["n"] for r in got} == {3}


# sharding


def plain_shards(spark, rows, n, slack=0.0):
    """Each row's cell by the same hash, then one row after another clockwise, in rounds of the ring."""
    places = sharding.ring(n)
    keyed = spark.createDataFrame([(i, t, k) for k, (i, t, *_) in enumerate(rows)], "i long, t string, k long").selectExpr("k", "i", "xxhash64(cast(i as string)) as place", "xxhash64(t) as content").collect()
    order = sorted(keyed, key=lambda r: ((r["place"] % 2**64) >> (64 - sharding.CELL_BITS), r["place"], r["i"] is not None, r["i"] or 0, r["content"]))
    room, out = sharding.capacities(len(rows), n, slack), {}
    at = {r["k"]: next((p for p, (c, _) in enumerate(places) if c >= (r["place"] % 2**64) >> (64 - sharding.CELL_BITS)), 0) for r in order}
    waiting = order
    while waiting:
        left = []
        for r in waiting:
            shard = places[at[r["k"]]][1]
            if room[shard]:
                room[shard] -= 1
                out[r["k"]] = shard
            else:
                left.append(r)
        for r in left:
            p = (at[r["k"]] + 1) % len(places)
            while not room[places[p][1]]:
                p = (p + 1) % len(places)
            at[r["k"]] = p
        waiting = left
    return Counter((rows[k][0], rows[k][1], s) for k, s in out.items())


@pytest.mark.parametrize(("rows", "n", "slack"), [(lots(), 8, 0.0), (lots(), 5, 0.1), ([(7, "copy", "en", "s")] * 300 + lots(300), 8, 0.0), ([(7, f"t{i % 9}", "en", "s") for i in range(301)], 8, 0.0), (lots(3), 8, 0.0)], ids=["many", "slack", "hot row", "one id", "few"])
def test_shards_equal_plain(spark, rows, n, slack):
    got = sharding.shards(table(spark, rows).select("*"), n, slack).collect()
    assert len(got) == len(rows)
    texts = defaultdict(Counter)
    for i, t, *_ in rows:
        texts[i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())][t] += 1
    want = plain_shards(spark, rows, n, slack)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == Counter({k: v for k, v in Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for (i, t, s), c in want.items() for _ in range(c)).items()})
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    if not slack:
        assert max(len(by[s]) for s in range(n)) - min(len(by[s]) for s in range(n)) <= 1


def test_shards_do_not_depend_on_partitions_or_order(spark):
    rows = lots(500)
    a = Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.shards(table(spark, rows, 2)).collect())
    b = Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.shards(table(spark, rows[::-1], 7)).collect())
    assert a == b


def test_few_rows_move(spark):
    rows = [(i, "t", "en", "s") for i in range(4000)]
    where = lambda rows, n, slack: {r["doc_id"]: r["shard"] for r in sharding.shards(table(spark, rows), n, slack).collect()}
    eight, nine, more = where(rows, 8, 0.05), where(rows, 9, 0.05), where([*rows, *((i, "t", "en", "s") for i in range(4000, 4040))], 8, 0.05)
    assert sum(eight[i] != nine[i] for i in eight) < 0.3 * len(rows)
    assert sum(eight[i] != more[i] for i in eight) < 0.05 * len(rows)
    tight, tighter = where(rows, 8, 0.0), where(rows, 9, 0.0)
    assert sum(tight[i] != tighter[i] for i in tight) < 0.5 * len(rows)


def test_sharding_of_an_empty_table(spark):
    assert sharding.contract(sharding.shards(table(spark, []))).count() == 0
