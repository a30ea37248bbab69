"""Each operator against a plain version on small tables with nulls, empties, ties, repeats and clashing columns."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.llm import chunks, decontaminate, licenses, mixing, neardup, pieces, quality, suffixes, tokenfiles, toxicity
from scholia.llm.textkit import Block

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, score double, h long, n string"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(seed, n, pool=400):
    r = random.Random(seed)
    return [f"w{r.randrange(pool)}x{r.randrange(9)}" for _ in range(n)]


def corpus():
    a, b = words(1, 120), words(2, 150)
    near = [*a[:60], "changed", *a[61:]]
    passage = words(3, 60)
    rows = [
        " ".join(a), " ".join(a), " ".join(near), " ".join(b), "", None, "one two", "one two", "   \n\t ",
        " ".join([*words(4, 40), *passage, *words(5, 30)]), " ".join([*words(6, 25), *passage, *words(7, 50)]),
        "é" * 300 + " ünïcode ▁ text\n\nline\nline\n#$% " * 3, "ab " * 200, " ".join(words(8, 5000, 5000)), "x" * 3000,
    ]
    out = [(i, t, "en", "s", len(t or ""), 1, 0.5, 7, "n") for i, t in enumerate(rows)]
    return [*out, (None, "a null id text " * 30, None, None, None, None, None, None, None), (0, rows[0], "en", "s", 1, 1, 0.5, 7, "n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in corpus()]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    model = toxicity.train(empty, labels)
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = tokenfiles.new_folder(spark)
    results = [
        neardup.near_duplicates(empty), chunks.substring_dedup(empty), toxicity.toxicity(empty, model), tokenfiles.read_token_files(spark, folder, tokenfiles.write_token_files(empty, folder, path)),
        suffixes.remove_repeats(empty), mixing.score_documents(empty), pieces.encode_documents(empty, public_tokenizers.path("piece_bpe_32k.model")), licenses.license_scan(empty),
        decontaminate.find_windows(empty, bench), quality.quality_rules(empty),
    ]
    assert [r.count() for r in results] == [0] * 10


def shingle_counts(t):
    w = t.translate(LOWER).split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()


def brute_classes(rows):
    """(id, text) -> the least id of its class, over all pairs by weighted Jaccard similarity."""
    docs = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    sets = [shingle_counts(t) for _, t in docs]
    group = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = (sets[i] & sets[j]).total()
        if both and both >= 0.8 * (sets[i] | sets[j]).total():
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return {d: docs[g][0] for d, g in zip(docs, group, strict=True)}


def found_classes(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(frame).collect()
    assert len(got) == len(set(rows))
    names = {(x.h1, x.h2): t for x in frame.selectExpr("xxhash64(text) h1", "xxhash64(1, text) h2", "text").collect() for t in [x.text]}
    assert all(sum(r.kept for r in own) == 1 for own in [[r for r in got if r.class_id == c and r.n_rows] for c in {r.class_id for r in got} - {None}])
    return {(r.doc_id, names[r.h1, r.h2] if r.h1 is not None else None): r.class_id for r in got}


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = list({(i, t) for i, t in texts()})
    assert found_classes(spark, rows) == brute_classes(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert got[0].n_rows == 2 and got[None].kept


def test_one_of_each_keeps_columns(docs):
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [0, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14]


def test_near_duplicates_of_chains_and_odd_ids(spark):
    """Chains in which only neighbours are near, met in any order; repeated, null and extreme ids."""
    rows = []
    for c in range(6):
        own = words(50 + c, 120, 10**6)
        for k in range(40):
            rows.append((c * 1000 + (k * 17) % 40, " ".join(own)))
            own = [*own[:3 * (k % 40)], *own[3 * (k % 40) + 3 :], *words(9000 + 100 * c + k, 3, 10**6)]
    odd = [-(2**63), -(2**62), -(2**61) - 5, 2**63 - 1]
    rows += [(i, " ".join(words(77, 50, 10**6))) for i in odd] + [(5, " ".join(words(78, 60, 10**6))), (None, " ".join(words(77, 50, 10**6))), (None, "alone " * 9), (5, " ".join(words(78, 60, 10**6)[:-1]))]
    rows += [(8000 + k, " ".join(["same"] * (20 + k))) for k in range(12)]  # one shingle of other weights
    assert found_classes(spark, rows) == brute_classes(rows)


def test_near_duplicates_of_random_clusters(spark):
    r = random.Random(9)
    rows = []
    for c in range(40):
        base = words(300 + c, r.randrange(30, 150), 10**6)
        for k in range(r.randrange(1, 12)):
            own = list(base)
            for p in r.sample(range(len(own)), r.randrange(0, 4)):
                own[p] = f"n{c}x{k}x{p}"
            rows.append((1000 * c + k, " ".join(own)))
    assert found_classes(spark, rows) == brute_classes(rows)


@pytest.mark.parametrize("rounds", [1, 4])
def test_near_duplicates_in_a_crowd(spark, monkeypatch, rounds):
    """Near pairs among many texts of one template are found whether or not a leader was drawn from them."""
    monkeypatch.setattr(neardup, "LEADER_ROUNDS", rounds)
    base = words(21, 174, 10**6)
    rows = []
    for k in range(120):
        own = [*base, *words(1000 + k, 26, 10**6)]  # 170 of 196 shingles are the template's
        rows.append((k, " ".join(own)))
        if k < 20:
            rows.append((1000 + k, " ".join([*own[:-17], *words(2000 + k, 17, 10**6)])))
    expected = brute_classes(rows)
    assert len(set(expected.values())) == 120
    assert found_classes(spark, rows) == expected


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(0)
    e = r.integers(0, 2**63, 60, dtype=np.uint64)
    wa, wb = r.integers(1, 6, 40).astype(float), r.integers(1, 6, 40).astype(float)
    sig = neardup.dart_signatures(np.r_[e[:40], e[20:]], np.r_[np.zeros(40, int), np.ones(40, int)], np.r_[wa, wb], 2, t=4096)
    low = np.minimum(wa[20:], wb[:20]).sum()
    true = low / (wa.sum() + wb.sum() - low)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_substring_dedup(docs):
    got = {r.doc_id: r for r in chunks.substring_dedup(docs).collect()}
    assert got[1].kept_text == "" and got[0].n_removed == 0
    assert got[5].kept_text is None and got[4].kept_text == ""
    passage = " ".join(words(3, 60))
    assert got[9].n_removed == 0 and got[10].n_removed > len(passage) // 2
    before, after = dict(texts())[10], got[10].kept_text
    assert len(before) - len(after) == got[10].n_removed and after.startswith(before[:60])


def test_substring_dedup_finds_whole_passages(spark):
    """A passage of 51 to 60 words goes from its first to its last byte, whatever stands around it; a short one stays."""
    r = random.Random(17)
    some = lambda n: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=r.randint(2, 9))) for _ in range(n))
    rows, expected = [], {}
    for k in range(600):
        passage = some(51 + k % 10) if k % 6 else some(12)[:100]
        old, new = [(some(r.randrange(120)), some(r.randrange(120))) for _ in range(2)]
        first, second = f"{old[0]}A{passage}B{old[1]}", f"{new[0]}C{passage}D{new[1]}"
        rows += [(2 * k, first), (2 * k + 1, second)]
        expected |= {2 * k: first, 2 * k + 1: f"{new[0]}CD{new[1]}" if k % 6 else second}
    long = some(3000)  # found over several pieces of the owner's text, and with an owner that changes within
    rows += [(5000, some(40) + long[4000:4300] + some(40)), (5001, some(50) + "A" + long + "B" + some(50)), (5002, f"C{long}D")]
    expected[5002] = "CD"
    got = {x.doc_id: x.kept_text for x in chunks.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {k: got[k] for k in expected} == expected


def test_substring_dedup_matches_whole_texts_of_owners(spark):
    """A match that runs on past the pieces of its owner, where other documents own all seeds, still reaches its end."""
    text = bytes(random.Random(3).choices(b"abcdefgh ", k=9000))
    seed = [(4000, 32, 4000)]
    piece = {"owner": 1, "base": 3500, "last": False, "piece": text[3500:4700], "seeds": [{"at": 4000, "size": 32, "start": 4000}]}
    spans, early = chunks.foreign_spans(text, [piece])
    assert spans == [(3500, 4700)] and early
    assert chunks.matches(text, text, 0, seed) == [(0, 0, 9000)]


@given(st.lists(st.text(max_size=400), max_size=6))
@settings(max_examples=30, deadline=None)
def test_chunks_cover_the_text(many):
    raw = [t.encode() for t in many]
    block = Block(raw)
    starts, ends, doc = chunks.chunk(block)
    for d, t in enumerate(raw):
        own = [block.buf[a:b].tobytes() for a, b, x in zip(starts, ends, doc, strict=True) if x == d]
        assert b"".join(own) == t
        assert all(c.decode() is not None for c in own)


def test_toxicity_learns_and_locates(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        s = [" ".join(words(i * 10 + k, 8)) for k in range(5)]
        if bad:
            s[r.randrange(5)] += " grobian"
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, 1, int(bad)))
    docs, given_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, toxicity.train(docs, given_)).collect()
    held = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert all((x.score >= 0.3) == (x.doc_id % 5 == 0) for x in held) and len(held) > 50
    text = dict(rows)
    assert all("grobian" in text[x.doc_id][x.worst_start : x.worst_end] for x in held if x.doc_id % 5 == 0)


def test_toxicity_edge_cases(spark, docs):
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -3.0)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert got[4].score == 0 and got[5].score == 0 and got[8].n_sentences == 0 and 0 < got[3].score < 1


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    folder = tokenfiles.new_folder(spark)
    files = tokenfiles.write_token_files(docs, folder, path)
    got = sorted(tokenfiles.read_token_files(spark, folder, files).collect(), key=lambda r: r.start)
    start, rows = 0, [(i, [*model.encode(t, add_special_tokens=False).ids, 2]) for i, t in texts()]
    order = lambda x: (x[0] is not None, x[0] or 0, np.uint64(xxhash.xxh3_64_intdigest(np.array(x[1], "<u4").tobytes())).astype(np.int64))
    for (i, ids), r in zip(sorted(rows, key=order), got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "endoftext", "<|", " ", "\n", "word", "a1", "é", "\u00a0", "!", "'s"]), max_size=12).map("".join) | st.text(max_size=40), min_size=1, max_size=6))
def test_encoding_equals_an_unmodified_tokenizer(many):
    """Also texts with the added tokens of the file, whole, in part and side by side."""
    model, tokens = _tokenizers()
    ids, n = tokens.encode([t.encode() for t in many], 2)
    assert ids.tolist() == [x for t in many for x in [*model.encode(t, add_special_tokens=False).ids, 2]] and n.sum() == len(ids)


@functools.cache
def _tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), tokenfiles.Tokens(f.read())


def test_token_files_of_added_tokens(spark):
    rows = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|><|endoftext|>"), (3, "x<|endoftext|")]
    folder = tokenfiles.new_folder(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokenfiles.read_token_files(spark, folder, tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder, path)).collect()
    assert {r.doc_id: r.ids for r in got} == {i: [*_tokenizers()[0].encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    assert [r.ids for r in got if r.doc_id == 1] == [[31373, 220, 50256, 995, 2]]


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_strings_that_collide_in_polynomial_hashes():
    """Thue-Morse words and their complements agree under every polynomial hash modulo a power of two."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        tokens = tokenfiles.Tokens(f.read())
    a = thue_morse(2048)
    many = [a, a.translate(str.maketrans("ab", "ba")), f"{a} {a}"]
    ids, n = tokens.encode([t.encode() for t in many], 2)
    assert ids.tolist() == [x for t in many for x in [*model.encode(t, add_special_tokens=False).ids, 2]] and n.sum() == len(ids)
    block = Block([t.encode() for t in many[:2]])
    assert len(set(block.hashes(block.offsets[:-1], block.offsets[1:] - 1).tolist())) == 2


def test_token_files_of_one_hot_id(spark):
    """Rows of one id are spread over several tasks and still follow one another."""
    rows = [(7, " ".join(words(k, 40))) for k in range(300)] + [(None, f"null {k}") for k in range(50)] + [(9, "end")]
    folder = tokenfiles.new_folder(spark)
    files = tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(tokenfiles.read_token_files(spark, folder, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 50 + [7] * 300 + [9]
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_codes_round_trip(many):
    control, data = tokenfiles.pack(np.array(many, np.uint32))
    assert tokenfiles.unpack(control, data, len(many)).tolist() == many


def repeats(rows, window=200):
    raw = [t.encode() for _, t in rows]
    seen = Counter(b[k : k + window] for b in raw for k in range(len(b) - window + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        mark = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                mark[k : k + window] = b"\1" * window
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffixes_equal_brute_force(docs):
    got = suffixes.remove_repeats(docs).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == repeats(texts())


@pytest.mark.parametrize("n, hot", [(65, 1024), (90, 8), (1000, 64), (1000, 1024)])
def test_suffixes_with_hot_buckets(spark, monkeypatch, n, hot):
    """One passage in n surroundings, sorted as it is or, beyond the limit, after trimming."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    shared = " ".join(words(21, 60))
    rows = [(i, " ".join(words(10**5 + i, 10, 10**6)) + " " + shared + " " + " ".join(words(2 * 10**5 + i, 10, 10**6))) for i in range(n)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == repeats(rows)


def test_hot_buckets_send_their_runs_not_their_texts(spark, monkeypatch):
    """Of long texts that share one passage only the runs of its buckets are kept for trimming."""
    monkeypatch.setattr(suffixes, "HOT", 8)
    plain, kept = suffixes.cut, []

    def watched(df, name="cut"):
        out = plain(df, name)
        if name == "hot":
            kept.append(out.agg(F.sum(sum(F.octet_length(c) for c, kind in out.dtypes if kind in ("string", "binary")))).first()[0])
        return out

    monkeypatch.setattr(suffixes, "cut", watched)
    shared = " ".join(words(21, 60))
    rows = [(i, " ".join(words(10**5 + i, 1500, 10**6)) + " " + shared + " " + " ".join(words(2 * 10**5 + i, 10, 10**6))) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(3)] + [(200, rows[1][1] + " more")]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == repeats(rows)
    assert kept and kept[0] < sum(len(t) for _, t in rows) / 4


def test_suffixes_of_ten_thousand_places(spark):
    shared = " ".join(words(21, 30))
    rows = [(i, f"{i:08x}{shared}{i * 7919:09x}") for i in range(10_000)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == repeats(rows)


def test_suffixes_of_periodic_texts(spark):
    rows = [(1, "ab" * 400), (2, "abc" * 300), (3, "x" * 199), (4, "x" * 200), (5, "x" * 201 + "y"), (6, "é" * 150 + "ab" * 120), (7, "ab" * 400)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == repeats(rows)


def test_cover_sort_is_a_suffix_sort():
    r = np.random.default_rng(3)
    text = np.r_[np.tile(r.integers(97, 99, 40), 6), r.integers(97, 99, 200), np.zeros(60, int)].astype(np.uint8)
    sorter = suffixes.CoverSort(text, 40)
    items = np.arange(400)
    got = sorter.sort(r.permutation(items), np.zeros(400, int))
    raw = text.tobytes()
    assert got.tolist() == sorted(range(400), key=lambda k: raw[k:])
    pairs = r.integers(0, 400, (2000, 2))
    assert sorter.same(pairs[:, 0], pairs[:, 1]).tolist() == [raw[a : a + 40] == raw[b : b + 40] for a, b in pairs]


def test_mixing_base_and_model(docs):
    got = sorted(mixing.score_documents(docs).collect(), key=lambda r: str((r.doc_id, r.n_bytes)))
    count, split = Counter(), []
    for i, t in texts():
        w = [*re.findall("[^\x20\x09-\x0d]+", t.translate(LOWER)), None]
        out = zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
        split.append((i, len(t.encode()), w, out))
        if not out:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for r, (i, size, w, out) in zip(got, sorted(split, key=lambda x: str(x[:2])), strict=True):
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, out, len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def random_mixer(r):
    return mixing.Mixer(r.normal(0.3, 0.1, (mixing.SETS, mixing.ORDERS + 1)), np.abs(r.normal(5, 2, (256 * mixing.STEPS, 1))) * [0.5, 1.0])


def test_mixing_is_a_distribution():
    """Over all next bytes the probabilities of each form sum to one, whatever the context."""
    r = np.random.default_rng(0)
    gram, n = np.unique(mixing.grams([" ".join(words(i, 40, 20)).encode() for i in range(20)])[0], return_counts=True)
    known = mixing.levels(gram, n, range(mixing.ORDERS))
    for context in (int(gram[7]) & ~0xFF, 0x6162636400):
        prices = random_mixer(r).prices(known, np.arange(256, dtype=np.uint64) | np.uint64(context))
        assert (10**prices).sum(axis=1) == pytest.approx(1)


def test_mixing_counts_equal_plain_counts():
    """Zeros and ones of each context and order, counted bit by bit in a dictionary; one occurrence left out where asked."""
    gram, n = np.unique(mixing.grams([" ".join(words(i, 40, 20)).encode() for i in range(8)])[0], return_counts=True)
    plain = Counter()
    for g, k in zip(gram.tolist(), n.tolist(), strict=True):
        for order in range(mixing.ORDERS):
            for bit in range(8):
                plain[order, g >> 8 & (1 << 8 * order) - 1, bit, (g & 0xFF | 0x100) >> 8 - bit, g >> 7 - bit & 1] += k
    known = mixing.levels(gram, n, range(mixing.ORDERS))
    probe = np.r_[gram, gram ^ np.uint64(1), gram ^ np.uint64(0x400)]
    for order in range(mixing.ORDERS):
        for bit in range(8):
            zeros, ones = known[order].split(probe, bit)
            want = [[plain[order, g >> 8 & (1 << 8 * order) - 1, bit, (g & 0xFF | 0x100) >> 8 - bit, v] for v in (0, 1)] for g in probe.tolist()]
            assert np.stack([zeros, ones], axis=1).tolist() == want
    for bit in range(8):
        x, gate, came, _ = mixing.inputs(known, gram, bit, without=True)
        for row, g, gt, c in zip(x.tolist(), gram.tolist(), gate.tolist(), came.tolist(), strict=True):
            pairs = [[plain[o, g >> 8 & (1 << 8 * o) - 1, bit, (g & 0xFF | 0x100) >> 8 - bit, v] - (v == c) for v in (0, 1)] for o in range(mixing.ORDERS)]
            assert row[:-1] == pytest.approx([math.log((b + 0.1) / (a + 0.1)) if a + b else 0.0 for a, b in pairs])
            seen = [a + b for a, b in pairs if a + b]
            assert gt == (bit * (mixing.ORDERS + 1) + len(seen)) * mixing.LEVELS + sum((seen or [0])[-1] >= k for k in (2, 4, 16))


def test_mixing_adapts_along_a_text():
    """The closed form equals weights updated after every byte."""
    r = np.random.default_rng(1)
    step = np.log10(r.uniform(0.05, 0.9, (len(mixing.TEMPERS), 200)))
    weight, total = np.full(len(step), 1 / len(step)), 0.0
    for p in 10**step.T:
        total += math.log10(weight @ p)
        weight = weight * p / (weight @ p)
    assert mixing.text_score(step.sum(axis=1, keepdims=True))[0] == pytest.approx(total)


def test_mixing_prices_equal_lookups():
    r = np.random.default_rng(2)
    found = [" ".join(words(i, 30, 20)).encode() for i in range(30)] + [b""]
    key = np.unique(mixing.grams(found)[0])
    value = r.normal(size=(3, len(key)))
    by = {k: value[:, i] for i, k in enumerate(key.tolist())}
    shuffled = r.permutation(len(key))
    got = mixing.Prices(key[shuffled], [v[shuffled] for v in value]).of_texts(found)
    for t, sums in zip(found, got.T, strict=True):
        assert sums == pytest.approx(sum(by[g] for g in mixing.grams([t])[0].tolist()))


def test_held_out_texts_change_no_other_score(spark, monkeypatch):
    """With several cells, whose number follows the training strings only."""
    monkeypatch.setattr(mixing, "CELL", 1 << 8)
    rows = [(i, " ".join(words(i, 30, 40))) for i in range(60)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    some = lambda r: {x.doc_id: x.score for x in mixing.score_documents(spark.createDataFrame(r, "doc_id long, text string")).collect()}
    every, few = some(rows), some([r for r in rows if r[0] not in held[1:]])
    strings = np.unique(mixing.grams([t.encode() for i, t in rows if i not in held])[0])
    assert len(strings) > 4 * mixing.CELL and len(held) > 5
    assert all(every[i] == pytest.approx(few[i], rel=1e-12) for i in few)


def test_mixing_learns(spark, monkeypatch):
    rows = [(i, " ".join(words(i, 60, 30))) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = mixing.score_documents(table).where("held_out").collect()
    bits = -sum(r.score for r in got) * math.log2(10) / sum(r.n_bytes + 1 for r in got)
    assert bits < 3
    by_fold = {r.doc_id: r.score for r in got}
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 1 << 12)  # many blocks, other partitions, training texts of their own: the same scores
    is_out = mixing.held_out_column("doc_id", 5, 1)
    again = mixing.score_documents(table.where(is_out).repartition(7), training=table.where(~is_out).repartition(3)).collect()
    assert all(r.held_out for r in again) and {r.doc_id: r.score for r in again} == pytest.approx(by_fold, rel=1e-9)


def test_pieces_are_lossless_and_seeded(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    a, b, c = (pieces.encode_documents(docs, path, seed=s) for s in (1, 1, 2))
    rows = [sorted(x.collect(), key=str) for x in (a, b, c)]
    assert rows[0] == rows[1] != rows[2] and all(r.lossless for x in rows for r in x)
    back = pieces.decode_documents(a, path).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=str) == sorted(texts(), key=str)


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        encoder = pieces.Encoder(pieces.Vocabulary(f.read()), dropout=0.0)
    many = [t.strip() for _, t in texts() if t.strip() and "▁" not in t]
    ids, count = encoder.encode([b" " + t.encode() for t in many], np.zeros(len(many), np.int64))
    at = np.r_[0, np.cumsum(count)]
    for k, t in enumerate(many):
        if "  " not in t:
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(t)


@given(st.text(max_size=120), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_agenda_and_steps_agree(text, seed):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        v = VOCABULARY.setdefault("v", None) or VOCABULARY.setdefault("w", pieces.Vocabulary(f.read()))
    out = []
    for long in (64, 0):
        pieces.LONG = long
        ids, _ = pieces.Encoder(v, seed, 0.3).encode([text.encode()], np.zeros(1, np.int64))
        out.append(ids.tolist())
    pieces.LONG = 64
    assert out[0] == out[1] and v.decode(np.array(out[0], np.int64)).decode() == text


VOCABULARY: dict = {}


def test_license_scan(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "Permission is hereby grantd, free of charge, to any person obtaning a copy of it"), (3, "MIT License and MIT LICENSE, CC BY too"),
        (4, None), (5, "nothing here"), (6, "mit licenses"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].score) == (1, 3, "apache", 1.0)
    assert got[2].labels == "mit" and got[2].n_base == 0 and 0.9 < got[2].score < 1
    m = got[2].matches[0]
    assert rows[1][1][m.start : m.end].startswith("Permission") and m.errors == 2
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].labels) == (3, 0, 5, "cc-by,mit")
    assert got[4].n_words == 0 and got[5].labels == "" and got[6].n_base == 0


def test_decontamination(spark):
    item = " ".join(words(30, 14))
    items = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, ""), (5, item.upper())], "item_id long, text string")
    w = item.split()
    rows = [(1, "Pre, " + "; ".join(w[:12]).title() + " post"), (2, "a SHORT-item"), (3, " ".join(w[:9])), (4, None), (5, "shorter items")]
    got = {r.doc_id: r for r in decontaminate.find_windows(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].item_ids) == (14, 12, ["1", "5"])
    a, b = got[1].hit_spans[0]
    assert rows[0][1][a:b] == "; ".join(w[:12]).title()
    assert got[2].item_ids == ["2"] and got[3].n_hit == 0 and got[4].n_words == 0 and got[5].n_hit == 0


def longest_of(w):
    best = [0] * len(w)
    for a in range(len(w)):
        for b in range(len(w)):
            if a != b:
                n = 0
                while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
                    n += 1
                best[a] = max(best[a], n)
    return best


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=4))
@settings(max_examples=60, deadline=None)
def test_repeats_equal_brute_force(many):
    block = Block([" ".join(w).encode() for w in many])
    starts, ends, doc = block.spans(np.r_[np.zeros(97, bool), np.ones(159, bool)])
    got = quality.longest_repeats(block.hashes(starts, ends), doc, len(many))
    assert got.tolist() == [x for w in many for x in longest_of(w)]


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in texts():
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and (not r.base_failed or not r.kept)
        assert sum(len(re.sub(r"\s", "", t[a:b])) for a, b in r.repeat_spans) == r.covered_chars
    assert got[3].kept


def edit_distance_ends(notice, text):
    """For each end in text: the least edits of any substring that ends there (Sellers)."""
    column = list(range(len(notice) + 1))
    out = [column[-1]]
    for c in text:
        before, column = column, [0]
        for k, x in enumerate(notice, 1):
            column.append(min(before[k] + 1, column[k - 1] + 1, before[k - 1] + (x != c)))
        out.append(column[-1])
    return out


def test_license_scan_finds_every_edited_notice():
    r = random.Random(4)
    scanner = licenses.Scanner()
    for _ in range(150):
        parts, planted = [], 0
        for _ in range(r.randrange(1, 4)):
            n = r.randrange(len(licenses.NOTICES))
            notice = list(licenses.NOTICES[n][1])
            for _ in range(r.randrange(0, licenses.edits(licenses.NOTICES[n][1]) + 3)):
                p = r.randrange(1, len(notice) - 1)
                notice[p : p + 1] = r.choice([[], ["q"], [notice[p], "q"]])
            parts.append("".join(notice))
            parts.append(" ".join(words(r.randrange(10**6), r.randrange(0, 3))))
        text = " " + " ".join(" ".join(parts).split()) + " "
        _, near = scanner.scan(text)
        for n, (_, notice) in enumerate(licenses.NOTICES):
            ends = edit_distance_ends(notice, text)
            own = [(a, b, e) for k, a, b, e in near if k == n]
            assert all(e <= licenses.edits(notice) and ends[b] <= e for _, b, e in own)
            size = len(notice) + licenses.edits(notice)
            for end in [k for k, d in enumerate(ends) if d <= licenses.edits(notice)]:  # every good end is in or beside a match
                assert any(a <= end <= b or end - size < b <= end or a <= end + size and a >= end - size for a, b, _ in own)


def test_license_scan_takes_adjacent_notices(spark):
    exact = licenses.NOTICES[4][1]
    edited = exact.replace("licensed", "licnsed").replace("version", "versoin")
    rows = [(1, f"{edited} {exact}"), (2, f"{exact} {exact}"), (3, f"{exact} x {edited} y {exact}"), (3, f"{exact} x {edited} y {exact}"), (None, "word " * 200_000 + exact)]
    got = licenses.license_scan(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, matches string")).collect()
    count = lambda r: sum(m.notice == 4 for m in r.matches)
    assert sorted((r.doc_id or 0, count(r)) for r in got) == [(0, 1), (1, 2), (2, 2), (3, 3), (3, 3)]


def test_decontamination_in_blocks(spark, monkeypatch):
    """A benchmark of several blocks, with null ids, repeated rows and long texts, gives what one automaton gives."""
    items = [(k, " ".join(words(4000 + k, 14))) for k in range(40)] + [(None, " ".join(words(3999, 12))), (40, "Short item"), (41, None), (42, "")]
    rows = [(k, " ".join([*words(k, 20), *words(4000 + k, 14)[1:13], *words(k + 1, 5)])) for k in range(0, 60, 2)] + [(1, " ".join(words(3999, 12))), (1, " ".join(words(3999, 12))), (None, None), (7, "a short ITEM"), (8, " ".join(words(1, 30_000) + words(4003, 14)))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_hit int, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.find_windows(docs, bench).collect()))
    kept = sorted(map(str, decontaminate.without_hits(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 400)
    assert sorted(map(str, decontaminate.find_windows(docs, bench).collect())) == whole
    assert sorted(map(str, decontaminate.without_hits(docs, bench).collect())) == kept
    got = {r.doc_id: r for r in decontaminate.find_windows(docs, bench).collect()}
    assert (got[1].n_hit, got[1].item_ids) == (12, []) and got[7].item_ids == ["40"] and got[8].item_ids == ["3"] and len(kept) == 11


def plain_agenda(v, unit, key, limit):
    """One unit merged by scanning for the best candidate each time; a candidate's draw is made when it first comes up."""
    ids, at = v.characters(np.frombuffer(unit, np.uint8))
    symbols = [(int(i), int(p)) for i, p in zip(ids, at, strict=True)]
    ends = [p for _, p in symbols[1:]] + [len(unit)]
    one = lambda x: np.array([x])
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (a, p), (b, _) = symbols[k], symbols[k + 1]
            slot = v.look(one(a), one(b))[0]
            rank = int(v.slot_rank[slot])
            if rank == pieces.NONE or pieces._skipped(one(key), pieces._codes(one(p), one(a), one(b)), limit)[0]:
                continue
            if best is None or rank < best[0]:
                best = (rank, k, int(v.slot_id[slot]))
        if best is None:
            break
        _, k, merged = best
        symbols[k] = (merged, symbols[k][1])
        del symbols[k + 1]
        ends[k : k + 2] = [ends[k + 1]]
    return [x for (i, p), e in zip(symbols, ends, strict=True) for x in ([i] if i >= 0 else v.byte_id[np.frombuffer(unit[p:e], np.uint8)].tolist())]


def test_each_occurrence_has_its_own_draws():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        v = pieces.Vocabulary(f.read())
    text = (" international" * 300 + " über naïve!").encode()
    encoder = pieces.Encoder(v, 3, 0.2)
    ids, _ = encoder.encode([text], np.array([11]))
    block = np.frombuffer(text + b"\n", np.uint8)
    edges = np.flatnonzero(np.r_[True, ~v.inside[block[:-1], block[1:]], True])
    units = [text[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < len(text)]
    keys = encoder.keys(np.full(len(units), 11), np.arange(len(units)))
    plain = [plain_agenda(v, u, k, encoder.limit) for u, k in zip(units, keys, strict=True)]
    assert ids.tolist() == [x for own in plain for x in own]
    assert len({tuple(own) for u, own in zip(units, plain, strict=True) if u == b" international"}) > 8


def test_toxicity_on_labels(spark):
    """Held-out accuracy on the labelled documents, and the noisy-or of a plain count over sentences."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).select("doc_id", "score").collect()}
    held = [(r.toxic, scores[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = [s for y, s in held if not y], [s for y, s in held if y]
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert area > 0.95 and len(bad) >= 30
    texts_ = ["One two three. Four five! grobian six\nseven", "", "no end", "?!."]
    block, feature, sentence, owner, _, _ = toxicity.bags([t.encode() for t in texts_])
    small = toxicity.Model(np.linspace(-1, 1, 1 << toxicity.BITS).astype(np.float32), -0.5)
    expected = []
    for d in range(len(texts_)):
        keep = 1.0
        for s in np.flatnonzero(owner == d):
            keep *= 1 - 1 / (1 + math.exp(0.5 - sum(float(small.weights[f]) for f, x in zip(feature, sentence, strict=True) if x == s)))
        expected.append(1 - keep)
    assert toxicity.score_texts(small, [t.encode() for t in texts_])["score"] == pytest.approx(expected)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, ("long " * 4000 if i % 2 else "short bad. ") * 3) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(200)], "doc_id long, toxic int")
    assert isinstance(toxicity.train(docs, labels, max_bytes=20_000), toxicity.Model)


@pytest.mark.parametrize("covered, longest", [(0.2, 40), (1.0, 40), (0.2, 10**6), (0.02, 6)])
def test_quality_verdict(covered, longest):
    """kept against a plain rule: share of characters in repeats of five words and more, and the longest repeat."""
    r = random.Random(8)
    many = [" ".join([*words(k, r.randrange(5, 200)), *(words(k, 60)[: r.randrange(0, 60)] * r.randrange(0, 3)), *words(k + 500, r.randrange(0, 400))]) for k in range(60)]
    many += [" ".join([*words(900 + k, 3000, 10**6), *words(77, 45 + k)[:39 + k], "mid", *words(77, 45 + k)[:39 + k]]) for k in range(4)]
    got = quality.rate([t.encode() for t in many], covered, longest)
    for t, kept, failed in zip(many, got["kept"], got["base_failed"], strict=True):
        w = t.split()
        grams: dict = {}
        for k in range(len(w) - 4):
            grams.setdefault(tuple(w[k : k + 5]), []).append(k)
        inside, most = set(), 0
        for own in grams.values():
            for a, b in itertools.combinations(own, 2):
                n = 5
                while b + n < len(w) and w[a + n] == w[b + n]:
                    n += 1
                most = max(most, n)
            if len(own) > 1:
                inside |= {p for k in own for p in range(k, k + 5)}
        share = sum(len(w[p]) for p in inside) / max(sum(map(len, w)), 1)
        assert kept == (not failed and share <= covered and most <= longest)
