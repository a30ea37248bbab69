"""Folds over time: rules by hand, streams against tables, late rows and restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from scholia.sources.readers import scratch
from scholia.streaming import live

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
US = int(START.timestamp() * 1e6)


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(fold, *events):
    """(seconds, *rest) of the outputs of (seconds, kind, ref, amount) events of one key."""
    state = fold.start()
    rows = [(US + int(s * 1e6), n, kind, ref, amount) for n, (s, kind, ref, amount) in enumerate(events)]
    return [((r[0] - US) / 1e6, *r[1:]) for r in live._advance(fold, state, rows, float("inf"))]


def test_leases_by_hand():
    e = lambda s, kind: (s, kind, None, None)
    assert run(live.Leases(), e(0, "lease"), e(30, "heartbeat"), e(80, "complete")) == [(0, "running", 1), (80, "succeeded", 1)]
    # the lease ends at 60; it cannot complete any more, but be taken again
    assert run(live.Leases(), e(0, "lease"), e(70, "complete"), e(71, "lease"), e(72, "complete")) == [(0, "running", 1), (60, "expired", 1), (71, "running", 2), (72, "succeeded", 2)]
    # a failure waits two seconds, then four; a lease while running or before the wait is over does nothing
    assert run(live.Leases(), e(0, "lease"), e(1, "lease"), e(2, "fail"), e(3, "lease"), e(4, "lease"), e(5, "fail"), e(9, "lease")) == [(0, "running", 1), (2, "retry_wait", 1), (4, "running", 2), (5, "retry_wait", 2), (9, "running", 3), (69, "expired", 3)]
    assert run(live.Leases(attempts=1), e(0, "lease"), e(1, "fail"), e(100, "lease")) == [(0, "running", 1), (1, "failed", 1)]


def test_spend_by_hand():
    got = run(live.Spend(10), (0, "reserve", "a", 6.0), (1, "reserve", "b", 5.0), (2, "settle", "a", 2.0), (3, "reserve", "c", 8.0), (4, "settle", "c", None), (5, "settle", "c", 1.0), (6, "reserve", "d", 0.1))
    assert got == [(0, "a", "accepted", 6.0), (1, "b", "refused", 6.0), (2, "a", "settled", 2.0), (3, "c", "accepted", 10.0), (4, "c", "settled", 10.0), (5, "c", "not_reserved", 10.0), (6, "d", "refused", 10.0)]


def test_codes_by_hand():
    verdicts = lambda *events: [r[2] for r in run(live.Codes(), *events)]
    assert verdicts((0, "issue", "1", None), (30, "issue", "2", None), (60, "issue", "3", None), (61, "verify", "1", None), (62, "verify", "3", None), (63, "verify", "3", None), (64, "issue", "4", None)) == ["issued", "limited", "issued", "invalid", "accepted", "expired", "issued"]
    assert verdicts(*((100 * k, "issue", str(k), None) for k in range(6)), (3601, "issue", "9", None)) == ["issued"] * 5 + ["refused", "issued"]
    assert verdicts((0, "issue", "1", None), *((k, "verify", "x", None) for k in range(1, 7)), (600, "verify", "1", None)) == ["issued", *["invalid"] * 4, "exhausted", "exhausted", "exhausted"]
    assert verdicts((0, "issue", "1", None), (600, "verify", "1", None)) == ["issued", "expired"]
    assert verdicts((0, "issue", "1", None), (1, "discard", "1", None), (2, "issue", "2", None), (3, "verify", "2", None)) == ["issued", "discarded", "issued", "accepted"]


def events(kinds, n, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "hot", "hot", "hot"]), at(r.randrange(2000)), k, r.choice(kinds), str(r.randrange(6)), r.choice([None, 1.0, 2.5, 4.0])) for k in range(n)]
    return [*rows, rows[0], (None, at(5), n, kinds[0], "1", 1.0), ("a", None, n + 1, kinds[0], "1", 1.0)]


FOLDS = [(live.Leases(), ["lease", "heartbeat", "complete", "fail"]), (live.Spend(20), ["reserve", "settle"]), (live.Codes(), ["issue", "verify", "discard"])]


@pytest.mark.parametrize(("fold", "kinds"), FOLDS, ids=["leases", "spend", "codes"])
def test_table_equals_one_run_for_each_key(spark, fold, kinds):
    rows = events(kinds, 300, 4)
    got = sorted(map(tuple, live.folded(fold, spark.createDataFrame(rows, live.EVENT).repartition(3)).collect()), key=repr)
    want = []
    for key in ("a", "b", "hot"):
        own = sorted({(int((t - START).total_seconds() * 1e6) + US, i, k, r, m) for x, t, i, k, r, m in rows if x == key and t is not None}, key=lambda r: r[:2])
        want += [(key, *r) for r in live._advance(fold, fold.start(), own, float("inf"))]
    assert got == sorted(want, key=repr) and len(want) > 10


@pytest.mark.parametrize(("fold", "kinds"), FOLDS, ids=["leases", "spend", "codes"])
def test_stream_equals_table_after_restarts_and_late_rows(spark, fold, kinds):
    """Three starts on one checkpoint; rows come out of order within the allowed lateness, one comes too late."""
    folder = scratch(spark)
    rows = events(kinds, 200, 8)
    rows.sort(key=lambda r: (r[1] or at(0), r[2]))
    late = [r for k, r in enumerate(rows) if k % 5 == 0]
    first, second = [r for r in rows if r not in late and (r[1] or at(0)) < at(1000)], [r for r in rows if r not in late and (r[1] or at(0)) >= at(1000)]
    waves = [first, second + late, [("hot", at(3), 9999, kinds[0], "1", 1.0), ("", at(10**7), 0, "end", None, None)]]
    stream = lambda: live.live(fold, spark.readStream.schema(live.EVENT).parquet(f"{folder}/in"), "40 minutes")
    for wave in waves:
        spark.createDataFrame(wave, live.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live.run_once(stream(), folder)
    # a third file after the watermark has passed everything: too late for the stream
    spark.createDataFrame([("a", at(50), 7777, kinds[0], "2", 1.0)], live.EVENT).write.mode("append").parquet(f"{folder}/in")
    live.run_once(stream(), folder)
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=repr)
    on_time = spark.createDataFrame([*rows, waves[2][0]], live.EVENT)
    assert got == sorted(map(tuple, live.folded(fold, on_time).collect()), key=repr)


def test_replay_of_a_table(spark):
    folder = scratch(spark)
    rows = events(["lease", "complete", "fail"], 120, 2)
    table = spark.createDataFrame(rows, live.EVENT)
    table.write.parquet(f"{folder}/in")
    got = live.replay(spark, live.Leases(), lambda: spark.readStream.schema(live.EVENT).parquet(f"{folder}/in"), f"{folder}/run", "1 hour")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, live.folded(live.Leases(), table).collect()), key=repr)


class _Store:
    """A state handle that keeps values in memory and counts calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getListState(self, name, schema):
        return _Kept(self, [])

    getMapState = lambda self, name, *schemas: _Kept(self, {})
    getValueState = lambda self, name, schema: _Kept(self, [])

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


class _Kept:
    def __init__(self, store, value):
        self.store, self.value = store, value

    def _call(self, result=None):
        self.store.calls += 1
        return result

    appendValue = lambda self, v: self._call(self.value.append(v))
    appendList = lambda self, vs: [self.appendValue(v) for v in vs]
    clear = lambda self: self._call(self.value.clear())
    exists = lambda self: self._call(bool(self.value))
    getValue = lambda self, k: self._call(self.value.get(k))
    updateValue = lambda self, k, v: self._call(self.value.update({k: v}))

    def get(self):
        return self._call(iter(list(self.value)) if len(self.value) != 1 else self.value)

    def update(self, v):
        self.value[:] = v
        self._call()


def test_calls_to_the_state_follow_keys_not_events():
    """30 keys of one group with 40 events each: a few calls a key, and the rows of each key's own fold."""
    import pandas as pd

    rows = [(f"k{i % 30}", 10_000_000 * (i * 7 % 1201), i, ("issue", "verify")[i % 2], str(i % 3), None) for i in range(1200)]
    store, processor = _Store(), live._Live(live.Codes())
    processor.init(store)
    part = pd.DataFrame(rows, columns=["key", "us", "id", "kind", "ref", "amount"])
    for x in (0, 600):
        assert list(processor.handleInputRows((0,), iter([part[x : x + 600]]), None)) == []

    class Passed:
        ms = 6_000_000

        def getCurrentWatermarkInMs(self):
            return self.ms

    got = list(processor.handleExpiredTimer((0,), Passed(), None))
    Passed.ms = 10**10
    got += list(processor.handleExpiredTimer((0,), Passed(), None))
    want = []
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        want += [(key, *r) for r in live._advance(live.Codes(), live.Codes().start(), own, float("inf"))]
    assert sorted(pd.concat(got).itertuples(index=False, name=None)) == sorted(want)
    assert store.calls < 6 * 30
