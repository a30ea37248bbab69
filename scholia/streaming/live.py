"""Rules over time as folds of ordered events: leases, capped spend and sign-in codes, live or in batch.

A fold sees the events of one key in the order of (time, id) and may set a deadline that passes
without an event.  folded() runs it over a table, live() over a stream: there events wait in the
state until the watermark has passed them, so the order is that of the table whatever the order of
arrival, and event-time timers end what no event ends.  Both give the same rows; only what comes
later than the watermark allows is missing from the stream.  A restart goes on from its checkpoint.

Events have the columns key, at, id, kind, ref and amount.  Rows without key or time are left out, a
row that repeats the (key, time, id) of the one before counts once.  A table's rows pass by sorted, so
the state of one key is held; a stream's wait for the watermark, and a task holds those that wait for
the keys of one of SLOTS groups.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

EVENT = "key string, at timestamp, id long, kind string, ref string, amount double"
_ROW = ("us", "id", "kind", "ref", "amount")
SECOND = 1_000_000
#: Events that wait in one value of a stream's state.
CHUNK = 8192
#: A stream's keys are grouped by hash, as each group costs calls to the state store in each batch.
SLOTS = 4096
# Fixed values of the rules.
LEASE_SECONDS, MAX_ATTEMPTS, BACKOFF_SECONDS = 60, 5, 60
RESEND_SECONDS, CODES_PER_HOUR, CODE_SECONDS, CODE_ATTEMPTS = 60, 5, 600, 5


class Fold:
    """Times are microseconds.  step() and expire() change the state and give output rows without the key."""

    output = ""  # columns after the key

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, state: dict, at: int, kind: str, ref: str | None, amount: float | None) -> Iterable[tuple]:
        raise NotImplementedError

    def deadline(self, state: dict) -> int | None:
        return None

    def expire(self, state: dict) -> Iterable[tuple]:
        return ()


class Leases(Fold):
    """A queued job is leased for some time; only a live lease can be extended, completed or failed; a lease that ends makes the job due again."""

    output = "us long, status string, attempt int"

    def __init__(self, seconds: int = LEASE_SECONDS, attempts: int = MAX_ATTEMPTS):
        self.lease, self.attempts = seconds * SECOND, attempts

    def start(self):
        return {"status": "queued", "attempt": 0, "until": None, "next": None}

    def step(self, s, at, kind, ref, amount):
        live = s["status"] == "running" and s["until"] > at
        if kind == "lease" and (s["status"] == "expired" or (s["status"] in ("queued", "retry_wait") and (s["next"] is None or s["next"] <= at))):
            s |= {"status": "running", "attempt": s["attempt"] + 1, "until": at + self.lease, "next": None}
        elif kind == "heartbeat" and live:
            s["until"] = at + self.lease
            return ()
        elif kind == "complete" and live:
            s |= {"status": "succeeded", "until": None}
        elif kind == "fail" and live:
            wait = min(BACKOFF_SECONDS, 2 ** max(1, s["attempt"])) * SECOND
            s |= {"status": "failed", "until": None} if s["attempt"] >= self.attempts else {"status": "retry_wait", "until": None, "next": at + wait}
        else:
            return ()
        return ((at, s["status"], s["attempt"]),)

    def deadline(self, s):
        return s["until"]

    def expire(self, s):
        at = s["until"]
        s |= {"status": "expired", "until": None}
        return ((at, "expired", s["attempt"]),)


class Spend(Fold):
    """Reservations against the cap of one key (a day): what does not fit is refused and adds nothing; a settled call counts at its cost.  Open calls of a day are in the state."""

    output = "us long, ref string, verdict string, spent double"

    def __init__(self, cap: float):
        self.cap = round(cap * 1e6)

    def start(self):
        return {"spent": 0, "open": {}}

    def step(self, s, at, kind, ref, amount):
        amount = None if amount is None or math.isnan(amount) else round(amount * 1e6)
        if kind == "reserve" and amount is not None:
            fits = s["spent"] + amount <= self.cap and ref not in s["open"]
            if fits:
                s["open"][ref] = amount
                s["spent"] += amount
            verdict = "accepted" if fits else "refused"
        elif kind == "settle":
            held = s["open"].pop(ref, None)
            s["spent"] += 0 if held is None or amount is None else amount - held
            verdict = "not_reserved" if held is None else "settled"
        else:
            return ()
        return ((at, ref, verdict, s["spent"] / 1e6),)


class Codes(Fold):
    """Sign-in codes: one a minute unless the last is used, some an hour, each for a while and a number of tries."""

    output = "us long, ref string, verdict string"

    def start(self):
        return {"codes": []}  # of the last hour: created, code, tries, used

    def step(self, s, at, kind, ref, amount):
        s["codes"] = [c for c in s["codes"] if c["at"] > at - 3600 * SECOND]
        newest = s["codes"][-1] if s["codes"] else None
        if kind == "issue":
            if newest and not newest["used"] and at - newest["at"] < RESEND_SECONDS * SECOND:
                verdict = "limited"
            elif len(s["codes"]) >= CODES_PER_HOUR:
                verdict = "refused"
            else:
                for c in s["codes"]:
                    c["used"] = True
                s["codes"].append({"at": at, "code": ref, "tries": 0, "used": False})
                verdict = "issued"
        elif kind == "verify":
            if newest is None or newest["used"]:
                verdict = "expired"
            elif newest["tries"] >= CODE_ATTEMPTS:
                verdict = "exhausted"
            elif newest["at"] + CODE_SECONDS * SECOND <= at:
                verdict = "expired"
            elif newest["code"] == ref:
                newest["used"], verdict = True, "accepted"
            else:
                newest["tries"] += 1
                verdict = "exhausted" if newest["tries"] >= CODE_ATTEMPTS else "invalid"
        elif kind == "discard" and newest:
            s["codes"].pop()
            verdict = "discarded"
        else:
            return ()
        return ((at, ref, verdict),)


def _advance(fold: Fold, state: dict, rows: Iterable[tuple], until: float) -> Iterator[tuple]:
    """Outputs of rows (us, id, kind, ref, amount) in order, and of deadlines before them and before `until`."""
    for us, number, kind, ref, amount in rows:
        if state.get("last") == [us, number]:
            continue
        state["last"] = [us, number]
        end = fold.deadline(state)
        if end is not None and end < us:
            yield from fold.expire(state)
        yield from fold.step(state, us, kind, ref, amount)
    end = fold.deadline(state)
    if end is not None and end < until:
        yield from fold.expire(state)


def _schema(fold: Fold) -> str:
    return f"key string, {fold.output}"


def _rows(part: pd.DataFrame) -> list[tuple]:
    """Rows (us, id, kind, ref, amount) of plain values, column by column."""
    columns = []
    for name in _ROW:
        column = part[name]
        values = column.tolist()
        columns.append([None if gone else v for v, gone in zip(values, column.isna(), strict=True)] if column.hasnans else values)
    columns[1] = [None if v is None else int(v) for v in columns[1]]
    return list(zip(*columns, strict=True))


def _frame(rows: list[tuple], fold: Fold) -> pd.DataFrame:
    names = [c.split()[0] for c in fold.output.split(", ")]
    return pd.DataFrame(rows, columns=["key", *names])


def folded(fold: Fold, events: DataFrame) -> DataFrame:
    """The fold of every key of a table: rows pass by sorted, each task holding one key's state."""
    rows = events.where("key is not null and at is not null").select("key", F.unix_micros("at").alias("us"), "id", "kind", "ref", "amount")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for part in parts:
            for own, group in part.groupby("key", sort=False):
                if own != key:
                    if key is not None:
                        yield _frame([(key, *r) for r in _advance(fold, state, (), math.inf)], fold)
                    key, state = own, fold.start()
                yield _frame([(key, *r) for r in _advance(fold, state, _rows(group), -math.inf)], fold)
        if key is not None:
            yield _frame([(key, *r) for r in _advance(fold, state, (), math.inf)], fold)

    return rows.repartition("key").sortWithinPartitions("key", "us", "id").mapInPandas(run, _schema(fold))


class _Live(StatefulProcessor):
    """The keys of one slot: their waiting events in lists of CHUNK rows (or of one batch), so that a list, not an event, is a value of the state; the state of each key; and the keys with a deadline."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.states = handle.getMapState("states", "key string", "json string")
        self.due = handle.getValueState("due", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for part in rows:
            if len(part):
                self.waiting.appendValue((json.dumps(list(zip(part["key"].tolist(), _rows(part), strict=True))),))
                first.append(int(part["us"].min()))
        if first:
            self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = json.loads(self.due.get()[0]) if self.due.exists() else {}
        ready: dict[str, list] = {own: [] for own, end in due.items() if end < passed}
        later, some = [], False
        for chunk in self.waiting.get():
            for own, row in json.loads(chunk[0]):
                if row[0] <= passed:
                    ready.setdefault(own, []).append(row)
                    some = True
                else:
                    later.append((own, row))
        out = []
        for own, rows in ready.items():
            rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
            old = self.states.getValue((own,))
            state = self.fold.start() if old is None else json.loads(old[0])
            out.extend((own, *r) for r in _advance(self.fold, state, rows, passed))
            self.states.updateValue((own,), (json.dumps(state),))
            due.pop(own, None)
            if (end := self.fold.deadline(state)) is not None:
                due[own] = end
        if ready:
            self.due.update((json.dumps(due),))
        if some:
            self.waiting.clear()
            for k in range(0, len(later), CHUNK):
                self.waiting.appendValue((json.dumps(later[k : k + CHUNK]),))
        ends = [*due.values(), *([min(row[0] for _, row in later)] if later else [])]
        if ends:
            self._wake(min(ends))
        if out:
            yield _frame(out, self.fold)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


def live(fold: Fold, events: DataFrame, late: str) -> DataFrame:
    """The fold of every key of a stream, its events put in order within the allowed lateness."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.where("key is not null and at is not null").withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int"))
    return rows.groupBy("slot").transformWithStateInPandas(_Live(fold), _schema(fold), "Append", "EventTime")


def run_once(stream: DataFrame, folder: str) -> None:
    """Process what is there, from the checkpoint in the folder on, into its table."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def replay(spark: SparkSession, fold: Fold, events: Callable[[], DataFrame], folder: str, late: str) -> DataFrame:
    """A stream run over a finished table: once over its rows, and, started again, over an end that lets all timers pass."""
    none = spark.createDataFrame([], EVENT)
    none.write.mode("overwrite").parquet(f"{folder}/end")
    for ended in (False, True):
        if ended:
            spark.sql("select '' as key, timestamp'2200-01-01' as at, 0L as id, 'end' as kind, cast(null as string) as ref, cast(null as double) as amount").write.mode("append").parquet(f"{folder}/end")
        run_once(live(fold, events().unionByName(spark.readStream.schema(EVENT).parquet(f"{folder}/end")), late), folder)
    return spark.read.schema(_schema(fold)).parquet(f"{folder}/out")
