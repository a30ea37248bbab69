"""Stateful, time-dependent operators: batch folds, and the same over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .live import Spend, folded


def capped_spend(rows: DataFrame, keys: list[str], order: list[str], amount: Column, cap: float) -> DataFrame:
    """Per key in order (a time, and a number that tells rows of one time apart, if there is one): a reservation (of at least nothing) is accepted if what was accepted so far and it fit the cap; a refused one adds nothing.

    Rows of a key pass by sorted; only the sum is held.
    """
    number = F.col(order[1]).cast("long") if len(order) > 1 else F.monotonically_increasing_id()
    own = rows.select(F.to_json(F.struct(*keys)).alias("key"), F.col(order[0]).cast("timestamp").alias("at"), number.alias("id"), amount.cast("double").alias("amount"))
    events = own.select("key", "at", "id", F.lit("reserve").alias("kind"), F.col("id").cast("string").alias("ref"), "amount")
    verdicts = folded(Spend(cap), events)
    own = verdicts.groupBy("key").agg(F.max("spent").alias("used"), F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.count_if(F.col("verdict") == "refused").alias("refused"))
    back = F.from_json("key", ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)).alias("k")
    return own.select(back, "used", "accepted", "refused").select("k.*", "used", "accepted", "refused")


def daily_spend(stream: DataFrame, time: str, key: str, amount: str, late: str = "1 hour") -> DataFrame:
    """UTC-day tumbling sums with a watermark; works on streams and tables."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), key).agg(F.count("*").alias("n"), F.sum(amount).alias("total")).select(F.col("w.start").alias("day"), key, "n", "total")


def first_enqueue(stream: DataFrame, time: str, key: str, within: str = "1 day") -> DataFrame:
    """The first message of each idempotency key, forgotten after the watermark passes."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def job_states(stream: DataFrame, key: str, time: str, event: str, lease_ms: int | None = None) -> DataFrame:
    """Job state machine over ordered events of each job: attempts, and the state after its last event.

    In a stream each micro-batch folds its events into the state kept for the job.  With lease_ms a
    job without an event for that long returns to retry_wait (such a query never ends by itself).
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k, parts, state: GroupState):
        status, attempts = state.get if state.exists else ("queued", 0)
        if state.hasTimedOut:
            status = "retry_wait" if status == "running" else status
        for part in parts:
            for kind in part.sort_values(time)[event]:
                if kind == "lease":
                    status, attempts = "running", attempts + 1
                elif kind == "fail":
                    status = "failed" if attempts >= 3 else "retry_wait"
                elif kind == "complete":
                    status = "done"
        state.update((status, attempts))
        if lease_ms:
            state.setTimeoutDuration(lease_ms)
        yield pd.DataFrame({key: [k[0]], "status": [status], "attempts": [attempts]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.ProcessingTimeTimeout if lease_ms else GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there to an in-memory table, for tests and replays of small logs."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
