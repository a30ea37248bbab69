"""Streaming, state and late data (M), as batch queries over the event log; the stream forms are in streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds
from ..sources.readers import scratch
from ..streaming import live, stateful
from .registry import Tables, query


def _events(spark, sf):
    return Tables(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query("SELECT k, event_id FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id, row_number() OVER (PARTITION BY CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def m1_idempotent_enqueue(spark, sf):
    return _events(spark, sf).groupBy("k").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT event_id, event_type FROM events WHERE (event_type IN ('view', 'signup') AND ts <= TIMESTAMP '2024-01-15') OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-14 23:00:00') ORDER BY ts, event_id")
def m2_due_jobs(spark, sf):
    now = F.lit("2024-01-15").cast("timestamp")
    due = (F.col("event_type").isin("view", "signup") & (F.col("ts") <= now)) | ((F.col("event_type") == "click") & (F.col("ts") < now - F.expr("interval 1 hour")))
    return _events(spark, sf).where(due).orderBy("ts", "event_id").select("event_id", "event_type")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS attempts, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'done' WHEN 'error' THEN CASE WHEN count(*) FILTER (WHERE event_type = 'click') >= 3 THEN 'failed' ELSE 'retry_wait' END WHEN 'click' THEN 'running' ELSE 'queued' END AS status,
 least(60.0, pow(2.0, greatest(1, count(*) FILTER (WHERE event_type = 'error')))) AS backoff FROM events GROUP BY 1""")
def m3_job_state(spark, sf):
    attempts, last = F.count_if(F.col("event_type") == "click"), F.max_by("event_type", F.struct("ts", "event_id"))
    own = _events(spark, sf).groupBy("user_id").agg(attempts.alias("attempts"), last.alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"))
    status = F.when(F.col("last") == "purchase", "done").when(F.col("last") == "error", F.when(F.col("attempts") >= 3, "failed").otherwise("retry_wait")).when(F.col("last") == "click", "running").otherwise("queued")
    return own.select("user_id", "attempts", status.alias("status"), backoff_seconds(F.col("errors")).alias("backoff"))


@query("""WITH RECURSIVE x AS (SELECT CAST(ts AS DATE) AS day, event_type, CAST(round(value * 100) AS BIGINT) AS a, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT day, event_type, n, CASE WHEN a <= 40000 THEN a ELSE 0 END AS used, CASE WHEN a <= 40000 THEN 1 ELSE 0 END AS acc FROM x WHERE n = 1 UNION ALL SELECT f.day, f.event_type, x.n, CASE WHEN used + a <= 40000 THEN used + a ELSE used END, acc + CASE WHEN used + a <= 40000 THEN 1 ELSE 0 END FROM f JOIN x ON x.day = f.day AND x.event_type = f.event_type AND x.n = f.n + 1)
SELECT day, event_type, CAST(arg_max(used, n) AS DOUBLE) AS used, CAST(arg_max(acc, n) AS BIGINT) AS accepted, CAST(max(n) - arg_max(acc, n) AS BIGINT) AS refused FROM f GROUP BY 1, 2""")
def m4_capped_daily_spend(spark, sf):
    own = _events(spark, sf).withColumn("day", F.to_date("ts"))
    return stateful.capped_spend(own, ["day", "event_type"], ["ts", "event_id"], F.round(F.col("value") * 100).cast("double"), 40000.0)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def m4b_tumbling_day(spark, sf):
    own = stateful.daily_spend(_events(spark, sf), "ts", "event_type", "value")
    return own.select(F.to_date("day").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used, count(*) >= 3 AS refused FROM events WHERE event_type IN ('view', 'error') GROUP BY 1, 2")
def m5_daily_quota(spark, sf):
    return _events(spark, sf).where("event_type in ('view', 'error')").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"), (F.count("*") >= 3).alias("refused"))


@query("""SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w < 60000000, false) AS too_soon, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 5 AS too_many FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def m6_rate_limit(spark, sf):
    own = _events(spark, sf).withColumn("us", F.unix_micros("ts"))
    hour = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return own.select("event_id", F.coalesce(F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id")) < 60_000_000, F.lit(False)).alias("too_soon"), (F.count("*").over(hour) > 5).alias("too_many"))


@query("SELECT event_id, ts + INTERVAL 600 SECOND > TIMESTAMP '2024-01-20' AS live FROM events")
def m7_ttl(spark, sf):
    return _events(spark, sf).select("event_id", (F.col("ts") + F.expr("interval 600 seconds") > F.lit("2024-01-20").cast("timestamp")).alias("live"))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-10' THEN 'interrupted' ELSE event_type END AS status FROM events")
def m8_stale_sweep(spark, sf):
    stale = (F.col("event_type") == "view") & (F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    return _events(spark, sf).select("event_id", F.when(stale, "interrupted").otherwise(F.col("event_type")).alias("status"))


@query("SELECT event_type AS partition, max(event_id) AS cursor FROM events GROUP BY 1")
def m9_source_checkpoints(spark, sf):
    return _events(spark, sf).groupBy(F.col("event_type").alias("partition")).agg(F.max("event_id").alias("cursor"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS terminal, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) = 1 AS ok FROM events GROUP BY 1")
def m10_one_terminal_event(spark, sf):
    n = F.count_if(F.col("event_type").isin("purchase", "error"))
    return _events(spark, sf).groupBy("user_id").agg(n.alias("terminal"), (n == 1).alias("ok"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def m11_resumable_campaign(spark, sf):
    own = _events(spark, sf)
    return own.select("user_id").distinct().join(own.where("event_type = 'purchase'"), "user_id", "left_anti")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 OR gap GROUP BY 1")
def m12_sessions(spark, sf):
    """Our own addition: sessions that close after six hours without an event."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    own = _events(spark, sf).withColumn("us", F.unix_micros("ts"))
    opens = F.coalesce(F.col("us") - F.lag("us").over(w) > 6 * 3_600_000_000, F.lit(True))
    return own.select("user_id", opens.alias("o")).where("o").groupBy("user_id").agg(F.count("*").alias("sessions"))


def _click_events(rows, key, kind, ref, amount=None):
    """Clicks as events of live folds, by the time at which they happened."""
    amount = F.lit(None).cast("double") if amount is None else amount
    return rows.select(key.cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("click_id").alias("id"), kind.alias("kind"), ref.cast("string").alias("ref"), amount.alias("amount"))


def _replayed(spark, sf, fold, events):
    """The stream form of a fold over the clicks, started twice on one checkpoint; nothing comes later than ten days."""
    path = f"{sf}/clicks.parquet"
    stream = lambda: events(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))  # noqa: E731  a file, or a folder of them
    return live.replay(spark, fold, stream, scratch(spark), "10 days")


@query()
def m2_live_leases(spark, sf):
    """Each client's job: views lease it, clicks extend, purchases complete, errors fail; timers end what nobody ends."""
    names = F.create_map(*[F.lit(x) for x in ("view", "lease", "click", "heartbeat", "purchase", "complete", "error", "fail")])
    events = lambda c: _click_events(c, F.col("client_id"), names[F.col("kind")], F.lit(None))
    return _replayed(spark, sf, live.Leases(), events).withColumnRenamed("key", "client")


_RESERVED = "SELECT day, a, row_number() OVER (PARTITION BY day ORDER BY ts, click_id) AS n FROM (SELECT DISTINCT ts, click_id, CAST(ts AS DATE) AS day, CAST(round(greatest(value, 0) * 1000000) AS BIGINT) AS a FROM clicks WHERE ts IS NOT NULL AND value IS NOT NULL)"


@query(f"""WITH RECURSIVE x AS ({_RESERVED}), f AS (SELECT day, n, CASE WHEN a <= 900000000 THEN a ELSE 0 END AS used, CASE WHEN a <= 900000000 THEN 1 ELSE 0 END AS acc FROM x WHERE n = 1
 UNION ALL SELECT f.day, x.n, CASE WHEN used + a <= 900000000 THEN used + a ELSE used END, acc + CASE WHEN used + a <= 900000000 THEN 1 ELSE 0 END FROM f JOIN x ON x.day = f.day AND x.n = f.n + 1)
SELECT CAST(day AS VARCHAR) AS day, CAST(max(acc) AS BIGINT) AS accepted, CAST(max(n) - max(acc) AS BIGINT) AS refused, arg_max(used, n) / 1000000.0 AS spent FROM f GROUP BY 1""")
def m4_live_spend(spark, sf):
    """The day's cap as a stream: each click reserves its value, what does not fit is refused."""
    events = lambda c: _click_events(c, F.to_date("ts"), F.lit("reserve"), F.col("click_id"), F.when(F.col("value") > 0, F.col("value")).when(F.col("value").isNotNull(), 0.0))
    out = _replayed(spark, sf, live.Spend(900.0), events)
    return out.groupBy(F.col("key").alias("day")).agg(F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.count_if(F.col("verdict") == "refused").alias("refused"), F.max("spent").alias("spent"))


@query()
def m6_live_codes(spark, sf):
    """Sign-in codes of each client: clicks and errors issue one, views try the last digit of their id, purchases the right one's."""
    kind = F.when(F.col("kind").isin("click", "error"), "issue").when(F.col("kind").isin("view", "purchase"), "verify")
    events = lambda c: _click_events(c, F.col("client_id"), kind, F.col("click_id") % 3)
    return _replayed(spark, sf, live.Codes(), events).withColumnRenamed("key", "client")
