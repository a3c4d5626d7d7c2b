"""Queries of F6-F9 (batch) and 2N (streams) over the events table.

Stream queries run to the end of the available files and return what the sink holds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermark.operators import windows
from quartermark.sources.sinks import scratch_path
from quartermark.streaming import events as E
from quartermark.workload import base as B
from quartermark.workload.base import query, r6

SIGNED = "CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


def _events(spark, sf):
    return B.table(spark, sf, "events")


def _sign():
    return F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", -1).otherwise(0)


@query("F6_running_totals_by_key", f"""
SELECT event_id, user_id, CAST(sum({SIGNED} * floor(value)) OVER w AS BIGINT) AS total, CAST(sum({SIGNED}) OVER w AS BIGINT) AS items FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(spark, sf):
    rows = _events(spark, sf).select("event_id", "user_id", "ts", "event_type", "value")
    sums = {"total": _sign() * F.floor("value"), "items": _sign().cast("long")}
    return windows.running_sums(rows, ["user_id"], ["ts", "event_id"], sums).select("event_id", "user_id", "total", "items")


@query("F6_running_totals_overall", f"SELECT event_id, CAST(sum({SIGNED} * floor(value)) OVER (ORDER BY ts, event_id) AS BIGINT) AS total FROM events")
def _(spark, sf):
    rows = _events(spark, sf).select("event_id", "ts", "event_type", "value")
    return windows.running_sums(rows, [], ["ts", "event_id"], {"total": _sign() * F.floor("value")}).select("event_id", "total")


@query("F7_last_n", "SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def _(spark, sf):
    rows = _events(spark, sf).select("event_id", "user_id", "ts", "value")
    return windows.last_n(rows, ["user_id"], ["ts", "event_id"], 20).drop("ts")


@query("F8_gaps", """
SELECT event_id, CASE WHEN g > 0 AND g < 36000000000 THEN g END AS gap_us, CAST(count(*) FILTER (WHERE g > 7200000000 AND g < 36000000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS long_gaps
FROM (SELECT event_id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)""")
def _(spark, sf):
    rows = _events(spark, sf).select("event_id", "user_id", "ts")
    return windows.gaps(rows, ["user_id"], "ts", "event_id", 7200, 36000).select("event_id", "gap_us", "long_gaps")


@query("F9_ema", """
SELECT user_id, count(*) AS n_events, round(sum(value * 0.1::DOUBLE * pow(0.9::DOUBLE, age)) + 60 * pow(0.9::DOUBLE, count(*)), 6) AS ema
FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events) GROUP BY 1""")
def _(spark, sf):
    return windows.ema(_events(spark, sf), ["user_id"], ["ts", "event_id"], "value", 0.1, 60.0).withColumn("ema", r6("ema"))


# --- streams ----------------------------------------------------------------------


def _source(spark, sf, delay="40 days"):
    return E.event_stream(spark, f"{sf}/events.parquet*", delay)


def _drain(df, mode, spark, keys=None, place=None):
    """Run a stream over the available files and return what its sink holds at the end: every row in
    append mode, the last batch in complete mode, the last row per key in update mode. `place` is the
    sink and checkpoint of an earlier run to go on from."""
    out, check = place or (scratch_path(spark, "stream"), scratch_path(spark, "offsets"))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.foreachBatch(keep).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif mode == "update":
        rows = windows.latest_row(rows, keys, "batch")
    return rows.drop("batch")


def _rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.ROCKSDB)


@query("N1_event_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    """All events, then the oldest ones once more: these are behind the watermark and must not count."""
    events, landing = _events(spark, sf), scratch_path(spark, "landing")
    place = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    oldest = events.filter(F.col("ts") < events.agg(F.min("ts") + F.expr("interval 5 days")).scalar())
    for part in (events, oldest):
        part.write.mode("append").parquet(landing)
        days = E.window_counts(E.event_stream(spark, landing, "2 days"), "1 day", keys=["event_type"])
        rows = _drain(days, "update", spark, ["start", "event_type"], place)
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("N2_running_totals", """
SELECT layer, CAST(sum(CASE WHEN reason = 'load' THEN bytes ELSE -coalesce(CASE WHEN prev_reason = 'load' THEN prev_bytes END, 0) END) AS BIGINT) AS total_bytes,
  CAST(sum(CASE WHEN reason = 'load' THEN 1 ELSE -1 END) AS BIGINT) AS item_count
FROM (SELECT *, lag(reason) OVER w AS prev_reason, lag(bytes) OVER w AS prev_bytes FROM
  (SELECT CAST(user_id % 10 AS VARCHAR) AS layer, CAST(user_id AS VARCHAR) AS item, ts, event_id, CAST(value AS BIGINT) AS bytes, CASE event_type WHEN 'view' THEN 'load' ELSE 'unload' END AS reason
   FROM (SELECT * REPLACE (trunc(value) AS value) FROM events) WHERE event_type IN ('view', 'error')) WINDOW w AS (PARTITION BY layer, item ORDER BY ts, event_id)) GROUP BY ROLLUP (layer)""")
def _(spark, sf):
    _rocksdb(spark)
    src = _source(spark, sf).withColumn("layer", F.col("user_id") % 10)
    out, check = scratch_path(spark, "deltas"), scratch_path(spark, "offsets")
    E.write_running_totals(E.signed_events(src, "layer", "user_id", "value", "view", "error"), out, check).awaitTermination()
    return E.running_totals(spark.read.schema(E.DELTA).parquet(out)).drop("started_at")


@query("N3_ema_stream", """
SELECT CAST(user_id AS VARCHAR) AS key, count(*) FILTER (WHERE ok AND g > 7.2e9) AS long_gaps, count(*) FILTER (WHERE ok) AS n_gaps,
  CAST(least(120, count(*) FILTER (WHERE ok)) AS INTEGER) AS history,
  round(60 * pow(0.9::DOUBLE, count(*) FILTER (WHERE ok)) + coalesce(sum(0.1::DOUBLE * pow(0.9::DOUBLE, age) / (g / 1e6::DOUBLE)) FILTER (WHERE ok), 0), 6) AS ema
FROM (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM
 (SELECT *, coalesce(g > 0 AND g < 3.6e10, false) AS ok FROM
  (SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events))) GROUP BY 1""")
def _(spark, sf):
    _rocksdb(spark)
    return _drain(E.ema_stream(_source(spark, sf), "user_id", 0.1, 60.0, 7200, 36000), "update", spark, ["key"]).withColumn("ema", r6("ema"))


WINDOW_SQL = """SELECT time_bucket(INTERVAL {size}, ts) AS start, time_bucket(INTERVAL {size}, ts) + INTERVAL {size} AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""


def _rounded(df):
    return df.withColumn("total", r6("total", 4)).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("N4_tumbling_counts", WINDOW_SQL.format(size="6 HOUR"))
def _(spark, sf):
    return _rounded(_drain(E.window_counts(_source(spark, sf), "6 hours", keys=["event_type"]), "complete", spark))


@query("N4_sliding_counts", """
SELECT s AS start, s + INTERVAL 12 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM
(SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS s FROM events CROSS JOIN (VALUES (0), (1)) v(k)) GROUP BY ALL""")
def _(spark, sf):
    return _rounded(_drain(E.window_counts(_source(spark, sf), "12 hours", "6 hours", keys=["event_type"]), "complete", spark))


@query("N4_session_counts", """
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM
(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM
 (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, sid""")
def _(spark, sf):
    return _rounded(_drain(E.window_counts(_source(spark, sf), "", gap="2 hours", keys=["user_id"]), "complete", spark))


@query("N5_latest_stream", "SELECT user_id, arg_max(value, ts) AS value, CAST(max(ts) AS TIMESTAMP) AS ts FROM events GROUP BY 1")
def _(spark, sf):
    out = _drain(E.latest_stream(_source(spark, sf), ["user_id"]), "complete", spark)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("N6_coverage_stream", """
SELECT CASE geospatial_type WHEN 'suburb' THEN 'sal' ELSE 'lga' END AS tier, dwelling_type, bedrooms, 'observed' AS source_class, count(DISTINCT polygon) AS region_count
FROM (SELECT *, unnest(string_split(geospatial_codes, '-')) AS polygon FROM obs WHERE statistic = 'median') GROUP BY ALL""")
def _(spark, sf):
    _rocksdb(spark)
    landing, counts = scratch_path(spark, "landing"), scratch_path(spark, "coverage")
    rows = B.obs(spark, sf).filter(F.col("statistic") == "median")
    rows.repartition(3, "geospatial_codes").write.parquet(landing)
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    E.coverage_stream(src, counts, scratch_path(spark, "offsets")).awaitTermination()
    return E.coverage_counts(spark.read.parquet(counts))
