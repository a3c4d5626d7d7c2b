"""2N: Structured Streaming jobs over an event feed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quartermark.functions import columns as C
from quartermark.sources.sinks import replace_slice

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(
    spark: SparkSession, path: str, delay: str, schema: T.StructType = EVENT_SCHEMA, max_files: int | None = None
) -> DataFrame:
    """N1. Event files as a stream; rows more than `delay` behind the newest event time of earlier
    batches are dropped by the stateful jobs downstream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withWatermark("ts", delay)


def signed_events(events: DataFrame, layer: str, item: str, size: str, load: str, unload: str) -> DataFrame:
    """Events in the shape (ts, event_id, layer, item, bytes, reason) of load and unload."""
    reason = F.when(F.col("event_type") == load, "load").when(F.col("event_type") == unload, "unload")
    return events.select(
        "ts", "event_id", F.col(layer).cast("string").alias("layer"), F.col(item).cast("string").alias("item"), F.col(size).cast("long").alias("bytes"), reason.alias("reason")
    ).filter(F.col("reason").isNotNull())


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of one call: a key's rows arrive in several pieces, in no order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable", ignore_index=True)


class Expiring(StatefulProcessor):
    """State of a key goes once event time is `ttl_ms` past its newest event; without a limit it stays."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def keep_until(self, newest: pd.Timestamp) -> None:
        if self.ttl_ms is None:
            return
        due = int(newest.timestamp() * 1000) + self.ttl_ms
        for timer in list(self.handle.listTimers()):
            if timer >= due:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class ItemDelta(Expiring):
    """Signed size of each event of one (layer, item): a load adds its size, an unload takes back the
    recorded one, or nothing if none is recorded."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.size = handle.getValueState("size", "bytes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        load = (pdf["reason"] == "load").to_numpy()
        after = np.where(load, pdf["bytes"].to_numpy(), 0)
        before = np.concatenate([[self.size.get()[0] if self.size.exists() else 0], after[:-1]])
        self.size.update((int(after[-1]),))
        self.keep_until(pdf["ts"].iloc[-1])
        yield pd.DataFrame(
            {
                "ts": pdf["ts"], "layer": key[0], "item": key[1], "reason": pdf["reason"], "delta": np.where(load, after, -before),
                "items": np.where(load, 1, -1).astype(np.int32),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.size.clear()
        yield pd.DataFrame()


DELTA = "ts timestamp, layer string, item string, reason string, delta long, items int"


def item_deltas(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """N2, first half. State is keyed by (layer, item), so a hot layer spreads over its items.

    Runs in event time: rows behind the watermark are dropped. State is a few bytes per item and kept,
    so that a late unload still gives back its size; with `ttl_ms` an item without events for that
    long is forgotten, and an unload after it gives back nothing.
    """
    return events.groupBy("layer", "item").transformWithStateInPandas(ItemDelta(ttl_ms), DELTA, "Append", "eventTime")


def write_running_totals(events: DataFrame, deltas_path: str, checkpoint: str):
    """N2. Deltas go to a table; `running_totals` reads totals or the curve from it.

    Splitting the job there keeps the per-layer sums a partial aggregation instead of one stateful
    task per layer.
    """
    return (
        item_deltas(events).writeStream.format("parquet").option("path", deltas_path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def running_totals(deltas: DataFrame) -> DataFrame:
    """N2. Bytes and items now held per layer and overall."""
    return deltas.rollup("layer").agg(
        F.sum("delta").alias("total_bytes"), F.sum("items").alias("item_count"), F.min("ts").alias("started_at")
    )


class EmaState(Expiring):
    """Per key: moving average of the rate, count of long gaps, last gaps, time of the last event."""

    def __init__(self, alpha: float, start: float, long_gap: float, max_gap: float, history: int, ttl_ms: int | None):
        super().__init__(ttl_ms)
        self.alpha, self.start, self.long_gap, self.max_gap, self.history = alpha, start, long_gap, max_gap, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("ema", "last long, ema double, longs long, seen long, gaps array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, ema, longs, seen, gaps = self.state.get() if self.state.exists() else (None, self.start, 0, 0, [])
        pdf = _in_order(rows)
        micros = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        gap = np.diff(micros if last is None else np.concatenate([[last], micros])) / 1e6
        gap = gap[(gap > 0) & (gap < self.max_gap)]
        age = np.arange(len(gap))[::-1]
        ema = ema * (1 - self.alpha) ** len(gap) + float((self.alpha * (1 - self.alpha) ** age / gap).sum())
        longs, seen = longs + int((gap > self.long_gap).sum()), seen + len(gap)
        gaps = [*gaps, *gap.tolist()][-self.history :]
        newest = int(micros[-1]) if last is None else max(int(last), int(micros[-1]))
        self.state.update((newest, float(ema), int(longs), int(seen), gaps))
        self.keep_until(pdf["ts"].iloc[-1])
        yield pd.DataFrame({"key": [str(key[0])], "ema": [float(ema)], "long_gaps": [int(longs)], "n_gaps": [int(seen)], "history": [len(gaps)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()


EMA = "key string, ema double, long_gaps long, n_gaps long, history int"


def ema_stream(
    events: DataFrame, key: str, alpha: float = 0.1, start: float = 60.0, long_gap: float = 0.05, max_gap: float = 5.0, history: int = 120,
    ttl_ms: int | None = None,
) -> DataFrame:
    """N3. Moving average of the event rate per key with a long-gap counter and a bounded history.

    The average depends on the order of a key's events, so a key is one state; spread a hot source
    by keying on (source, session) as the feed does. Rows behind the watermark are dropped; with
    `ttl_ms` a key without events for that much event time starts anew.
    """
    return events.select("ts", "event_id", F.col(key).cast("string").alias("key")).groupBy("key").transformWithStateInPandas(
        EmaState(alpha, start, long_gap, max_gap, history, ttl_ms), EMA, "Update", "eventTime"
    )


def window_counts(events: DataFrame, size: str, slide: str | None = None, gap: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """N4. Tumbling, sliding or session counts and sums."""
    w = F.session_window("ts", gap) if gap else (F.window("ts", size, slide) if slide else F.window("ts", size))
    agg = events.groupBy(w.alias("w"), *(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), "n", "total")


def latest_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """N5. Newest value per key, kept up to date; equal times resolve to the larger value."""
    best = events.groupBy(*keys).agg(F.max(F.struct("ts", "value")).alias("b"))
    return best.select(*keys, F.col("b.value").alias("value"), F.col("b.ts").alias("ts"))


COVERAGE = ["tier", "dwelling_type", "bedrooms", "source_class"]


def coverage_stream(rows: DataFrame, counts_path: str, checkpoint: str):
    """N6. First sights of (slice, class, polygon) in batches of observation rows, counted per slice.

    The keys seen so far are the state of a streaming deduplication, so a batch costs what it brings
    and no history is read again. A batch's counts lie under its own number, so a repeated batch
    overwrites itself; `coverage_counts` adds them up.
    """
    polygon = F.explode(C.code_list("geospatial_codes")).alias("polygon")
    first = rows.select(C.tier_of().alias("tier"), "dwelling_type", "bedrooms", C.source_class().alias("source_class"), polygon).dropDuplicates()

    def apply(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(*COVERAGE).agg(F.count(F.lit(1)).alias("region_count"))
        replace_slice(counts.withColumn("batch", F.lit(number)), counts_path, ["batch"])

    return (
        first.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def coverage_counts(counts: DataFrame) -> DataFrame:
    """N6. Polygons with an observation so far, per slice and class."""
    return counts.groupBy(*COVERAGE).agg(F.sum("region_count").alias("region_count"))
