import pytest
from pyspark.sql import functions as F

from quartermark.sources.sinks import scratch_path
from quartermark.streaming import events as E
from quartermark.workload import QUERIES
from quartermark.workload.live import _drain, _rocksdb

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["N2_running_totals", "N3_ema_stream"])
def test_pieces_and_order_of_arrival_do_not_matter(spark, name):
    want = rows(QUERIES[name](spark, SF))
    moved = scratch_path(spark, "moved")
    spark.read.parquet(f"{SF}/events.parquet").orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{moved}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert rows(QUERIES[name](spark, moved)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_late_rows_are_dropped_and_idle_keys_forgotten(spark):
    _rocksdb(spark)
    landing, place = scratch_path(spark, "landing"), (scratch_path(spark, "sink"), scratch_path(spark, "offsets"))
    hour = lambda h: F.expr(f"timestamp '2024-01-01 00:00:00' + interval {h} hours")
    ttl = 48 * 3600 * 1000

    def feed(batch):
        out = None
        for event_id, (user, h) in batch:
            row = spark.range(1).select(F.lit(event_id).cast("long").alias("event_id"), hour(h).alias("ts"), F.lit(user).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
            out = row if out is None else out.unionByName(row)
        out.coalesce(1).write.mode("append").parquet(landing)
        stream = E.ema_stream(E.event_stream(spark, landing, "1 hour"), "user_id", 0.1, 60.0, 7200, 1e9, ttl_ms=ttl)
        return {r.key: r.n_gaps for r in _drain(stream, "update", spark, ["key"], place).collect()}

    assert feed([(1, (7, 0)), (2, (7, 1)), (3, (8, 10))]) == {"7": 1, "8": 0}
    assert feed([(4, (7, 2))]) == {"7": 1, "8": 0}  # behind the watermark
    assert feed([(5, (8, 200))]) == {"7": 1, "8": 1}
    assert feed([(6, (7, 201))])["7"] == 0  # its state went when event time passed its limit


def test_an_item_idle_for_long_gives_back_its_size(spark):
    _rocksdb(spark)
    landing, sink, offsets = (scratch_path(spark, n) for n in ("landing", "deltas", "offsets"))

    def feed(*batch):
        spark.createDataFrame(batch, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
            "ts", F.to_timestamp("ts")
        ).coalesce(1).write.mode("append").parquet(landing)
        signed = E.signed_events(E.event_stream(spark, landing, "1 hour"), "event_type", "user_id", "value", "load", "unload")
        E.write_running_totals(signed.withColumn("layer", F.lit("l")), sink, offsets).awaitTermination()
        return {r.layer: (r.total_bytes, r.item_count) for r in E.running_totals(spark.read.parquet(sink)).collect()}

    assert feed((1, "2024-01-01", 7, "load", 40.0, ""), (2, "2024-01-01", 8, "load", 2.0, ""))["l"] == (42, 2)
    assert feed((3, "2024-09-01", 8, "load", 5.0, ""))["l"] == (47, 3)
    assert feed((4, "2025-09-02", 7, "unload", 0.0, ""))["l"] == (7, 2)


def test_coverage_counts_first_sights_only(spark):
    _rocksdb(spark)
    landing, counts, offsets = (scratch_path(spark, n) for n in ("landing", "counts", "offsets"))

    def feed(*codes):
        rows = [("suburb", c, "house", "2", "a.csv") for c in codes]
        schema = "geospatial_type string, geospatial_codes string, dwelling_type string, bedrooms string, source_file string"
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        src = spark.readStream.schema(schema).parquet(landing)
        E.coverage_stream(src, counts, offsets).awaitTermination()
        return [r.region_count for r in E.coverage_counts(spark.read.parquet(counts)).collect()]

    assert feed("a", "a-b", "b") == [2]
    assert feed("b", "c-a", "c") == [3]
    assert feed("a") == [3]
    assert [r.region_count for r in spark.read.parquet(counts).orderBy("batch").collect()] == [2, 1]
