"""Versioned tables: what readers see around commits, failures and clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from quartermark.sources import sinks


@pytest.fixture
def table(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.publish(spark.range(100).repartition(8), path)
    return path


def test_compaction_switches_to_few_files(spark, table):
    old = sinks.current(spark, table)
    before = sinks.read_current(spark, table)
    sinks.compact_current(spark, table, 2)
    new = sinks.current(spark, table)
    assert new != old
    assert len([f for f in os.listdir(new) if f.endswith(".parquet")]) == 2
    assert sinks.read_current(spark, table).count() == 100
    assert before.count() == 100  # a plan of the old version still reads it


def test_failed_run_leaves_old_table(spark, table):
    old = sinks.current(spark, table)
    with pytest.raises(Exception):
        sinks.rewrite(spark, table, lambda rows: rows.select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id")))
    assert sinks.current(spark, table) == old
    assert sinks.read_current(spark, table).count() == 100


def test_unfinished_pointer_is_no_version(spark, table):
    old = sinks.current(spark, table)
    open(f"{table}/_versions/0000000001", "w").close()
    assert sinks.current(spark, table) == old
    sinks.rewrite(spark, table, lambda rows: rows.filter("id < 10"))
    assert sinks.versions(spark, table)[-1] == "0000000002"
    assert sinks.read_current(spark, table).count() == 10


def test_commit_in_between_stands(spark, table):
    base = sinks.versions(spark, table)
    sinks.publish(spark.range(7), table)
    with pytest.raises(Exception):
        sinks.publish(spark.range(3), table, base)
    assert sinks.read_current(spark, table).count() == 7


def test_expire_keeps_newest(spark, table):
    for n in (3, 4, 5):
        sinks.publish(spark.range(n), table)
    sinks.write_parquet(spark.range(1), f"{table}/v0000000009-left")
    assert sinks.expire(spark, table, keep=2) == 3
    assert len(sinks.versions(spark, table)) == 2
    assert sinks.read_current(spark, table).count() == 5
    with pytest.raises(ValueError):
        sinks.expire(spark, table, keep=0)


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, f"{tmp_path}/none")
