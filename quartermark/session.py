"""Session helpers: reliable lineage cuts and content-stable salts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "quartermark", cpus: str = "*", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Medians and collected arrays keep hashing past 128 groups per task instead of sorting.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="quartermark-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write `df` to a table in the checkpoint folder and return it read back, lineage dropped.

    Used by iterative jobs: each round reads files, so a lost executor repeats one round's tasks
    rather than the whole loop. The files give the next round true sizes, so joins with what has
    become small are broadcast under the usual threshold, and even partitions. `replaces` is an
    earlier cut that nothing reads any more; its files go once the new ones are written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    if replaces is not None:
        discard(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Remove the files of cuts that nothing reads any more; other tables are left alone."""
    for df in cuts:
        old = getattr(df, "_cut_path", None)
        if old:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def salt(n: int, *cols: Column | str) -> Column:
    """Salt in [0, n) computed from row content, so a retried task repeats it exactly."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
