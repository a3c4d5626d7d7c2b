"""2B: sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.functions import columns as C
from quartermark.functions import geometry as G
from quartermark.session import scratch_root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str) -> str:
    """B1."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def replace_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """B2. Replace one table; others are untouched."""
    df.write.mode("overwrite").option("path", path).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


def replace_slice(df: DataFrame, path: str, keys: list[str]) -> str:
    """B3. Replace the partitions that occur in `df`; the rest of the table stays."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return path


def write_by_region(df: DataFrame, path: str) -> str:
    """B3 for lookups: one row per (tier, code) of each code list, a folder per tier, files in code order.

    A lookup of a few codes then opens one folder and the row groups whose range holds them.
    """
    coded = df.withColumns({"tier": F.col("geospatial_type"), "code": F.explode(C.code_list("geospatial_codes"))})
    order = ["tier", "code", *[c for c in ("data_type", "dwelling_type", "bedrooms", "time_bucket", "ds") if c in df.columns]]
    coded.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("tier").parquet(path)
    return path


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """B4. Columns in table order with table types; a NULL where none is allowed fails the write."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    out = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"NULL in {f.name}")).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def compact(spark: SparkSession, source: str, target: str, n_files: int) -> str:
    """B6. Rewrite into `n_files` even files beside the source."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("compaction cannot overwrite the files it reads")
    spark.read.parquet(source).repartition(n_files).write.mode("overwrite").parquet(target)
    return target


# --- versioned tables: a folder per version, a numbered pointer written last --------


def _files(spark: SparkSession, path: str):
    """(Hadoop path class, file system) of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, path: str, number: str) -> str | None:
    """Folder a pointer names; None while its writer has not finished it."""
    place, fs = _files(spark, path)
    stream = fs.open(place(f"{path}/_versions/{number}"))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return text[:-1] if text.endswith("\n") else None


def versions(spark: SparkSession, path: str) -> list[str]:
    """Numbers of a versioned table's pointers, oldest first, unfinished ones included."""
    place, fs = _files(spark, path)
    folder = place(f"{path}/_versions")
    if not fs.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith("."))


def current(spark: SparkSession, path: str) -> str:
    """Folder of the newest finished version."""
    for number in reversed(versions(spark, path)):
        name = _pointer(spark, path, number)
        if name:
            return f"{path}/{name}"
    raise FileNotFoundError(f"no version of {path}")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version. A plan made from it goes on reading that version after later commits."""
    return spark.read.parquet(current(spark, path))


def publish(df: DataFrame, path: str, base: list[str] | None = None) -> str:
    """B5, B6. Write `df` as a new version of the table at `path`, which it may read itself.

    The version's folder is complete before its pointer appears, so a reader sees the old table or the
    new one, and a run that fails leaves the old one. The pointer takes the number after those in
    `base` (by default those present before the write); if another writer has taken it meanwhile, the
    commit fails and the other's version stands.
    """
    spark = df.sparkSession
    seen = versions(spark, path) if base is None else base
    number = f"{int(seen[-1]) + 1 if seen else 0:010d}"
    name = f"v{number}-{uuid.uuid4().hex}"
    write_parquet(df, f"{path}/{name}")
    place, fs = _files(spark, path)
    stream = fs.create(place(f"{path}/_versions/{number}"), False)
    try:
        stream.write(bytearray(f"{name}\n".encode()))
    finally:
        stream.close()
    return f"{path}/{name}"


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """B5. Commit `change` of the newest version as the next one; fails if another commit came between."""
    base = versions(spark, path)
    return publish(change(read_current(spark, path)), path, base)


def compact_current(spark: SparkSession, path: str, n_files: int) -> str:
    """B6. Rewrite the newest version into `n_files` even files and switch to it."""
    return rewrite(spark, path, lambda rows: rows.repartition(n_files))


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest `keep` finished versions, then folders that failed runs left behind.

    Older plans still reading a removed version fail, so choose `keep` by how long jobs run. Call it
    while no other writer is at work: a folder without a pointer counts as left behind.
    """
    if keep < 1:
        raise ValueError("the newest version must stay")
    place, fs = _files(spark, path)
    named = {number: _pointer(spark, path, number) for number in versions(spark, path)}
    kept = [number for number, name in named.items() if name][-keep:]
    # Pointers go before folders, so that no pointer ever names a missing folder. The newest number
    # stays even if unfinished, or its number would be given out again.
    for number in list(named)[:-1]:
        if number not in kept:
            fs.delete(place(f"{path}/_versions/{number}"), False)
    live, gone = {named[number] for number in kept}, 0
    for status in fs.listStatus(place(path)):
        name = status.getPath().getName()
        if name.startswith("v") and name not in live:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def to_map_doc(df: DataFrame, key: str, value: str, shards: int = 1) -> DataFrame:
    """B7. `{key: value}` documents, one per key shard; choose `shards` so that one document fits a task."""
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"))))
    return df.groupBy(shard).agg(F.to_json(F.map_from_entries(entries)).alias("doc"), F.count(F.lit(1)).alias("n_keys"))


def to_features(df: DataFrame, keep: list[str], dp: int = 6, geom: str = "geom") -> DataFrame:
    """B8. One feature document per row: kept properties, coordinates rounded to `dp` places."""
    missing = [c for c in keep if c not in df.columns]
    if missing:
        raise ValueError(f"missing properties {missing}; present: {[c for c in df.columns if c != geom]}")
    rounded = lambda v: F.array(F.round(v["x"], dp), F.round(v["y"], dp))
    coords = F.transform(F.col(geom), lambda part: F.transform(part, lambda ring: F.transform(ring, rounded)))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*keep).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
    )
    return df.select(F.to_json(feature).alias("value"))


def write_features(df: DataFrame, path: str, keep: list[str], dp: int = 6) -> str:
    to_features(df, keep, dp).write.mode("overwrite").text(path)
    return path


def write_meta(
    spark: SparkSession, path: str, seed: int, today: date, index_max: date | None, versions: dict[str, str]
) -> DataFrame:
    """B9. Provenance record of a run, then the version stamp. Call it after every other write."""
    record = spark.createDataFrame(
        [(seed, today, index_max, versions)], "seed int, today date, index_max date, versions map<string,string>"
    )
    record.write.mode("overwrite").json(f"{path}/meta")
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")
    spark.createDataFrame([(stamp,)], "version string").write.mode("overwrite").json(f"{path}/version")
    return record


def tile_manifest(tiles: DataFrame) -> DataFrame:
    """B10. Per layer: bounds, zoom range and number of tiles."""
    return tiles.groupBy("layer").agg(
        F.min("z").alias("min_zoom"),
        F.max("z").alias("max_zoom"),
        F.countDistinct("z", "tx", "ty").alias("n_tiles"),
        *[f.alias(n) for n, f in G.extent_aggs("minx", "miny", "maxx", "maxy").items()],
    )


def tile_keys(tiles: DataFrame) -> DataFrame:
    """B10. The sorted `z/x/y` keys of each layer as rows, so no single value holds them all."""
    key = F.concat_ws("/", F.col("z").cast("string"), F.col("tx").cast("string"), F.col("ty").cast("string"))
    return tiles.select("layer", key.alias("tile")).distinct().orderBy("layer", "tile")
