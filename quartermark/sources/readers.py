"""2A: scans. Each returns a lazy DataFrame; columns and predicates reach the file reader."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.functions import columns as C
from quartermark.sources import collections

POLYGON = "array<array<array<struct<x:double,y:double>>>>"


def scan(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    """A1."""
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def scan_filtered(spark: SparkSession, path: str, column: str, keys: DataFrame | Iterable[object]) -> DataFrame:
    """A2. Rows whose key is listed: literal keys are pushed to the reader, a key table is a semi-join."""
    df = spark.read.parquet(path)
    if isinstance(keys, DataFrame):
        return df.join(keys.select(column), column, "left_semi")
    return df.filter(F.col(column).isin(list(keys)))


def feature_schema(properties: T.StructType, coordinates: str = "array<array<array<double>>>") -> str:
    props = properties.simpleString()
    return f"type string, properties {props}, geometry struct<type:string,coordinates:{coordinates}>"


def scan_features(
    spark: SparkSession, path: str, properties: T.StructType, layout: str = "lines",
    coordinates: str = "array<array<array<double>>>",
) -> DataFrame:
    """A3. One row per feature: its properties and a `geom` column.

    `lines` holds one feature per line and splits over tasks. `document` is one FeatureCollection
    per file, read whole by one task; `pieces` is the same file cut at features, for big ones.
    """
    feature = feature_schema(properties, coordinates)
    if layout == "document":
        inner = feature.replace("type string", "type:string", 1).replace(", properties ", ",properties:", 1)
        inner = inner.replace(", geometry ", ",geometry:", 1)
        doc = spark.read.schema(f"type string, features array<struct<{inner}>>").option("multiLine", True).json(path)
        rows = doc.select(F.explode("features").alias("f")).select("f.*")
    elif layout == "pieces":
        rows = collections.feature_texts(spark, path).select(F.from_json("value", feature).alias("f")).select("f.*")
    else:
        rows = spark.read.schema(feature).json(path)
    rings = "geometry.coordinates"
    if coordinates.startswith("array<array<array<array"):
        geom = F.col(rings)
    elif coordinates.startswith("array<array<array"):
        geom = F.array(F.col(rings))
    else:
        geom = F.array(F.array(F.col(rings)))
    to_xy = lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y"))
    xy = F.transform(geom, lambda part: F.transform(part, lambda ring: F.transform(ring, to_xy)))
    present = F.col(rings).isNotNull()
    return rows.select("properties.*", F.col("geometry.type").alias("geom_type"), F.when(present, xy).alias("geom"))


def scan_dir(
    spark: SparkSession, paths: list[str], fmt: str = "parquet", schema: T.StructType | str | None = None,
    casts: dict[str, str] | None = None, name: str = "level", rule=C.level_slug,
) -> DataFrame:
    """A4. Files of one folder as one table: columns unioned, one column derived from the file name.

    Columns that change type between files are read as text through `schema` and then cast, NULL
    where the text does not parse.
    """
    reader = spark.read.format(fmt).option("mergeSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(paths)
    df = df.select("*", rule(F.col("_metadata.file_name")).alias(name))
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items()})


# Total rows of the sheets that are not regions.
TOTALS = ["Group Total", "Grand Total", "Victoria", "Metro", "Non-Metro"]


def column_letters(n: Column) -> Column:
    """Spreadsheet column letters of a one-based number, up to three letters."""
    letter = lambda k: F.char(F.lit(65) + k)
    one = letter((n - 1) % 26)
    two = letter(F.pmod(F.floor((n - 1) / 26) - 1, F.lit(26)))
    three = letter(F.pmod(F.floor((n - 27) / 676) - 1, F.lit(26)))
    return F.when(n <= 26, one).when(n <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def grid_to_long(grid: DataFrame, mapping: DataFrame, skip: list[str] = TOTALS) -> DataFrame:
    """A5. Sheet rows to long facts, one per region row and filled value cell.

    `grid`: source_file, source_sheet, row_no, cells (text, first cell is column 1).
    `mapping`: source_file, source_sheet, header_row, first_col, last_col, geo_col, first_row,
    last_row, statistics (array; columns alternate through it), time_format, and the constant
    columns dwelling_type, bedrooms, geospatial_type, data_type, data_frequency.
    Header dates sit in one row per sheet, so they join on the sheet.
    """
    sheet = ["source_file", "source_sheet"]
    rows = grid.join(mapping, sheet)
    header = rows.filter(F.col("row_no") == F.col("header_row")).select(*sheet, F.col("cells").alias("header"))
    geo = F.get("cells", F.col("geo_col") - 1)
    body = rows.filter(
        (F.col("row_no") >= F.col("first_row")) & (F.col("row_no") <= F.col("last_row")) & (F.coalesce(geo, F.lit("")) != "") & ~geo.isin(skip)
    )
    width = F.col("last_col") - F.col("first_col") + 1
    cell = F.posexplode(F.slice("cells", F.col("first_col"), width))
    long = body.join(header, sheet).select("*", geo.alias("geospatial"), cell.alias("pos", "text"))
    value = F.trim("text").try_cast("double")
    bucket = F.to_date(F.try_to_timestamp(F.get("header", F.col("first_col") + F.col("pos") - 1), F.col("time_format")))
    out = long.select(
        "geospatial", "geospatial_type", bucket.alias("time_bucket"), "dwelling_type", "bedrooms",
        F.concat_ws("-", "dwelling_type", "bedrooms").alias("dwelling_class"),
        F.get("statistics", F.pmod(F.col("pos"), F.size("statistics"))).alias("statistic"),
        value.alias("value"), "data_type", "data_frequency", *sheet,
        F.concat(column_letters(F.col("first_col") + F.col("pos")), F.col("row_no").cast("string")).alias("cell"),
    )
    return out.filter(F.col("value").isNotNull() & F.col("time_bucket").isNotNull())


SDMX = (
    "struct<data:struct<dataSets:array<struct<series:map<string,struct<observations:map<string,array<double>>>>>>,"
    "structure:struct<dimensions:struct<observation:array<struct<values:array<struct<id:string>>>>>>>>"
)


def scan_sdmx(df: DataFrame, json_col: str, region: Column | str = "region") -> DataFrame:
    """A6. Observations keyed by position, joined to the time labels; null observations dropped."""
    doc = df.withColumn("__d", F.from_json(json_col, SDMX))
    sets = doc.select(
        C.col(region).alias("region"),
        F.get(F.col("__d.data.structure.dimensions.observation"), 0)["values"].alias("times"),
        F.explode(F.get(F.col("__d.data.dataSets"), 0)["series"]).alias("skey", "series"),
    )
    obs = sets.select("region", "times", F.explode("series.observations").alias("pos", "o"))
    label = F.get("times", F.col("pos").cast("int"))["id"]
    return obs.select(
        "region", C.quarter_label_date(label).alias("time_bucket"), F.get("o", 0).alias("index_value")
    ).filter(F.col("index_value").isNotNull())


def scan_map_json(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """A7. Flat `{key: value}` documents to rows."""
    return df.select(*(keep or []), F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def inventory(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """A8. Row count per table; a missing table counts zero."""
    names = names if names is not None else sorted(t.name for t in spark.catalog.listTables())
    counts = []
    for n in names:
        found = spark.catalog.tableExists(n)
        rows = spark.table(n) if found else spark.range(0)
        counts.append(rows.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")))
    return reduce(DataFrame.unionByName, counts)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A9."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)
