"""Presence of polygons and row keys as mergeable bitmaps.

Every polygon (and every row key) has a dense position; a (slice, source class) holds one bit per
position, in buckets of fixed size. Coverage, presence counts and the six differences between classes
are then counts over a few bitmaps per slice: partial bitmaps merge before the shuffle, a difference is
the size of a union less the size of one side, and no row per polygon and pair is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators.sets import PAIRS
from quartermark.operators.windows import row_index
from quartermark.session import cut

SLICE = ["tier", "dwelling_type", "bedrooms"]
# The short name of each source class.
SHORT = {"observed": "obs", "imputed": "imp", "forecast": "fc"}


def presence_keys(obs: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Distinct (slice, row key, source class) of the median rows and the forecasts, each read once, written."""
    dims = [C.tier_of().alias("tier"), "dwelling_type", "bedrooms", "geospatial_codes"]
    rows = obs.filter(F.col("statistic") == "median").select(*dims, C.source_class().alias("source_class"))
    both = rows.unionByName(forecasts.select(*dims, F.lit("forecast").alias("source_class")))
    return cut(both.filter((F.col("dwelling_type") != "vacant_land") & (F.col("bedrooms") != "0") & F.col("tier").isNotNull()).distinct())


def class_bitmaps(keys: DataFrame) -> DataFrame:
    """(slice, source_class, kind, bucket, bits) with kind `polygon` or `row_key`, written once."""
    name = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("name"))
    codes = F.transform(C.code_list("geospatial_codes"), lambda c: name("polygon", c))
    items = keys.withColumn("item", F.explode(F.concat(codes, F.array(name("row_key", F.col("geospatial_codes"))))))
    items = items.select(*SLICE, "source_class", "item.*")
    places = cut(row_index(items.select("kind", "name").distinct(), ["kind"], ["name"], "place"))
    placed = items.join(places, ["kind", "name"]).withColumn("place", F.col("place") + 1)
    return cut(
        placed.groupBy(*SLICE, "source_class", "kind", F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )


def _polygons(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.filter(F.col("kind") == "polygon").drop("kind")


def coverage_counts(bitmaps: DataFrame) -> DataFrame:
    """E9. Distinct polygons and row keys per slice and source class."""
    size = lambda kind: F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bits")).otherwise(0))
    return bitmaps.groupBy(*SLICE, "source_class").agg(size("polygon").alias("region_count"), size("row_key").alias("row_key_count"))


def class_sizes(bitmaps: DataFrame) -> DataFrame:
    """n_obs, n_imp, n_fc per slice."""
    size = lambda c: F.sum(F.when(F.col("source_class") == c, F.bitmap_count("bits")).otherwise(0))
    return _polygons(bitmaps).groupBy(*SLICE).agg(*(size(c).alias(f"n_{s}") for c, s in SHORT.items()))


def difference_counts(bitmaps: DataFrame) -> DataFrame:
    """(slice, pair_order, pair, n_diff) of the differences that are not empty: |a or b| - |b|."""
    classes = list(SHORT)
    unions = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    hits = [F.when(F.col("source_class").isin(a, b), F.lit(SHORT[a] + SHORT[b])) for a, b in unions]
    joint = _polygons(bitmaps).withColumn("joint", F.explode(F.array_compact(F.array(*hits))))
    merged = joint.groupBy(*SLICE, "joint", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    total = merged.groupBy(*SLICE).agg(*(F.sum(F.when(F.col("joint") == SHORT[a] + SHORT[b], F.col("n"))).alias(SHORT[a] + SHORT[b]) for a, b in unions))
    both = {frozenset((SHORT[a], SHORT[b])): SHORT[a] + SHORT[b] for a, b in unions}
    rows = [
        F.struct(F.lit(i).alias("pair_order"), F.lit(pair).alias("pair"), (F.col(both[frozenset((a, b))]) - F.col(f"n_{b}")).alias("n_diff"))
        for i, (pair, a, b) in enumerate(PAIRS)
    ]
    joined = total.join(class_sizes(bitmaps), SLICE).select(*SLICE, F.explode(F.array(*rows)).alias("p"))
    return joined.select(*SLICE, "p.*").filter(F.col("n_diff") > 0)
