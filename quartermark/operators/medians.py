"""E4: exact medians of groups of any size, without a buffer per group.

Equal values of a group become one row with its count, combined before the shuffle. If every group
has few distinct values, a weighted percentile over them ends it. Otherwise the rank is sought by value ranges:
a histogram of each group's range tells which bucket holds the rank, the bucket's own least and
greatest value are the next range, and the search ends when they are equal. Histograms are partial
sums, so a group that holds most rows is counted by many tasks and no task holds more than its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quartermark.session import cut

#: Distinct values a group may have for its median to be taken in memory.
HELD = 200_000
#: Buckets of a range.
BUCKETS = 4096
#: The one value beyond all finite ones but NaN.
INFINITE = float("inf")


def _bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """Place of a value in [low, high]; halves keep the width finite. The ends never share a bucket."""
    width = high / 2 - low / 2
    inside = F.floor(F.when(width > 0, (value / 2 - low / 2) / width * buckets).otherwise((value > low).cast("double") * buckets))
    finite = F.when(value == low, F.lit(0)).when(value == high, F.lit(buckets)).otherwise(inside)
    return F.when(F.isnan(value), buckets + 2).when(value == INFINITE, buckets + 1).when(value == -INFINITE, -1).otherwise(finite).cast("int")


def _range() -> list[Column]:
    """Least and greatest finite value, and how many values there are."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < INFINITE), F.col("value"))
    return [F.min(finite).alias("low"), F.max(finite).alias("high"), F.min("value").alias("least"), F.max("value").alias("most")]


def by_ranges(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """group, median of `counted` (group, value, n: one row per distinct value, no nulls). NaN is the greatest value."""
    totals = counted.groupBy("group").agg(F.sum("n").alias("total"), *_range())
    # The median is the mean of the values at two ranks, the same one for an odd count.
    ranks = F.explode(F.array_distinct(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")))).alias("rank")
    sought = cut(totals.select("group", ranks, "low", "high", "least", "most").withColumn("mark", F.col("rank")))
    found = None
    while True:
        done = sought.filter(F.col("least") == F.col("most")).select("group", F.col("least").alias("value"))
        found = done if found is None else found.unionByName(done)
        open_ = sought.filter(F.col("least") != F.col("most"))
        if open_.isEmpty():
            break
        wanted = open_.select("group", "mark", "rank", "low", "high", F.col("least").alias("from"), F.col("most").alias("to"))
        beside = counted.join(wanted, "group").filter(F.col("value").between(F.col("from"), F.col("to")))
        # Without a finite value in the range only the infinite ones and NaN are left, which need no width.
        place = _bucket(F.col("value"), F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(0.0)), buckets)
        parts = beside.groupBy("group", "mark", "rank", place.alias("bucket")).agg(F.sum("n").alias("n"), *_range())
        upto = parts.withColumn("upto", F.sum("n").over(W.partitionBy("group", "mark").orderBy("bucket")))
        hit = upto.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        hit = hit.withColumn("rank", F.col("rank") - (F.col("upto") - F.col("n")))
        sought = cut(hit.select("group", "rank", "low", "high", "least", "most", "mark"))
    return found.groupBy("group").agg(F.avg("value").alias("median"))


def median(df: DataFrame, keys: list[str], value: str, held: int = HELD) -> DataFrame:
    """Keys, median_val (null if no value), n_members (rows): exact for groups of any size; null keys are a group."""
    group = F.struct(*keys).alias("group")
    counted = cut(df.groupBy(group, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    members = counted.groupBy("group").agg(F.sum("n").alias("n_members"))
    present = counted.filter("value is not null")
    if (present.groupBy("group").count().agg(F.max("count")).first()[0] or 0) <= held:
        middle = present.groupBy("group").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("median"))
    else:
        middle = by_ranges(present)
    return members.join(middle, "group", "left").select("group.*", F.col("median").alias("median_val"), "n_members")
