"""2F, 2G: windows, ordering, top-k.

Two rules keep hot keys off a single task. Picks of one row per key are min/max of a struct, which
combine before the shuffle. Running computations over raw events go through `ordered_blocks`: rows
are range-partitioned on (key, order), so a key that holds a third of the rows spans many blocks,
and only one total per (key, block) is carried across. Plain windows are used only over series that
hold one row per calendar bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.session import cut, salt


def most_specific(df: DataFrame, keys: list[str], group: str = "group_codes") -> DataFrame:
    """F1. One row per key: the shortest group code list, then the least."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.length(group).alias("__len"), F.col(group).alias("__g"), *[c for c in rest if c != group])
    best = df.groupBy(*keys).agg(F.min(rank).alias("__b"))
    return best.select(*keys, *[F.col("__b.__g" if c == group else f"__b.{c}").alias(c) for c in rest])


def latest_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """F2. Whole row with the greatest `order` per key."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(order, *[c for c in rest if c != order])
    best = df.groupBy(*keys).agg(F.max(rank).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def horizon_index(fc: DataFrame, own_h: DataFrame, key: str = "unique_id") -> DataFrame:
    """F4. Number a series' forecast rows 1..h and keep the rows within its own horizon."""
    numbered = fc.withColumn("horizon_q", F.row_number().over(W.partitionBy(key).orderBy("ds")))
    return numbered.join(own_h.select(key, "h"), key).filter(F.col("horizon_q") <= F.col("h")).drop("h")


def holdout(df: DataFrame, n: int, key: str = "unique_id", ts: str = "ds") -> DataFrame:
    """F5. Mark the last n rows of each series; series of n rows or fewer drop out."""
    w = W.partitionBy(key)
    return (
        df.withColumn("__back", F.row_number().over(w.orderBy(F.col(ts).desc())))
        .withColumn("__n", F.count(F.lit(1)).over(w))
        .filter(F.col("__n") > n)
        .withColumn("is_holdout", F.col("__back") <= n)
        .drop("__back", "__n")
    )


# --- running computations over events --------------------------------------


def ordered_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in global (keys, order) order with `__block`, the range partition they fell in.

    `order` must end in a unique column: then ranges can split inside a key. The result is cut, so
    block numbers stay fixed however often it is read.
    """
    return cut(df.repartitionByRange(*keys, *order).withColumn("__block", F.spark_partition_id()))


def _carry_in(totals: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Exclusive running sum of per-(key, block) totals: one row per key and block it touches."""
    w = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__in_{c}") for c in cols]
    return totals.select(*keys, "__block", *carried)


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """F6. Inclusive running sum of each expression in `sums`, per key, in order."""
    blocks = ordered_blocks(df.withColumns({f"__{n}": e for n, e in sums.items()}), keys or [], order)
    if not keys:
        blocks = blocks.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    totals = blocks.groupBy(*by, "__block").agg(*[F.sum(f"__{n}").alias(n) for n in sums])
    w = W.partitionBy(*by, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = blocks.withColumns({f"__run_{n}": F.sum(f"__{n}").over(w) for n in sums})
    joined = inside.join(_carry_in(totals, by, list(sums)), [*by, "__block"])
    out = joined.withColumns({n: F.col(f"__run_{n}") + F.col(f"__in_{n}") for n in sums})
    return out.select(*df.columns, *sums)


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Zero-based position of each row within its key, without a single-task window."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def exact_median(df: DataFrame, keys: list[str], value: str, tie: str, name: str, count: str) -> DataFrame:
    """Median per key and the number of rows, for groups of any size: the middle ranks of the global
    order, so no task holds a group's values. `tie` is unique within a key."""
    ranked = row_index(df.select(*keys, value, tie), keys, [value, tie], "__rank")
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    middle = F.col("__rank").between(F.floor((F.col(count) - 1) / 2), F.ceil((F.col(count) - 1) / 2))
    return ranked.join(sizes, keys).filter(middle).groupBy(*keys).agg(F.avg(value).alias(name), F.max(count).alias(count))


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int, salts: int = 32) -> DataFrame:
    """F7. Last n rows per key: n per salt first, then n of those."""
    return topk_per_group(df, keys, [F.col(c).desc() for c in order], n, salts, tie=order[-1])


def topk_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32, tie: str | None = None
) -> DataFrame:
    """G3. First k rows per key under `order`, in two steps so a hot key is split `salts` ways."""
    part = salt(salts, *( [tie] if tie else df.columns))
    first = (
        df.withColumn("__s", part)
        .withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__s").orderBy(*order)))
        .filter(F.col("__r") <= k)
    )
    return (
        first.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("__r") <= k)
        .drop("__s", "__r")
    )


def gaps(
    df: DataFrame, keys: list[str], ts: str, tie: str, long_gap: float, max_gap: float
) -> DataFrame:
    """F8. Microseconds since the key's previous event, with a running count of long gaps.

    Gaps of zero or of `max_gap` and more are discarded (NULL) and not counted. The previous event
    of a block's first row is the last event of the key's preceding block.
    """
    blocks = ordered_blocks(df, keys, [ts, tie])
    inside = W.partitionBy(*keys, "__block").orderBy(ts, tie)
    ends = blocks.groupBy(*keys, "__block").agg(F.max(ts).alias("__last"))
    before = ends.select(
        *keys, "__block", F.lag("__last").over(W.partitionBy(*keys).orderBy("__block")).alias("__prev_block")
    )
    joined = blocks.withColumn("__lag", F.lag(ts).over(inside)).join(before, [*keys, "__block"])
    prev = F.coalesce("__lag", "__prev_block")
    micros = F.timestamp_diff("MICROSECOND", prev, F.col(ts))
    kept = (micros > 0) & (micros < int(max_gap * 1e6))
    flagged = joined.withColumn("gap_us", F.when(kept, micros))
    is_long = F.coalesce((F.col("gap_us") > int(long_gap * 1e6)).cast("long"), F.lit(0))
    flagged = flagged.withColumn("__long", is_long)
    totals = flagged.groupBy(*keys, "__block").agg(F.sum("__long").alias("long_gaps"))
    run = F.sum("__long").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return (
        flagged.withColumn("__run", run)
        .join(_carry_in(totals, keys, ["long_gaps"]), [*keys, "__block"])
        .withColumn("long_gaps", F.col("__run") + F.col("__in_long_gaps"))
        .select(*df.columns, "gap_us", "long_gaps")
    )


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, start: float) -> DataFrame:
    """F9. Exponential moving average after the last event of each key, and the event count.

    After n events the average is (1-a)^n * start + sum a (1-a)^(n-i) v_i. Each block folds its own
    events, and a key's blocks combine by the same rule, so nothing larger than one block is ordered
    in a task.
    """
    blocks = ordered_blocks(df.select(*keys, *order, value), keys, order)
    w = W.partitionBy(*keys, "__block").orderBy(*[F.col(c).desc() for c in order])
    aged = blocks.withColumn("__age", F.row_number().over(w) - 1)
    decay = F.lit(1.0 - alpha)
    part = aged.groupBy(*keys, "__block").agg(
        F.sum(F.col(value) * alpha * F.pow(decay, F.col("__age"))).alias("__v"), F.count(F.lit(1)).alias("__n")
    )
    later = W.partitionBy(*keys).orderBy(F.col("__block").desc()).rowsBetween(W.unboundedPreceding, -1)
    shifted = part.withColumn("__after", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    folded = shifted.groupBy(*keys).agg(
        F.sum(F.col("__v") * F.pow(decay, F.col("__after"))).alias("__v"), F.sum("__n").alias("n_events")
    )
    return folded.select(*keys, "n_events", (F.col("__v") + start * F.pow(decay, F.col("n_events"))).alias("ema"))


# --- order and top-1 --------------------------------------------------------


def top1(df: DataFrame, column: str) -> DataFrame:
    """G2. Row with the greatest value; the remaining columns break ties."""
    rest = [c for c in df.columns if c != column]
    return df.orderBy(F.col(column).desc_nulls_last(), *rest).limit(1)


def slice_sorted(df: DataFrame) -> DataFrame:
    """G4."""
    return df.orderBy(*C.slice_order())


def palette_slot(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """G6. Position in slice order modulo the palette; a region holds a handful of slices."""
    w = W.partitionBy(*keys).orderBy(*C.slice_order())
    return df.withColumn("slot", F.pmod(F.row_number().over(w) - 1, F.lit(size)))
