"""2H: set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.schemas import OBS_COLUMNS

# The ordered pairs of cohorts that are compared, in report order.
PAIRS = [
    ("obs_minus_imp", "obs", "imp"),
    ("imp_minus_obs", "imp", "obs"),
    ("obs_minus_fc", "obs", "fc"),
    ("fc_minus_obs", "fc", "obs"),
    ("imp_minus_fc", "imp", "fc"),
    ("fc_minus_imp", "fc", "imp"),
]


def union_classified(a: DataFrame, b: DataFrame) -> DataFrame:
    """H1."""
    return a.unionByName(b)


def append_derived(obs: DataFrame, derived: DataFrame) -> DataFrame:
    """H2. Derived rows behind the observed ones, columns in canonical order."""
    return obs.select(*OBS_COLUMNS).unionByName(derived.select(*OBS_COLUMNS))


def pairwise_diffs(presence: DataFrame) -> DataFrame:
    """H3. (slice, pair, polygon) for each polygon in one cohort and not in the other.

    Six differences from one pass over the presence flags.
    """
    hits = F.array(
        *[F.when(F.col(a) & ~F.col(b), F.struct(F.lit(i).alias("pair_order"), F.lit(n).alias("pair"))) for i, (n, a, b) in enumerate(PAIRS)]
    )
    return presence.select(
        "tier", "dwelling_type", "bedrooms", "polygon", F.explode(F.array_compact(hits)).alias("p")
    ).select("tier", "dwelling_type", "bedrooms", "p.*", "polygon")


def orphan_codes(groups: DataFrame, universe: DataFrame) -> DataFrame:
    """H4. Codes the groups mention and the region table lacks."""
    codes = groups.select(F.explode(C.code_list("geospatial_codes")).alias("code")).distinct()
    return codes.join(universe.select("code"), "code", "left_anti")


def flatten_codes(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """H5. Distinct single codes behind grouped row keys."""
    keys = keys or []
    return df.select(*keys, "geospatial_codes").distinct().select(
        *keys, F.explode(C.code_list("geospatial_codes")).alias("code")
    ).distinct()


def distinct_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """H6."""
    return df.select(*cols).distinct()
