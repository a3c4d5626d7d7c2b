"""2J: per-series autoregressive fits with an exogenous regressor, forecasts and backtests.

Spark folds each series to arrays, multiplies it by its candidate orders, spreads the candidates over
the cluster and picks the best by AICc. The Python part is a small batched least-squares step over
candidates of equal shape; a series is bounded by its calendar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermark.functions.columns import let
from quartermark.operators import aggs, windows
from quartermark.plans.series import seasonal_naive
from quartermark.schemas import Z_80, Z_95
from quartermark.session import cut

FIT = (
    "unique_id string, last_ds date, h int, ar_p int, ar_d int, seasonal_p int, seasonal_period int, n_obs int, use_x boolean, "
    "aicc double, sigma2 double, coefficients map<string,double>, y_hat array<double>, se array<double>"
)


def _least_squares(Y, X, XF, p: int, d: int, sp: int, season: int, start: int, h: int):
    """Fit and extend a stack of equal-length series: rows are series, one candidate order."""
    Z = np.diff(Y, n=d, axis=1)
    lags = list(range(1, p + 1)) + ([season] if sp else [])
    n = Z.shape[1] - start
    cols = [np.ones((len(Z), n))] + [Z[:, start - k : Z.shape[1] - k] for k in lags]
    dx = None
    if X is not None:
        cols.append(np.diff(X, n=d, axis=1)[:, start:])
        dx = np.diff(np.hstack([X[:, -1:], XF]), axis=1) if d else XF
    D, target = np.stack(cols, axis=2), Z[:, start:]
    beta = (np.linalg.pinv(D) @ target[..., None])[..., 0]
    rss = ((target - (D @ beta[..., None])[..., 0]) ** 2).sum(axis=1)
    # A residual at rounding level is a series without variance: its log is -inf and it is left out.
    rss[rss <= 1e-20 * (target**2).sum(axis=1)] = 0.0
    k = D.shape[2] + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = n * np.log(rss / n) + 2 * k
        aicc = fit + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else np.full(len(Z), np.inf)
    sigma2 = rss / max(n - D.shape[2], 1)
    path = Z
    for i in range(h):
        step = beta[:, 0] + sum(beta[:, 1 + j] * path[:, -lag] for j, lag in enumerate(lags))
        path = np.column_stack([path, step + (beta[:, -1] * dx[:, i] if dx is not None else 0.0)])
    ahead = path[:, Z.shape[1] :]
    ahead = Y[:, -1:] + np.cumsum(ahead, axis=1) if d else ahead
    # Weights of past shocks in the h-step error, from the lag polynomial times the differencing.
    poly = np.zeros((len(Z), max(lags, default=0) + 1 + d))
    poly[:, 0] = 1.0
    for j, lag in enumerate(lags):
        poly[:, lag] -= beta[:, 1 + j]
    if d:
        poly[:, 1:] -= poly[:, :-1].copy()
    psi = np.zeros((len(Z), h))
    psi[:, 0] = 1.0
    for i in range(1, h):
        reach = min(i, poly.shape[1] - 1)
        psi[:, i] = -(poly[:, 1 : reach + 1] * psi[:, i - reach : i][:, ::-1]).sum(axis=1)
    se = np.sqrt(sigma2[:, None] * np.cumsum(psi**2, axis=1))
    names = ["intercept"] + [f"ar{i}" for i in range(1, p + 1)] + ([f"sar{season}"] if sp else []) + (["cpi"] if X is not None else [])
    return aicc, sigma2, names, beta, ahead, se


def _fit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shape = ["n_obs", "ar_p", "ar_d", "seasonal_p", "seasonal_period", "start", "use_x", "h"]
    for pdf in batches:
        for (_, p, d, sp, season, start, use_x, h), g in pdf.groupby(shape, sort=False):
            stack = lambda c: np.stack(g[c].to_numpy()).astype(float)  # noqa: B023, E731
            x, xf = (stack("x"), stack("xf")) if use_x else (None, None)
            aicc, sigma2, names, beta, ahead, se = _least_squares(stack("y"), x, xf, p, d, sp, season, start, h)
            out = g[["unique_id", "last_ds", "h", "ar_p", "ar_d", "seasonal_p", "seasonal_period", "n_obs", "use_x"]].copy()
            out["aicc"], out["sigma2"] = aicc, sigma2
            out["coefficients"] = [dict(zip(names, map(float, b))) for b in beta]
            out["y_hat"], out["se"] = list(ahead), list(se)
            yield out


def _variance(a: Column) -> Column:
    zero, add = F.lit(0.0), lambda s, v: s + v
    spread = lambda mean: F.aggregate(F.transform(a, lambda v: (v - mean) * (v - mean)), zero, add) / F.size(a)
    return let(F.aggregate(a, zero, add) / F.size(a), spread)


def fold(train: DataFrame, parts: int, exog: bool) -> DataFrame:
    """One row per series: y (and x) in date order. `parts` fixes the spread of the later fits."""
    cols = ["ds", "y", *(["cpi"] if exog else [])]
    rows = train.repartition(parts, "unique_id").groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("p"))
    return rows.select(
        "unique_id", F.col("p.y").alias("y"), (F.col("p.cpi") if exog else F.lit(None).cast("array<double>")).alias("x"),
        F.element_at("p", -1)["ds"].alias("last_ds"), F.size("p").alias("n_obs"),
    )


def with_path(folded: DataFrame, index: DataFrame, months: int) -> DataFrame:
    """`xf`: exogenous values of the `h` grid dates after `last_ds`; a date the index lacks fails the job.

    The index has one row per calendar date and is attached as one map, so series that end on the
    same date do not meet in one task. Dates of several regions repeat and fail as well.
    """
    known = index.filter(F.col("index_value").isNotNull()).select(F.struct("time_bucket", "index_value").alias("e"))
    by_date = known.agg(F.map_from_entries(F.collect_list("e"))).scalar()
    short = F.raise_error(F.concat(F.lit("the index lacks a date within the horizon of "), F.col("unique_id"))).cast("double")
    at = lambda k: F.try_element_at("__index", F.add_months("last_ds", k * months))
    path = F.transform(F.sequence(F.lit(1), F.col("h")), lambda k: F.coalesce(at(k), short))
    return folded.withColumn("__index", by_date).withColumn("xf", path).drop("__index")


def candidates(folded: DataFrame, season: int, exog: bool) -> DataFrame:
    """Differencing by the lower variance, then every order the length allows, on one common sample."""
    n = F.col("n_obs")
    diff = F.zip_with(F.slice("y", F.lit(2), n - 1), F.slice("y", F.lit(1), n - 1), lambda b, a: b - a)
    rows = folded.filter(n >= 3).withColumn("ar_d", F.when(_variance(diff) < _variance(F.col("y")), 1).otherwise(0))
    usable = n - F.col("ar_d")
    p_max = F.when(usable >= 10, 2).when(usable >= 6, 1).otherwise(0)
    s_max = F.when((usable >= 4 * season + 2) & F.lit(season > 1), 1).otherwise(0)
    rows = rows.withColumns({"p_max": p_max, "s_max": s_max})
    rows = rows.withColumn("start", F.greatest(F.col("p_max"), F.col("s_max") * season)).withColumn("seasonal_period", F.lit(season))
    rows = rows.withColumn("ar_p", F.explode(F.sequence(F.lit(0), "p_max")))
    rows = rows.withColumn("seasonal_p", F.explode(F.sequence(F.lit(0), "s_max")))
    return rows.withColumn("use_x", F.explode(F.array(F.lit(True), F.lit(False)) if exog else F.array(F.lit(False))))


def fit(
    train: DataFrame, horizons: DataFrame | Column, season: int, months: int, index: DataFrame | None = None,
    parts: int | None = None, keep: Column | None = None,
) -> DataFrame:
    """J7, J10. The best candidate of each series with its fitted values ahead.

    `train` (unique_id, ds, y[, cpi]). `horizons` is a table (unique_id, h) or a column over the
    folded series (last_ds, n_obs), which saves a second pass; `keep` filters the folded series
    likewise. Series with h = 0 are not fitted.
    """
    spark = train.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    exog = index is not None
    folded = fold(train, parts, exog)
    if isinstance(horizons, DataFrame):
        folded = folded.join(horizons.filter(F.col("h") > 0).select("unique_id", "h"), "unique_id")
    else:
        folded = folded.withColumn("h", horizons).filter(F.col("h") > 0)
    if keep is not None:
        folded = folded.filter(keep)
    folded = folded.withColumn("h", F.col("h").cast("int"))
    if exog:
        folded = with_path(folded, index, months)
    else:
        folded = folded.withColumn("xf", F.lit(None).cast("array<double>"))
    cand = candidates(folded, season, exog).select(
        "unique_id", "last_ds", "h", "n_obs", "y", "x", "xf", "ar_p", "ar_d", "seasonal_p", "seasonal_period", "start", "use_x"
    )
    fits = cand.mapInPandas(_fit_batches, FIT)
    finite = F.col("aicc").isNotNull() & ~F.isnan("aicc") & (F.abs("aicc") < float("inf"))
    order = F.struct("aicc", "ar_p", "seasonal_p", "use_x")
    rest = [c for c in fits.columns if c != "unique_id"]
    best = fits.filter(finite).groupBy("unique_id").agg(F.min_by(F.struct(*rest), order).alias("b"))
    return best.select("unique_id", "b.*")


def forecast_rows(fits: DataFrame, months: int) -> DataFrame:
    """Point and 80 / 95 % bands per horizon step; a fit without variance yields NaN bands."""
    steps = fits.select("unique_id", "last_ds", F.posexplode(F.arrays_zip("y_hat", "se")).alias("pos", "f"))
    k = F.col("pos") + 1
    se = F.when(F.col("f.se") > 0, F.col("f.se")).otherwise(F.lit(float("nan")))
    y = F.col("f.y_hat")
    return steps.select(
        "unique_id", F.add_months("last_ds", k * months).alias("ds"), k.cast("int").alias("horizon_q"), y.alias("y_hat"),
        (y - Z_80 * se).alias("y_hat_lo_80"), (y + Z_80 * se).alias("y_hat_hi_80"), (y - Z_95 * se).alias("y_hat_lo_95"), (y + Z_95 * se).alias("y_hat_hi_95"),
    )


def fit_forecast(
    train: DataFrame, horizons: DataFrame | Column, season: int, months: int, index: DataFrame | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """J7."""
    return forecast_rows(fit(train, horizons, season, months, index, keep=keep), months)


def backtest(train: DataFrame, index: DataFrame | None, h: int = 4, folds: int = 1, season: int = 4, months: int = 3) -> DataFrame:
    """J12. Hold out the last h rows, refit on the rest, score: (series_id, smape, n_obs).

    `folds` > 1 rolls the cut back h rows at a time; each fold is its own series of one fit job, and
    the folds of a series are averaged.
    """
    n_folds = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    back = F.row_number().over(windows.W.partitionBy("unique_id").orderBy(F.col("ds").desc()))
    trimmed = train.withColumn("back", back).withColumn("fold", n_folds).filter(F.col("back") > F.col("fold") * h)
    keyed = trimmed.withColumn("unique_id", F.concat_ws("#", "unique_id", F.col("fold").cast("string"))).drop("fold", "back")
    # Read by the fit and by the scoring.
    marked = cut(windows.holdout(keyed, h))
    inside, outside = marked.filter(~F.col("is_holdout")), marked.filter(F.col("is_holdout"))
    fits = fit(inside.drop("is_holdout"), F.lit(h), season, months, index)
    ahead = fits.select("unique_id", "last_ds", "n_obs", F.posexplode("y_hat").alias("pos", "y_hat"))
    fc = ahead.select("unique_id", F.add_months("last_ds", (F.col("pos") + 1) * months).alias("ds"), "y_hat", "n_obs")
    scored = fc.join(outside.select("unique_id", "ds", "y"), ["unique_id", "ds"])
    per_fold = scored.groupBy("unique_id").agg(
        F.avg(aggs.symmetric_error(F.col("y"), F.col("y_hat"))).alias("smape"), F.max("n_obs").alias("n_obs")
    )
    base = F.split_part(F.col("unique_id"), F.lit("#"), F.lit(1))
    return per_fold.groupBy(base.alias("series_id")).agg(F.avg("smape").alias("smape"), F.max("n_obs").cast("int").alias("n_obs"))


def naive_backtest(train: DataFrame, h: int = 4, season: int = 4) -> DataFrame:
    """J12 baseline. sMAPE of the seasonal repeat over the last h rows."""
    marked = windows.holdout(train.select("unique_id", "ds", "y"), h)
    inside = marked.filter(~F.col("is_holdout"))
    fc = seasonal_naive(inside.drop("is_holdout"), h, season)
    scored = aggs.smape(fc, marked.filter(F.col("is_holdout")))
    return scored.select(F.col("unique_id").alias("series_id"), "smape", "n_scored")
