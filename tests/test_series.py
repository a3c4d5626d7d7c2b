from datetime import date

import numpy as np
import pytest
from helpers import obs_frame, rental, sale
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import joins, quality
from quartermark.plans import models as M
from quartermark.plans import series as S
from quartermark.plans import yields as Y
from quartermark.schemas import BANDS, schema

TODAY = date(2026, 5, 13)


def test_direct_yield(spark):
    y = Y.direct_yields(obs_frame(spark, rental("house", "2", 500) + [sale("house", 520_000)])).collect()
    assert len(y) == 1 and y[0].gross_yield == pytest.approx(0.05, abs=1e-9) and y[0].source == "suburb_direct"


def test_direct_yield_ignores_imputed_rows(spark):
    rows = rental("house", "2", 500) + rental("house", "all", 900, source_file="imputed:x")
    y = Y.direct_yields(obs_frame(spark, rows + [sale("house", 520_000), sale("unit", 1, source_file="imputed:y")])).collect()
    assert [round(r.gross_yield, 9) for r in y] == [0.05]


def test_bedroom_borrowing_and_its_model_rows(spark):
    o = obs_frame(spark, rental("house", "2", 400) + rental("house", "3", 600) + [sale("house", 520_000)])
    y = Y.direct_yields(o)
    none = spark.createDataFrame([], schema("forecasts"))
    got = {r.bedrooms: r.y_hat for r in Y.borrowed_sales(o, y, none, TODAY).collect()}
    assert got == pytest.approx({"2": 416_000, "3": 624_000})
    have = Y.borrowed_sales(o, y, none, TODAY).filter(F.col("bedrooms") == "2")
    rest = Y.borrowed_sales(o, y, have, TODAY)
    assert [r.bedrooms for r in rest.collect()] == ["3"]
    classes = spark.createDataFrame([], "series_id string, source_class string")
    models = S.borrowed_models(rest, spark.createDataFrame([], schema("forecast_models")), classes, TODAY).collect()
    assert len(models) == 1 and models[0].ar_p is None and models[0].source_class == "unknown"


def _grid_rows(n=24, rent=500):
    return [r for i in range(1, n + 1) for r in rental("all", "all", rent, geospatial_codes=str(20000 + i))]


def _hier(spark):
    rows = [(str(20000 + i), "sal", f"sal_L{lv}_C{i % k}", lv, 0.0) for i in range(1, 26) for lv, k in ((5, 5), (1, 1))]
    return spark.createDataFrame(rows, schema("geographic_hierarchy"))


def test_cluster_fallback_takes_the_smallest_cluster(spark):
    o = obs_frame(spark, _grid_rows() + [sale("house", 520_000, geospatial_codes="20025")])
    got = Y.fallback_yields(o, Y.direct_yields(o), _hier(spark)).collect()
    assert [(r.geospatial_codes, r.provenance_cluster_id, r.source) for r in got] == [("20025", "sal_L5_C0", "cluster_fallback")]


def test_corroboration_divergence(spark):
    lgas = [r for i in range(9) for r in rental("all", "all", 480, geospatial_codes=f"9{i}", geospatial_type="lga")]
    got = Y.corroborate(obs_frame(spark, _grid_rows(25) + lgas), _hier(spark)).collect()
    assert len(got) == 9 and all(r.sal_cluster_level == 5 and r.divergence_pct == pytest.approx(100 * 20 / 480) for r in got)


def test_grid_inference(spark):
    f = lambda ms: S.infer_grid(spark.createDataFrame([(date(2020, m, 1),) for m in ms], "ds date")).first()[0]
    assert [f([3, 6, 9, 12]), f([2, 5]), f([1, 4, 7])] == ["QS-DEC", "QS-NOV", "QS"]


def test_horizons(spark):
    df = spark.createDataFrame([("a", date(2025, 7, 1), 1.0), ("b", date(2027, 1, 1), 1.0)], "unique_id string, ds date, y double")
    assert {r.unique_id: r.h for r in S.nowcast_h(df, TODAY).collect()} == {"a": 3, "b": 0}
    assert S.forward_h(TODAY) == 2 and S.forward_h(TODAY, h=9) == 9 and S.forward_h(date(2030, 1, 1)) == 0


def test_quarter_labels(spark):
    df = spark.createDataFrame([("2025-Q3",), ("2025-Q7",), ("junk",)], "t string")
    assert [r[0] for r in df.select(C.quarter_label_date("t")).collect()] == [date(2025, 9, 1), None, None]


def test_sigma_recovery(spark):
    rows = [("a", date(2025, 1, 1), 631.0, 669.0), ("a", date(2025, 4, 1), 0.0, 1e9), ("b", date(2025, 1, 1), None, None), ("c", date(2025, 1, 1), 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, ds date, y_hat_lo_95 double, y_hat_hi_95 double")
    got = {r.k: r.sigma for r in S.recover_sigma(df, ["k"]).collect()}
    assert 9.69 < got["a"] < 9.70 and got["b"] is None and got["c"] is None


def test_yield_series_pairs_and_qualifiers(spark):
    rows = []
    for m, v in ((3, 400), (6, 420), (9, 430), (12, 450)):
        rows += rental("house", "all", v, time_bucket=date(2022, m, 1), source_file="imputed:x")
    o = obs_frame(spark, rows + [sale("house", 500_000, time_bucket=date(2022, 1, 1))])
    fc = spark.createDataFrame(
        [("sal", "20001", m, "house", "all", date(2026, 6, 1), v) for m, v in (("rental", 600.0), ("sales", 600_000.0))],
        "tier string, code string, data_type string, dwelling_type string, bedrooms string, ts date, value double",
    )
    got = sorted((r.ts, r.value, r.qualifier) for r in S.yield_series(S.region_points(o), fc).collect())
    assert got[0][1:] == (pytest.approx(450 * 52 / 500_000), "partially_imputed")
    assert got[1][1:] == (pytest.approx(0.052), "forecast")


def _train(spark, n=100, seed=42):
    rng = np.random.default_rng(seed)
    cpi = 60 + np.cumsum(0.4 + 0.2 * rng.random(n + 12))
    days = [date(2000 + (q * 3 + 2) // 12, (q * 3 + 2) % 12 + 1, 1) for q in range(n + 12)]
    rows = [(u, days[i], float(b + k * cpi[i] * 5 + rng.normal(0, 4)), float(cpi[i])) for u, b, k in (("rental|suburb|1|house|2", 100, 0.5), ("rental|suburb|2|unit|1", 80, 0.3)) for i in range(n)]
    index = spark.createDataFrame([("M", d, float(c)) for d, c in zip(days, cpi)], schema("cpi"))
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, cpi double"), index, days[n - 1]


def test_fit_forecast_contract(spark):
    train, index, last = _train(spark)
    horizons = train.select("unique_id").distinct().withColumn("h", F.lit(5))
    fc = M.fit_forecast(train, horizons, 4, 3, index)
    rows = sorted(fc.collect())
    assert len(rows) == 10 and rows == sorted(M.fit_forecast(train, horizons, 4, 3, index).collect())
    assert min(r.ds for r in rows) > last
    assert all(r[a] <= r[b] for r in rows for a, b in zip(BANDS, BANDS[1:]))
    wide = [r.y_hat_hi_95 - r.y_hat_lo_95 for r in rows if r.unique_id.endswith("2|unit|1")]
    assert wide == sorted(wide)
    assert quality.check_bands(fc.withColumn("model", F.lit("m"))).first().n_violations == 0


def test_exogenous_regressor_drives_direction(spark):
    n = 60
    days = [date(2000 + (q * 3 + 2) // 12, (q * 3 + 2) % 12 + 1, 1) for q in range(n + 8)]
    rng = np.random.default_rng(3)
    x = 100 + 10 * rng.standard_normal(n + 8)
    rows = [("s", days[i], float(3 * x[i] + 0.01 * rng.standard_normal()), float(x[i])) for i in range(n)]
    train = spark.createDataFrame(rows, "unique_id string, ds date, y double, cpi double")
    h = spark.createDataFrame([("s", 8)], "unique_id string, h int")
    index = lambda f: spark.createDataFrame([("M", d, float(f(c))) for d, c in zip(days, x)], schema("cpi"))
    up = M.fit_forecast(train, h, 4, 3, index(lambda c: c + 50)).agg(F.avg("y_hat")).first()[0]
    down = M.fit_forecast(train, h, 4, 3, index(lambda c: c - 50)).agg(F.avg("y_hat")).first()[0]
    assert up - down == pytest.approx(300, rel=0.02)


def test_backtest_scores_every_series(spark):
    train, index, _ = _train(spark)
    got = M.backtest(train, index).collect()
    assert len(got) == 2 and all(r.n_obs == 96 and r.smape < 0.15 for r in got)
    assert M.backtest(train, index, folds=2).count() == 2


def test_constant_series_has_no_bands(spark):
    rows = [("s", date(2000 + i, 1, 1), 5.0) for i in range(8)]
    train = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    h = spark.createDataFrame([("s", 2)], "unique_id string, h int")
    assert S.valid_bands(M.fit_forecast(train, h, 1, 12)).count() == 0


@pytest.mark.parametrize("rental_smape,breach", [((0.10, 0.20, 0.25, 0.30, 0.40), True), ((0.05, 0.08, 0.10), False)])
def test_gate(spark, rental_smape, breach):
    d = spark.createDataFrame([(f"rental|s|{i}|h|2", v) for i, v in enumerate(rental_smape)], "series_id string, smape double")
    assert [r.breach for r in quality.quality_gate(d).collect()] == [breach]


def _exog_rows(spark, n, ends):
    rows = [("s", d, float(i % 7 + i), 1.0 + i) for i, d in enumerate(_quarters(n))]
    index = [(d, 1.0 + i) for i, d in enumerate(_quarters(n + ends))]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, cpi double"), spark.createDataFrame(index, "time_bucket date, index_value double")


def _quarters(n):
    from datetime import date

    return [date(1990 + i // 4, 3 * (i % 4) + 3, 1) for i in range(n)]


def test_horizon_has_no_cap(spark):
    train, index = _exog_rows(spark, 40, 45)
    assert M.fit_forecast(train, F.lit(45), 4, 3, index).count() == 45
    assert M.fit_forecast(train, F.lit(45), 4, 3).count() == 45


def test_short_or_doubled_index_fails(spark):
    train, index = _exog_rows(spark, 40, 10)
    with pytest.raises(Exception, match="lacks a date"):
        M.fit_forecast(train, F.lit(11), 4, 3, index).collect()
    with pytest.raises(Exception, match="lacks a date"):
        M.fit_forecast(train, F.lit(8), 4, 3, index.filter("time_bucket <> date '2001-03-01'")).collect()
    with pytest.raises(Exception, match="one region"):
        joins.with_exog(train.drop("cpi"), index.unionByName(index)).collect()
