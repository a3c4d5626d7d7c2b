"""Queries that read the observations several times derive them once and read them back."""

import pytest

from quartermark.workload import QUERIES
from quartermark.workload import base as B

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["J7_fit_forecast", "J10_model_table", "J11_borrowed_models", "J12_backtest", "D13_attach_forecast", "B5_idempotent_rewrite"])
def test_observations_are_derived_once(spark, monkeypatch, name):
    derived, written = [], []
    obs, table = B.obs, B.obs_table
    monkeypatch.setattr(B, "obs", lambda *a: derived.append(1) or obs(*a))
    monkeypatch.setattr(B, "obs_table", lambda *a: written.append(1) or table(*a))
    out = QUERIES[name](spark, SF)
    assert len(derived) == 1 and len(written) == 1
    assert not [f for f in out.inputFiles() if "lineitem" in f]


def test_models_of_a_region_fit_its_series_only(spark, monkeypatch):
    from quartermark.plans import models as M

    code = "20003"
    ids, fit = [], M.fit
    monkeypatch.setattr(M, "fit", lambda train, *a, **k: ids.extend(r[0] for r in train.select("unique_id").distinct().collect()) or fit(train, *a, **k))
    QUERIES["C3_region_models"](spark, SF)
    assert ids and all(code in i.split("|")[2].split("-") for i in ids)
