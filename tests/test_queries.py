"""Registered queries against their SQL. Set ALL_QUERIES=1 for every query; the default is one per family."""

import os

import pytest

from marketloom.plans import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["win_05", "feat_08", "feat_17", "feat_19", "join_02", "join_12", "agg_01", "agg_08", "val_01", "src_06", "snk_05", "stat_10", "stat_19", "risk_13", "nlp_07", "evt_03", "mon_02", "aud_02", "ml_09", "res_03", "st_01"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query(spark, con, name):
    status, note, *_ = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "rows-only"), note


def test_model_queries_use_all_features(spark, monkeypatch):
    """The arguments only: the fits take minutes."""
    from marketloom.plans import h_model_queries as h
    from marketloom.plans import i_monitor_queries as i

    got = {}
    empty = spark.createDataFrame([], "importance_value double, importance_std double, accuracy double, worst_fold double, increment double")
    monkeypatch.setattr(h, "splits", lambda *a: (empty, empty, empty))
    monkeypatch.setattr(h, "materialize", lambda df, *a: df)
    monkeypatch.setattr(h.M, "pipeline", lambda *a: type("P", (), {"fit": lambda self, df: None})())
    monkeypatch.setattr(h.M, "permutation_importance", lambda model, df, features, *a, **kw: got.update(ml_16=(features, kw)) or empty)
    monkeypatch.setattr(i, "dataset", lambda *a: empty)
    monkeypatch.setattr(i.M, "ablation", lambda df, groups, *a, **kw: got.update(res_05=groups) or empty)
    QUERIES["ml_16"](spark, SF)
    QUERIES["res_05"](spark, SF)
    assert got["ml_16"] == (h.FEATS, {}) and sum(got["res_05"].values(), []) == h.FEATS


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
