"""Every registered query against its SQL oracle."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from faultline.plans import load_all
from faultline.plans.registry import QUERIES, TABLES, oracles

load_all()
ORACLES = oracles()
MODELS = {"q_ablation", "q_grid", "q_cv_auc", "q_svm_scores", "q_svm_weighted", "q_rf_scores", "q_lr_scores", "q_la_scores", "q_permutation"}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(autouse=True)
def fewer_rounds(request, monkeypatch):
    """The permutation query without an oracle is tried with few rounds here; the full number is its own business."""
    from faultline.plans import statistics

    if request.node.name == "test_model_queries_give_rows[q_permutation]":
        monkeypatch.setattr(statistics, "ROUNDS", 200)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_only_models_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == MODELS
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert ordered(df.columns, df.collect()) == ordered(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(MODELS))
def test_model_queries_give_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows
    if "roc_auc" in rows[0]:
        assert all(0 <= r["roc_auc"] <= 1 for r in rows)
    if "p_value" in rows[0]:
        assert all(0 < r["p_value"] <= 1 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
