"""Every registered query against its DuckDB twin on the smallest tables.

The driver runs the same comparison at sf0.01; this keeps it in the test
suite.  Queries without a twin are run for a non-empty, stable schema.
"""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from helixframe.sources.tables import TABLES
from tests.conftest import SMALL

QUERIES = E.queries()
SQL = E.oracle_sql()


def _norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, (float, np.floating)):
        v = float(v)
        return ("nan",) if math.isnan(v) else ("f", v + 0.0)
    if isinstance(v, (bool, np.bool_)):
        return ("b", bool(v))
    if isinstance(v, (int, np.integer)):
        return ("f", float(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return ("l", tuple(_norm(x) for x in v))
    if hasattr(v, "asDict"):
        return ("d", tuple(sorted((k, _norm(x)) for k, x in v.asDict().items())))
    return ("s", str(v))


def _canon(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(_norm(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    yield c
    c.close()


def _probabilities(rows):
    assert all(0 <= r["p_pos"] <= 1 for r in rows) and len({r["row_id"] for r in rows}) == len(rows)
    assert all(r["prediction"] == round(r["p_pos"]) for r in rows if "prediction" in r)


def _reloaded(rows):
    _probabilities(rows)
    assert all(r["p_pos"] == r["p_saved"] for r in rows) and {r["fold"] for r in rows} == set(range(10))


def _folds(rows):
    assert len(rows) == 4 * 11
    for model in {r["model"] for r in rows}:
        mine = [r for r in rows if r["model"] == model]
        mean = next(r for r in mine if r["fold"] is None)
        for m in ("loss", "accuracy", "auc", "mcc", "f1", "precision", "recall"):
            assert mean[m] == pytest.approx(sum(r[m] for r in mine if r["fold"] is not None) / 10, abs=1e-5)


def _trials(rows):
    for model in {r["model"] for r in rows}:
        last = [r for r in rows if r["model"] == model and r["rung"] == 1]
        assert [r["log_loss"] for r in last if r["best"]] == [min(r["log_loss"] for r in last)]


#: What must hold of the queries that SQL cannot express.
PROPERTIES = {"fit_logistic": _probabilities, "fit_random_forest": _probabilities, "fit_boosted_trees": _probabilities, "fit_rbf_svm": _probabilities,
              "positive_probability": _probabilities, "model_reload": _reloaded, "cross_validate": _folds, "param_search": _trials}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    if key not in SQL:
        assert df.columns and len(got) > 0
        PROPERTIES.get(key, lambda rows: None)([dict(zip(df.columns, r)) for r in got])
        return
    cur = con.execute(SQL[key])
    cols = [d[0] for d in cur.description]
    assert _canon(df.columns, got) == _canon(cols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "sort_pos" in df.columns
