"""Every registered query against its DuckDB oracle (row count, column names,
order-insensitive values) on the smallest shared tables."""

import pytest

import __spark_entry__ as E
from sevlake.plans.registry import ORACLE, QUERIES
from sevlake.schema import SEVERITY_ORDER
from tests.conftest import SF_SMALL
from tools.check_oracle import canon, duck_con

NAMES = sorted(QUERIES)  # the training-data queries are tested in tests/llm


def _shares(rows):
    assert rows["row_id"].is_unique
    assert all(abs(sum(p) - 1) < 1e-9 and max(range(3), key=lambda i: p[i]) == q for p, q in zip(rows["proba"], rows["pred"], strict=True))


def _sweep(rows):
    best = rows.sort_values(["macro_f1", "ece", "c"], ascending=[False, True, True], kind="stable").iloc[0]
    assert sorted(rows["c"]) == [0.5, 1, 2, 4, 8] and list(rows.loc[rows["selected"], "c"]) == [best["c"]]


def _temperature(rows):
    r = rows.iloc[0]
    assert len(rows) == 1 and 0.05 <= r["temperature"] <= 5 and 0 <= r["ece"] <= 1 and 0 <= r["brier"] <= 2


def _scores(rows):
    assert rows["row_id"].is_unique and set(rows["label"]) <= set(SEVERITY_ORDER) and rows["max_probability"].between(1 / 3, 1).all()


#: What must hold of iterative fits, which have no SQL.
PROPERTIES = {
    "k7_logreg_predictions": _shares, "k7_text_predictions": _shares, "k8_c_sweep": _sweep, "k8_text_refit": _sweep,
    "k15_calibration_report": _temperature, "a17_scored_sink": _scores,
}


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    sp = df.toPandas()
    sql = ORACLE.get(name)
    if sql is None:
        assert len(sp) > 0
        PROPERTIES.get(name, lambda rows: None)(sp)
        return
    dk = con.execute(sql).df()
    c1, r1 = canon(sp)
    c2, r2 = canon(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_runs(spark):
    out = E.entry(spark)
    rows = out.collect()
    assert len(rows) == 1 and rows[0]["total"] > 0


def test_entry_has_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())
