"""Plan guarantees over every registered query: no cross products, partial aggregation before shuffles."""

import pytest

import __spark_entry__ as E
from helpers import SMOKE

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, q in sorted(E.queries().items()):
        out[name] = q(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cross_products(plans):
    bad = {n: f for n, p in plans.items() for f in FORBIDDEN if f in p}
    assert bad == {}


def test_last_wins_is_partial(plans):
    assert "partial_max_by" in plans["catalog_last_wins"]
    assert "partial_max_by" in plans["tm_upsert_latest"]


def test_top_n_uses_window_group_limit(plans):
    assert "WindowGroupLimit" in plans["usage_context_topn"]
    assert "WindowGroupLimit" in plans["tm_knn"]


def test_scans_prune_columns(spark):
    df = E.queries()["catalog_missing"](spark, SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan and "p_size" not in plan
