"""Physical-plan properties: JVM-only expressions, pruned scans, one pass for all folds."""

import re

import pytest

import __spark_entry__ as E
from clickstack.plans import registry
from conftest import SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas",
            "MapInArrow", "FlatMapCoGroupsInPandas")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


E.queries()  # loads the registry


@pytest.mark.parametrize("key", sorted(registry.ORACLE))
def test_no_python_udf(spark, key):
    p = plan(E.queries()[key](spark, SMALL))
    assert not any(n in p for n in PY_NODES), key


def test_projection_reaches_scan(spark):
    p = plan(E.queries()["scan_projection"](spark, SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas == ["struct<event_id:bigint,user_id:bigint,value:double>"]


def test_all_folds_from_one_aggregation(spark):
    """OOF pair stats for every fold come from ONE aggregation keyed without the fold,
    over one explode of the training rows; the OOF table unstacks folds from it."""
    from clickstack.operators import covis as cv
    from clickstack.plans.covis_queries import SPEC, train_with_folds
    tok = cv.token_rows(train_with_folds(spark, SMALL), SPEC, keep=["fold", "clicked"])
    p = plan(cv.pair_stats_wide(tok, SPEC))
    aggs = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", p)
    pair_aggs = [a for a in aggs if "token" in a]
    assert len(pair_aggs) == 2  # partial + final of the same single aggregation
    assert all("fold" not in a for a in pair_aggs)
    assert len(re.findall(r"Generate posexplode", p)) == 1
    assert "Generate inline" in plan(E.queries()["pair_stats_oof"](spark, SMALL))


def test_history_pool_partial_aggregation(spark):
    """Per-row pooling groups by row after a map-side partial collect (no window)."""
    p = plan(E.queries()["history_pool"](spark, SMALL))
    assert "partial_collect_list" in p
