"""Physical-plan checks: pushdown/pruning, broadcast lookups, no Python in
hot paths, no cartesian products."""

from affect.plans.registry import all_queries
from tests.conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    q = all_queries()["x1_aggregate_metrics"](spark, SF01)
    p = _plan(q)
    assert "ReadSchema: struct<l_orderkey" not in p or "l_shipdate" not in p.split("ReadSchema")[1].split("\n")[0]


def test_no_python_or_cartesian_in_hot_paths(spark):
    qs = all_queries()
    for name in ["a3_emotion_pairs", "l6_one_hot", "m0_load_labels", "m10_emotion_report", "t6_tfidf_keywords",
                 "d2_label_filter", "d16_downsample", "x6_pairwise_t_architecture"]:
        p = _plan(qs[name](spark, SF01))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p, name


def test_label_lookups_are_broadcast(spark):
    p = _plan(all_queries()["d2_label_filter"](spark, SF01))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_normality_has_no_python_step(spark):
    p = _plan(all_queries()["x3_normality_architecture"](spark, SF01))
    assert "Pandas" not in p and "Python" not in p and "Arrow" not in p
