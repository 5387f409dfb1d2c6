"""What the physical plans must and must not contain."""

import pytest

from perilgrid.catalog import all_queries

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in all_queries() if n not in ("r04_shortest_paths", "r05_route_records", "x05_explanation_lookup")))
def test_no_nested_loops_or_cross_joins(spark, name):
    p = plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["q01_region_board", "q02_region_detail", "w01_last_readings", "w02_latest_features"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert plan(spark, name).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["q03_recent_predictions", "q04_event_timeline", "q05_predicted_vs_actual", "q12_newest_alerts", "c03_latest_reports"])
def test_top_n_without_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_time_filter_reaches_the_scan(spark):
    p = plan(spark, "q03_recent_predictions")
    assert "GreaterThanOrEqual(o_orderdate" in p


def test_only_needed_columns_are_read(spark):
    p = plan(spark, "q06_accuracy")
    assert "l_extendedprice" not in p and "o_orderpriority" not in p


@pytest.mark.parametrize("name", ["x02_contributions", "x04_summaries", "x05_explanation_records", "v02_plausibility", "p03_risk_class"])
def test_row_wise_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_python_only_where_a_user_model_runs(spark):
    users = {"u01_sequence_model", "u02_score_head", "u03_image_model"}
    for name in all_queries():
        if name in ("r04_shortest_paths", "r05_route_records"):
            continue
        p = plan(spark, name)
        assert (name in users) == ("Pandas" in p or "ArrowEval" in p or "Python" in p), name
