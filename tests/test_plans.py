"""What the physical plans must and must not contain."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from itemspark.catalog import QUERIES

PYTHON = {"c1", "c2", "c4", "c5", "f6", "i3", "k1"}
STREAMS = "j"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(STREAMS)])
def test_no_cross_joins_and_python_only_where_needed(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name.split("_")[0] not in PYTHON and name != "c4_failure_summary":
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["g1_top_k_per_key"](spark, SMALL))
    assert "row_number(), 2, Partial" in plan


def test_breakdown_reads_only_its_columns_and_shuffles_aggregates(spark):
    plan = plan_of(QUERIES["f1_score_breakdown_lineitem"](spark, SMALL))
    read = plan[plan.index("ReadSchema") :]
    assert "l_discount" in read and "l_extendedprice" not in read and "l_orderkey" not in read
    assert plan.index("Expand") < plan.index("l_discount")


def test_filters_reach_the_scan(spark):
    assert "EqualTo(event_type,error)" in plan_of(QUERIES["f8_failure_counts"](spark, SMALL))


def test_result_does_not_depend_on_partitions(spark):
    from itemspark.fixtures import Data
    from itemspark.operators import joins, ranks

    rows = Data(spark, SMALL).view("eval_rows").select("ordinal", "standard", "difficulty", "type", "score")
    for op in (lambda d: ranks.failing_streaks(d, passing=0.95), ranks.first_passing_candidate, lambda d: joins.retrieve_examples(d, d)):
        one = sorted(map(str, op(rows.repartition(1)).collect()))
        many = sorted(map(str, op(rows.repartition(64, F.rand(3))).collect()))
        assert one == many
