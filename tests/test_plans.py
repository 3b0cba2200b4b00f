"""Physical plans: filters and columns reach the scan, nothing is crossed or collected."""

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize(
    "name", "q_metric_table q_cve_mappings q_leave_one_out q_interval_overlap q_rule_extract q_merge_hunks q_keyword_weights q_code_age".split()
)
def test_no_cross_join(spark, sf_dir, name):
    text = plan(spark, QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_range_filter_reaches_the_scan(spark, sf_dir):
    text = plan(spark, QUERIES["q_range_scan"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThanOrEqual(o_orderdate" in text
    assert "o_totalprice" not in text


def test_outer_join_becomes_inner(spark, sf_dir):
    text = plan(spark, QUERIES["q_left_join_dropna"](spark, sf_dir))
    assert "LeftOuter" not in text
