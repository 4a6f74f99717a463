"""Plan shapes: what reaches the scan, and what must never meet in one task."""

import re

import pytest
from pyspark.sql import functions as F

from lodeframe.catalog.base import Tables
from lodeframe.operators import ordered, templates
from lodeframe.operators.clean import outliers, scale
from lodeframe.operators.clean import rows as basic
from lodeframe.operators.clean.times import ts_features
from lodeframe.plans.spec import run_spec


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, t):
    spec = {"from": "lineitem", "columns": [{"column": "l_orderkey"}], "where": [{"column": "l_quantity", "op": ">", "value": 40}]}
    text = plan(run_spec(spark, spec, t.all("lineitem")))
    assert "GreaterThan(l_quantity" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", text)


def test_fitted_values_are_literals(t):
    text = plan(outliers.cap_outliers(t.lineitem.select("l_orderkey", "l_tax"), ["l_tax"]))
    assert "Exchange" not in text and "Subquery" not in text
    assert "Exchange" not in plan(scale.scale(t.lineitem, ["l_tax"], "standard"))


def single_partition_over_rows(df):
    """Exchanges to one partition whose child is not an aggregate, a count per range or a limit."""
    lines = plan(df).splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1 : i + 3])
            if not re.search(r"HashAggregate|SortAggregate|ObjectHashAggregate|Limit", below):
                bad.append(below)
    return bad


@pytest.mark.parametrize(
    "build",
    [
        lambda t: basic.ffill(t.events, ["value"], "ts", "event_id"),
        lambda t: basic.interpolate(t.events.select("event_id", "ts", "value"), ["value"], "ts", "event_id"),
        lambda t: ts_features(t.events, "ts", ["value"], "event_id"),
        lambda t: ordered.with_position(t.events, "ts", "event_id"),
        lambda t: ordered.value_ranks(t.lineitem, "l_quantity"),
        lambda t: templates.growth(t.orders, "o_orderdate", "o_totalprice"),
        lambda t: templates.rank_groups(t.part, "p_brand", "p_retailprice"),
        lambda t: templates.share_of_total(t.orders, ["o_orderstatus"], "n", "pct"),
    ],
)
def test_no_window_gathers_raw_rows(t, build):
    assert single_partition_over_rows(build(t)) == []


def test_group_limit_prunes_before_the_shuffle(t):
    assert "WindowGroupLimit" in plan(templates.top_per_group(t.orders, "o_orderpriority", "o_totalprice", 3))


def test_top_rows_need_no_full_sort(t):
    assert "TakeOrderedAndProject" in plan(templates.top_rows(t.lineitem, "l_extendedprice", 10))


def test_no_cross_join_in_one_row_statistics(t):
    for df in (templates.histogram(t.orders, "o_totalprice"), templates.zscore_outliers(t.orders, "o_totalprice"), templates.value_frequency(t.part, "p_type")):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
