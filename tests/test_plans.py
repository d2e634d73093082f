"""Plan-shape checks: no Python UDFs, no row shuffle where none is needed,
aggregation instead of windows, broadcasts where sizes are bounded, pushdown."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    # the library's own queries; those of the training-data operators choose their plans by other rules
    own = E.queries().keys() - E.LLM_QUERIES.keys()
    return {name: plan_of(E.queries()[name](spark, SF_SMALL)) for name in own}


def test_no_python_udfs(plans):
    for name, plan in plans.items():
        for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
            assert marker not in plan, f"{name} uses {marker}"


def test_no_window_operators(plans):
    # dedup is an aggregation, peer statistics are joined back and percentiles are narrowed by counts
    for name, plan in plans.items():
        assert " Window [" not in plan, name


def test_nothing_stays_cached(spark, plans):
    # the plans were built, with the jobs that building takes; now they run as well
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    for name in ("detect_outliers", "top_outliers", "volume_bands", "q_full_analysis", "q_outlier_customers", "analyze_narrative"):
        E.queries()[name](spark, SF_SMALL).collect()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0, name


def test_global_waterfall_has_no_row_shuffle(plans):
    plan = plans["compute_waterfall"]
    assert "HashAggregate" in plan and "SinglePartition" in plan
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_dedup_is_map_side_combined(plans):
    plan = plans["silver_transactions"]
    assert plan.count("SortAggregate") + plan.count("HashAggregate") >= 2  # partial + final


def test_outlier_stats_broadcast(plans):
    plan = plans["detect_outliers"]
    assert "BroadcastHashJoin" in plan and "Generate" in plan
    assert "Subquery" in plan  # the percentile row and the measured bytes are scalar subqueries, not joins


def test_no_cross_joins(plans):
    # one-row inputs are scalar subqueries; nothing pairs rows without a key
    for name, plan in plans.items():
        for marker in ("BroadcastNestedLoopJoin", "CartesianProduct"):
            assert marker not in plan, f"{name} uses {marker}"


def test_filters_reach_the_scan(spark):
    df = E.queries()["compute_waterfall_filtered"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(n_name,NATION_7)" in text or "n_name = NATION_7" in text.replace("(", " ").replace(")", " ")


def test_column_pruning(spark):
    plan = plan_of(E.queries()["compute_waterfall"](spark, SF_SMALL))
    assert "l_returnflag" not in plan and "o_totalprice" not in plan and "c_acctbal" not in plan


def test_reuse_modes(spark):
    from pocketlens.plans.catalog import Layers
    from pocketlens.plans.reuse import shared
    from pocketlens.sources.adapter import read_table

    scan = read_table(spark, SF_SMALL, "lineitem").select("l_quantity")
    assert shared(scan, "none") is scan
    written = shared(scan, "write")
    assert written.count() == scan.count() and written.inputFiles() != scan.inputFiles()
    with pytest.raises(ValueError):
        shared(scan, "auto")
    layers = Layers(spark, SF_SMALL, {"silver": scan})
    assert layers.reuse("silver") == "none" and layers.reuse("bronze") == "write"


def test_adapter_streams_line_items(plans):
    # every broadcast side is a dimension: the line items are never built into a hash table
    joins = [line for line in plans["bronze_transactions"].splitlines() if "BroadcastHashJoin" in line]
    assert len(joins) == 5 and all("BuildRight" in line for line in joins)
