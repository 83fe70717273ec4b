"""Plans: filters and columns reach the scan, and no query multiplies its tables."""

import re

import pytest

from wavesift.plans import more_queries, scan_queries

SF = "/root/testdata/sf0.001"
QUERIES = scan_queries.QUERIES | more_queries.QUERIES


def plan_of(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_rocking", "stream_chunk_counts"}))
def test_no_product_of_tables(spark, name):
    assert not re.search("CartesianProduct|NestedLoopJoin", plan_of(spark, name))


@pytest.mark.parametrize(
    "name,columns",
    [
        ("frame_stats", {"l_orderkey", "l_quantity", "l_returnflag"}),
        ("mass_center", {"l_orderkey", "l_linenumber", "l_quantity"}),
        ("stxm_scatter", {"l_linenumber", "l_quantity", "l_extendedprice"}),
        ("delxf", {"event_id", "ts", "user_id", "value"}),
    ],
)
def test_scans_read_what_is_used(spark, name, columns):
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(spark, name))[1]
    assert {c.split(":")[0] for c in read.split(",")} == columns


@pytest.mark.parametrize("name,filter_", [("table_select_range", "GreaterThanOrEqual(p_size,10)"), ("table_select_match", "EqualTo(c_mktsegment,BUILDING)"), ("scan_subset", "LessThanOrEqual(value,60.0)")])
def test_filters_are_pushed_down(spark, name, filter_):
    assert filter_ in plan_of(spark, name).split("PushedFilters:")[1]


def test_python_stays_out_of_sql_queries(spark):
    for name in set(QUERIES) - {"stream_rocking", "stream_chunk_counts"}:
        assert not re.search("Python|Pandas|ArrowEval", plan_of(spark, name)), name
