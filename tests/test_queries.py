"""Registered queries against their SQL, and the shape of their plans."""

import datetime as dt
import math

import duckdb
import pytest

from hourloom import plans
from hourloom.plans.views import TABLES

SF = "/root/testdata/sf0.001"


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)[:19].replace(" 00:00:00", "")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, other, name):
    got = plans.queries()[name](spark, SF)
    want = other.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["weekly_coverage", "resolve_day", "missing_days", "monthly_rollup", "conflict_pairs"])
def test_no_nested_loops(spark, name):
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_of_viewers_are_not_sorted(spark):
    from hourloom.operators.review import rows_visible_to

    rows, profiles = spark.createDataFrame([(1, 2, 3.0)], "user_id long, id long, total double"), spark.createDataFrame([(1, "admin")], "user_id long, role string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows_visible_to(rows, profiles, [1, 2])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "Sort [" not in plan


def test_split_conflicting_runs_whole(spark):
    rows = plans.queries()["split_conflicting"](spark, SF).collect()
    assert len(rows) == len({(r.ident, r.file_seq) for r in rows}) > 0


def test_replayed_batch_changes_nothing(spark, tmp_path):
    from hourloom.operators.review import upsert

    rows = spark.createDataFrame([(1, 2024, 1, 10, "a"), (1, 2024, 1, 11, "b"), (2, 2024, 1, 5, "c")], "user_id long, year int, month int, id long, status string")
    keys = ["user_id", "year", "month"]
    once = upsert(rows.limit(0), rows, keys, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert(once, rows, keys, ["id"]).collect()))
    assert {r.status for r in once.collect()} == {"b", "c"}
