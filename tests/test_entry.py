"""The driver's contract: queries run, and DuckDB gives the same rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from lethe import registry
from lethe.sources.tables import NAMES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in found.collect()]
    if sql := registry.oracle_sql().get(name):
        right = duck.sql(sql)
        assert sorted(found.columns) == sorted(right.columns)
        assert table(found.columns, rows) == table(right.columns, right.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_connected_groups_of_all_lines(spark, duck):
    parent: dict[str, str] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for order, supplier in duck.sql("SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem").fetchall():
        low, high = sorted((top(order), top(supplier)))
        parent[high] = low
    found = registry.queries()["connected_groups_all"](spark, FOLDER)
    assert sorted((r.node, r.root) for r in found.collect()) == sorted((x, top(x)) for x in list(parent))


def test_chosen_epochs_takes_the_earliest_of_equal_values(spark, tmp_path):
    types = ["click", "error", "view"]
    rows = [(k, k % 7, types[k % 3], [150.0, 160.5, None, 160.5, 3.0][k % 5], "{}") for k in range(400)] + [(None, 1, "click", 900.0, "{}"), (None, 2, "error", 900.0, "{}"), (400, 9, "error", 160.5, "{}"), (401, 9, "error", 160.5, "{}")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()["chosen_epochs"](spark, str(tmp_path))
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    right = con.sql(registry.oracle_sql()["chosen_epochs"])
    assert table(found.columns, [tuple(r) for r in found.collect()]) == table(right.columns, right.fetchall())
    assert {r.user_id: r.epoch for r in found.collect()}[9] == 400
