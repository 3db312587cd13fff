"""Every registered query with SQL must equal that SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_point
from check import TABLES, cell

CHECKED = sorted(entry_point.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, sf, name):
    frame = entry_point.queries()[name](spark, sf)
    order = sorted(frame.columns)
    got = sorted((tuple(cell(r[c]) for c in order) for r in frame.collect()), key=repr)
    cursor = con.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == order
    at = [columns.index(c) for c in order]
    want = sorted((tuple(cell(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


TEXT_RULES = [name for name in sorted(entry_point.queries()) if name[0] == "x" and name[1].isdigit()]


@pytest.mark.parametrize("name", TEXT_RULES)
def test_text_rules_read_the_texts(spark, sf, name):
    plan = entry_point.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert any("text:string" in line for line in plan.split("\n") if "ReadSchema" in line or "FileScan" in line)
