"""Every catalogue query that SQL can express, against DuckDB on the same tables; the others against what they must hold."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sablelens.plans.containers import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    """These check themselves row by row: column ok."""
    rows = QUERIES[name](spark, TABLES)
    assert rows.count() > 0 and ("ok" not in rows.columns or rows.where("NOT ok").count() == 0)


def test_plans_push_down_and_broadcast_nothing_big(spark):
    plan = QUERIES["custom_rules_documents"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan and "Python" not in plan
