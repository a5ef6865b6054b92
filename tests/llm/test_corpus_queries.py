"""The registered corpus queries that have SQL, next to DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import check_queries  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from ringside.llm import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_rows(spark, name):
    con = duckdb.connect()
    for table in check_queries.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    assert check_queries.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check_queries.rows_of([x[0] for x in result.description], result.fetchall())
