"""Every registered query on the smallest tables: rows against its SQL, and no plan that pairs rows or runs row-wise Python."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check_queries  # noqa: E402

from ringside.catalog import load  # noqa: E402
from ringside.operators import record as r_  # noqa: E402
from ringside.plans.bridge import match_events  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in check_queries.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in FORBIDDEN if bad in plan]
    got = check_queries.rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        result = con.execute(ORACLES[name])
        assert got == check_queries.rows_of([x[0] for x in result.description], result.fetchall())


def test_session_blocks_and_meta_context_read_all_events(spark):
    ev = match_events(spark, SF)
    blocks = {r["block"].split(", job ")[1].split(")")[0] for r in QUERIES["session_blocks"](spark, SF).collect()}
    # A job whose matches have a decision has a profile.
    decided = r_.per_match(ev).where("winner in ('player', 'opponent')").select("job_id").join(ev.where("job_no % 7 <> 6"), "job_id", "left_semi").distinct()
    assert {r["job_id"] for r in decided.collect()} <= blocks
    top = max(r["count"] for r in ev.where("pokemon is not null").groupBy("pokemon").count().collect())
    field = [r["line"] for r in QUERIES["meta_context"](spark, SF).collect() if r["line"].startswith("FIELD-WIDE META: ")]
    assert len(field) == 1 and float(field[0].split(": ")[1].split(", ")[0].rsplit(" ", 1)[1].rstrip("%")) == top / 8


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
