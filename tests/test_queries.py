"""The entry points: every query has a name of its own, every SQL twin a query, and a sample of them agrees."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_flagship(spark, data):
    assert entry.entry(spark).count() > 0


def _cell(v):
    return v if isinstance(v, bool) or not isinstance(v, (int, float)) else round(float(v), 6)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_twin(spark, data, duck, name):
    got = entry.queries()[name](spark, data)
    cols = sorted(got.columns)
    canon = lambda rows: sorted(str([_cell(v) for v in r]) for r in rows)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert canon(map(tuple, got.select(*cols).collect())) == canon(rel.select(*[f'"{c}"' for c in cols]).fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_lean(spark, data):
    """Conversations are read at most twice and never exchanged; sets and subsets scan each table once."""
    q = entry.queries()
    for name in ("chat_render", "rouge_l", "action_summary", "action_obs_pairing"):
        plan = plan_of(q[name](spark, data))
        assert plan.count("Scan parquet") <= 2, name
        wide = [line for line in plan.splitlines() if "Exchange" in line and "RoundRobin" not in line and "Broadcast" not in line and ("chat" in line or "trajectory#" in line)]
        assert not wide, (name, wide)
    assert plan_of(q["testsets"](spark, data)).count("Scan parquet") == 0  # from checkpoints
    assert plan_of(q["subset_overlap"](spark, data)).count("Scan parquet") == 0
