"""The SQL twins of the training-data queries agree on the smallest tables."""

import os

import duckdb
import pytest

from stepforge.llm.oracle import oracle_sql
from stepforge.llm.queries import queries


def _cell(v):
    return v if isinstance(v, bool) or not isinstance(v, (int, float)) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_twin(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    got = queries()[name](spark, data)
    cols = sorted(got.columns)
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    canon = lambda rows: sorted(str([_cell(v) for v in r]) for r in rows)
    assert canon(map(tuple, got.select(*cols).collect())) == canon(rel.select(*[f'"{c}"' for c in cols]).fetchall())
