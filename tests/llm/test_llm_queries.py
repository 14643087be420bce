"""Queries of the training-data operators against DuckDB, where SQL can say them."""

import duckdb
import pytest

from fleetquery.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(name, spark, small):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
