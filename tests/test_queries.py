"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from fleetquery.plans import catalog


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if pd.api.types.is_scalar(v) and pd.isna(v) else v

    return sorted(repr([plain(v) for v in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, small, oracle):
    got = catalog.QUERIES[name](spark, small).toPandas()
    if name in catalog.SQL:
        want = oracle.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_joins_do_not_meet_everything(spark, small):
    """No join without keys but with a one-row or size-checked side."""
    for name in ("extent_overlap", "range_overlap_join", "page_delta", "effective_capacity", "quorum_select", "log_compaction"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_scans_read_only_what_they_use(spark, small):
    plan = catalog.QUERIES["dangling_entries"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_name" not in plan
    plan = catalog.QUERIES["drain_targets"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,3)" in plan
