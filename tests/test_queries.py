"""Every query of the catalogue against its SQL."""

import os

import duckdb
import pytest
from conftest import SF

from concord.plans import catalogue, catalogue_config, catalogue_runs, catalogue_sync  # noqa: F401  # each adds its queries
from tools.compare import rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = duck.execute(catalogue.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in rel.description], rel.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_scans_read_only_what_is_needed(spark):
    plan = catalogue.QUERIES["semi_bound_refs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan and "EqualTo(o_orderstatus,F)" in plan
