"""Every query that has SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wavesift.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, got.fetchall())


@pytest.fixture(scope="module")
def six_times(tmp_path_factory):
    """12,000 embeddings: those of sf0.01 again and again with shifted keys, more than an approximate quantile ranks exactly."""
    folder = str(tmp_path_factory.mktemp("six_times"))
    source = "(SELECT e.vec_id + i * 500 AS vec_id, e.* EXCLUDE vec_id FROM '/root/testdata/sf0.01/embeddings.parquet' e, (SELECT unnest(range(24)) AS i) ORDER BY 1)"
    duckdb.sql(f"COPY {source} TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["engine_epieparallel", "engine_sdr", "engine_wasp"])
def test_sequential_engine_matches_sql_where_ranks_must_be_exact(spark, six_times, name):
    df = entry.queries()[name](spark, six_times)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{six_times}/embeddings.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names_are_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
