"""Every query with SQL equals DuckDB's result on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from spindrift.jobs import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_duckdb(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["band_pass", "hilbert_envelope", "mua_envelope", "spike_density", "phase_amplitude_coupling", "ncc_template", "find_peaks_distance_prominence"])
def test_signal_queries_take_every_channel(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("max(size(embedding))").first()[0]
    got = {r["channel"] for r in catalogue.QUERIES[name](spark, sf_dir).select("channel").distinct().collect()}
    assert got == set(range(n)) and n > 4
