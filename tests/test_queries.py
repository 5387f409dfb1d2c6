"""Every registered query against DuckDB on the same small tables."""

import math

import duckdb
import pytest

from perilgrid.catalog import all_checks, all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def canon(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(cell(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_checks()))
def test_matches_sql(spark, duck, name):
    got = all_queries()[name](spark, SF).toPandas()
    want = duck.sql(all_checks()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_route_records_agree_with_their_paths(spark):
    got = all_queries()["r05_route_records"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) > 0 and (got["n_waypoints"] >= 0).all()
    assert all(math.isclose(d / 40 * 60, m, abs_tol=0.06 + 0.0075) for d, m in zip(got["distance_km"], got["estimated_duration_min"]))
