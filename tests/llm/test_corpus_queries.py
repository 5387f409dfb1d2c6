"""The registered corpus queries that have SQL, against DuckDB."""

import duckdb
import pytest

from perilgrid.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    canon = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False))
    assert canon(got) == canon(want) and len(got)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
