"""Queries that SQL can say, against DuckDB over whole tables."""

import pytest

from ordinalis.llm import entry

FOLDER = "/root/testdata/sf0.001"


def plain(df):
    return sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found, expected = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and plain(found) == plain(expected)
