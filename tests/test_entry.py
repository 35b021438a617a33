"""The driver's contract: the flagship query, and every query that SQL can say held against it."""

import importlib.util
import sys

import pytest

import __spark_entry__
from ordinalis import ledger_queries, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df):
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


QUERIES, SQL = queries.queries() | ledger_queries.queries(), queries.oracle_sql() | ledger_queries.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    found, expected = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and plain(found) == plain(expected)


def test_without_the_training_data_operators(monkeypatch):
    """The entry point imports, and the store's queries are there, when the subpackage and the pipeline are not."""
    for name in [m for m in sys.modules if m.startswith("ordinalis.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import ordinalis

    class Gone:
        """Finds nothing for the two, as where their files are deleted."""

        def find_spec(self, name, path=None, target=None):
            if name in ("ordinalis.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.delattr(ordinalis, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    spec = importlib.util.spec_from_file_location("entry_alone", __spark_entry__.__file__)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.queries()) == set(QUERIES) and set(module.oracle_sql()) == set(SQL)
