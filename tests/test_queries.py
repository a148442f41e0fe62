"""Every registered query with SQL gives the same rows in DuckDB, over the smallest tables."""

import duckdb
import pytest

from pagewright import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry_imports_without_the_training_subpackage(spark, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    try:
        entry = importlib.import_module("__spark_entry__")
    except ModuleNotFoundError as e:  # a module set to None names itself
        pytest.fail(str(e))
    assert set(catalog.queries()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)
