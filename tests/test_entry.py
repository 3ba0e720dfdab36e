import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from vectorloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, engine, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = engine.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(rounded(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in order) for r in rows), key=repr) == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("vectorloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "vectorloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(registry.queries())
    assert set(again.oracle_sql()) == set(registry.oracle_sql())
    monkeypatch.undo()
    importlib.reload(entry)


def test_library_does_not_import_the_corpus_operators():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "vectorloom.llm" not in path.read_text(), path
