"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(round(v, 6)) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def test_without_the_training_data_operators(monkeypatch):
    real = entry.importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name, *a: None if name in ("sparquill.llm", "corpus_pipeline") else real(name, *a))
    assert "corpus_keep_best" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
