"""Every store query against its SQL form, and the entry module without the optional part."""

import glob
import os

import pytest

import __spark_entry__ as entry
from foldstore.plans import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(v) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry_without_the_optional_part(monkeypatch):
    import importlib

    real = importlib.import_module

    def without(name, *a):
        if name.startswith(("foldstore.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    assert set(entry.queries()) == set(workload.QUERIES) and set(entry.oracle_sql()) == set(workload.ORACLES)
