"""Every core query against its SQL, and that none needs the llm package."""

import os

import duckdb
import pytest

import vanikosh
from vanikosh.plans import catalog

DATA = "/root/testdata/sf0.001"


def _key(frame):
    same = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    cols = sorted(frame.columns)
    return cols, sorted(repr(tuple(map(same, row))) for row in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_query_equals_sql(spark, duck, name):
    assert _key(catalog.queries()[name](spark, DATA).toPandas()) == _key(duck.sql(catalog.sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0


def test_nothing_outside_imports_llm():
    root = os.path.dirname(vanikosh.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "vanikosh.llm" not in open(os.path.join(folder, f), encoding="utf8").read()
