"""Every registered query against its SQL twin on the smallest test data, where that is at hand."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[k]) for k in names) for r in df.collect())
    want = sql.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(k) for k in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_optional_part():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "spanveil"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "spanveil.llm" not in p.read_text(), p
