"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def connect(sf_dir):
    def open_():
        c = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        return c
    return open_


CHECKED = [m for m in entry.MODULES if m.__name__.startswith("checks.")]
NAMES = sorted(name for m in CHECKED for name in m.QUERIES)


def test_every_query_has_sql():
    assert set(NAMES) == {name for m in CHECKED for name in m.ORACLE}
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, connect, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = connect().sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    expected = sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
    actual = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert actual == expected
    assert actual


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["domain", "pages", "mean_words", "thin_pages", "links_out"]
    assert df.count() > 0
