"""Every registered query against its SQL twin, over whole tables of the smallest test data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tablewarden.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def normal(rows):
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in res.fetchall()]
    assert normal(map(tuple, got)) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_texts_without_a_twin_have_no_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"near_duplicate_lsh", "step_feedback"}
    assert set(catalogue.queries()) <= set(entry.queries()) and set(catalogue.oracle_sql()) <= set(entry.oracle_sql())
