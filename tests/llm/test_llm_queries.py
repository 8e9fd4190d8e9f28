"""Every query of the subpackage over whole tables of the smallest test data, against its SQL twin where it has one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tablewarden.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def normal(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        res = con.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        assert normal(got) == normal(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.queries()}
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
