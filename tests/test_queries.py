"""Every query that has SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

from lemmaflow.plans.oracle import ORACLE
from lemmaflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, DATA), duck.sql(ORACLE[name])
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr([tidy(r[c]) for c in sorted(names)]) for r in df.collect())
    expected = sorted(repr([tidy(r[names.index(c)]) for c in sorted(names)]) for r in rel.fetchall())
    assert got == expected


def test_the_library_does_not_need_the_subpackage():
    import lemmaflow

    root = os.path.dirname(lemmaflow.__file__)
    for path, _, files in os.walk(root):
        if os.path.basename(path) != "llm":
            assert not any("lemmaflow.llm" in open(os.path.join(path, f)).read() for f in files if f.endswith(".py"))
