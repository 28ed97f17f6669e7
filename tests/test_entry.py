"""The driver's contract: every registered query runs; those with SQL give the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: All graph queries but the one that walks a long chain; the training-data operators have their own tests.
CHOSEN = sorted(queries.ORACLES.keys() - {"repeat_long_chain"})


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    ours = sorted(str([plain(v) for v in r]) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    assert ours == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_names():
    assert queries.ORACLES.keys() <= queries.QUERIES.keys() <= entry.queries().keys()
