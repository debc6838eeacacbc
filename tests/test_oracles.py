"""Every query with oracle SQL, against DuckDB on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lamina.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float) and not math.isnan(x):
            return round(x, 9)
        return str(x) if isinstance(x, Decimal) else x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equals_oracle(spark, duck, name):
    run, sql = QUERIES[name]
    got = run(spark, DIR)
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)
