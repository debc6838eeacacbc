"""Every operator query with oracle SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lamina.llm.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no sample tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == rows


def test_every_query_has_an_oracle_or_a_plain_version():
    assert set(QUERIES) - set(ORACLES) == {"op2_quality_classifier", "op4_feistel_sharding", "op5_html_extraction", "op10_mixing"}
