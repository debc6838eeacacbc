import zlib

import pytest

from lamina.llm import sharding
from lamina.llm.common import expand


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 64, 101, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    got = spark.range(n).select(sharding.feistel("id", n, 42).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    if n > 100:
        other = spark.range(n).select(sharding.feistel("id", n, 43).alias("p")).collect()
        assert got != other and [r.p for r in got] != sorted(r.p for r in got)


def laws(rows, n_shards, n):
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, sizes.values())) == n
    counts = [len(sizes.get(i, [])) for i in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())


def test_manifest_with_nulls_repeats_and_reruns(make):
    docs = make(["a", None, "", "é", "x" * 100_000, (3, "é", "s"), (3, "é", "s"), (None, "a", "s"), (None, None, None)] + ["same"] * 30, extra=True)
    got = sharding.shard_documents(docs, 7).collect()
    laws(got, 7, docs.count())
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    again = sharding.shard_documents(docs.repartition(5), 7).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_table_keeps_columns_and_repeats(make):
    docs = make(["a", "b", None] + [(5, "r", "s")] * 6)
    got = sharding.shard_table(docs, 2)
    assert got.columns == [*docs.columns, "shard", "slot"]
    laws(got.collect(), 2, 9)
    assert sorted(map(repr, got.drop("shard", "slot").collect())) == sorted(map(repr, docs.collect()))
    assert sharding.shard_table(make(["a", "b"], extra=True), 2).columns[-2:] == ["shard", "slot"]


def test_empty_table(make):
    assert sharding.shard_documents(make([])).collect() == []


def test_many_copies_are_dealt_in_chunks(spark):
    df = spark.createDataFrame([("a", 25_001), ("b", 2)], "k string, n bigint")
    got = expand(df, "n").collect()
    assert sorted(r.copy for r in got if r.k == "a") == list(range(25_001)) and len(got) == 25_003
