"""Sharding by a Feistel permutation of global row numbers (native).

Every row gets a dense global number from its content: rows are collapsed to
(columns, copies), dealt into ``n_buckets`` hash buckets, and numbered inside each
bucket after the bucket's offset. A keyed Feistel network over Z_a x Z_b with
a*b just above the row count permutes the numbers; a result outside the range is
permuted again (cycle walking) until it is inside. Position p gives shard
``p % n_shards`` and slot ``p div n_shards``: both can be computed from a row
number alone, shard counts differ by at most one, and slots have no gaps.

Defined results: the number depends on the content and not on files or
partitions, so reruns agree; rows that are equal in all columns take different
positions but are interchangeable; nulls are values like any other; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import expand, materialize, text_or_empty

ROUNDS = 4
#: Cycle walking leaves the range with probability under 1/sqrt(n) at each step.
MAX_WALK = 64


def feistel(row: str, n: int, seed: int) -> Column:
    """Position of row number ``row`` (an SQL expression, 0 <= row < n) under the
    keyed permutation of 0..n-1."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    left = f"(s.l + pmod(xxhash64(s.r, i, {seed}L), {a}L)) % {a}L"
    network = (
        f"aggregate(sequence(1L, {ROUNDS}L), named_struct('l', p div {b}L, 'r', p % {b}L), "
        f"(s, i) -> named_struct('l', {left}, 'r', (s.r + pmod(xxhash64({left}, -i, {seed}L), {b}L)) % {b}L), s -> s.l * {b}L + s.r)"
    )
    walked = f"aggregate(sequence(1, {MAX_WALK}), bigint({row}), (p, w) -> if(w > 1 and p < {n}L, p, {network}))"
    return F.expr(f"transform(array({walked}), p -> if(p < {n}L, p, bigint(raise_error('cycle walking did not end'))))[0]")


def number_rows(df: DataFrame, n_buckets: int = 4096) -> tuple[DataFrame, int]:
    """df's distinct rows with ``copies`` and ``first_no``, the global number of
    the first copy; and the number of rows in all. Columns named copies, first_no
    or bucket must not be in df."""
    names = df.columns
    key = [F.col(f"`{c}`") for c in names]
    rows = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(n_buckets)).cast("int")), "rows")
    # n_buckets rows at most, whatever the input: one task and a broadcast are enough.
    sizes = rows.groupBy("bucket").agg(F.sum("copies").alias("in_bucket"))
    offsets = materialize(sizes.select("bucket", "in_bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("offset")), "offsets")
    n = offsets.agg(F.sum("in_bucket")).first()[0] or 0
    inside = Window.partitionBy("bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("copies").over(inside)).join(F.broadcast(offsets.drop("in_bucket")), "bucket")
    return rows.select(*key, "copies", (F.col("offset") + F.col("upto") - F.col("copies")).alias("first_no")), n


def shard_rows(df: DataFrame, n_shards: int = 40, seed: int = 20_240_501) -> DataFrame:
    """All rows of df with ``shard`` int and ``slot`` long."""
    numbered, n = number_rows(df)
    rows = expand(numbered, "copies")
    placed = rows.withColumn("position", feistel("first_no + copy", n, seed))
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("position") % n_shards).cast("int").alias("shard"), F.expr(f"position div {n_shards}L").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 20_240_501) -> DataFrame:
    """The manifest of docs: doc_id, size (UTF-8 bytes of the text, null: none,
    plus 16), text_crc32, shard and slot. Only these digests are shuffled, never texts."""
    text = text_or_empty()
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(slim, n_shards, seed)


def shard_table(docs: DataFrame, n_shards: int = 40, seed: int = 20_240_501) -> DataFrame:
    """docs with shard and slot, which replace columns of those names. Positions are
    computed from digests; a row's columns are shuffled once, and equal rows travel as one."""
    names = docs.columns
    text = text_or_empty()
    key = ["k_id", "k_size", "k_crc", "k_row"]
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").alias("k_id"), (F.octet_length(text) + 16).cast("bigint").alias("k_size"),
        F.crc32(text.cast("binary")).alias("k_crc"), F.xxhash64(*(F.col(f"`{c}`") for c in names)).alias("k_row"),
    )
    places = shard_rows(keyed.select(*key), n_shards, seed)
    rows = keyed.groupBy(*key).agg(F.first("row").alias("row"))
    joined = rows.alias("r").join(places.alias("p"), F.expr(" and ".join(f"r.{k} <=> p.{k}" for k in key)))
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in names if c not in ("shard", "slot")), "shard", "slot")


def op4_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
