"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by a keyed hash into permuted blocks. A source
with target T and size S is taken ``floor(T / S)`` times whole; the rest comes from
its blocks in permuted order, the last of them cut at a document. So each source
has an exact quota of block draws. A binary tree over the output shards splits the
quotas: at each node the left half's share of every source is one draw from the
multivariate hypergeometric distribution, which keeps every source's total exact
and every shard's number of blocks fixed. Each shard then takes its disjoint draws
from the source's permuted ones, and its rows are shuffled locally by a keyed hash. A
row is taken as often as a shard of the tree has drawn its block.

Sources and their targets stay distributed, at any number: the water level of the targets
is found by sums over the sources, and the tree splits the quotas of POOLS pools, to which
sources are dealt by a hash. A pool's draws in permuted order go to its shards, which for
each source in it is again a draw from the multivariate hypergeometric distribution. The
driver holds the quotas of POOLS pools and splits the FRONTIER uppermost nodes; the
subtrees below are drawn by tasks, each node with a generator of its own, so that a lost
one is drawn again alike. Blocks grow in number with the input. A hot source is spread
over its blocks, and block sums are combined before the shuffle.

Defined results: null text or text without words has size 0 and takes nothing; a
null source is a source of its own and comes last; rows that are equal are counted
by number and may differ in ``taken``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.position import rank_rows
from .common import expand, materialize, ship_package, sized, text_or_empty

BLOCK_BITS = 12  # 4096 blocks a source, and more beyond BLOCK_WORDS * 4096 words in all
BLOCK_WORDS = 1_000_000
MAX_EPOCHS = 3
MIN_SHARDS = 32
SHARD_WORDS = 100_000_000  # about a task's worth of text
POOLS = 4096
FRONTIER = 64
SEED = 20_240_510
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: float = MAX_EPOCHS) -> list[float]:
    """Words to take from each source: shares of the sum of all sizes by weight, none
    over ``most`` times its size; what a capped source can't take is shared anew among
    the others by weight until none is above."""
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        rest -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def source_quotas(sources: DataFrame, weights: tuple[float, ...], seed: int) -> DataFrame:
    """The quota rows of ``sources`` (sk, source and size s) by the
    rule of ``targets``, of which only sums reach the driver. Each round raises the
    water level by what the sources that it caps can't take."""
    ranked = rank_rows(sources.select("sk", "s", "source", F.col("source").isNull().alias("none")), [("none", True), ("source", True)])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.select("sk", "s", weight.alias("w"))
    sums = (F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    every = weighed.agg(*sums).first()
    level, capped = every.s / every.w if every.n else 0.0, 0
    while True:
        wanted = F.lit(level) * F.col("w")
        over = weighed.where(wanted > MAX_EPOCHS * F.col("s")).agg(*sums).first()
        if over.n <= capped or over.n == every.n:
            break
        level, capped = (every.s - MAX_EPOCHS * over.s) / (every.w - over.w), over.n
    pool = F.pmod(F.xxhash64("sk", F.lit(seed + 2)), F.lit(POOLS)).cast("int")
    quota = weighed.select("sk", pool.alias("pool"), F.col("s").alias("source_size"), F.least(wanted, (MAX_EPOCHS * F.col("s")).cast("double")).alias("target"))
    quota = quota.withColumn("epochs", F.expr("if(source_size = 0, 0, int(floor(target / source_size)))"))
    return quota.withColumn("rest", F.expr("target - epochs * source_size"))


def _room(lo: int, hi: int, total: int, n_shards: int) -> int:
    """Draws that shards lo to hi - 1 have room for: shards are at most one apart."""
    return (hi - lo) * (total // n_shards) + max(0, min(hi, total % n_shards) - lo)


def _halves(lo: int, hi: int, q: np.ndarray, total: int, n_shards: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """The two children of a node of the tree."""
    mid = (lo + hi) // 2
    left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, _room(lo, mid, total, n_shards), method="marginals")
    return [(lo, mid, left), (mid, hi, q - left)]


def split_nodes(nodes: list[tuple[int, int, np.ndarray]], total: int, n_shards: int, seed: int, most: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """The leaves under some nodes (lo, hi, quotas), depth first: what is held is one
    node a level. With ``most``, nodes of about that many on a level are not split."""
    todo = nodes[::-1]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1 or most and (hi - lo) * most <= n_shards:
            yield lo, hi, q
        elif q.any():
            todo += _halves(lo, hi, q, total, n_shards, seed)[::-1]


def split_tree(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Draws per pool (rows) and shard (columns): rows add up to the quotas, columns are
    at most one apart. For few shards only; split_quotas leaves the matrix distributed."""
    out = np.zeros((len(quotas), n_shards), dtype=np.int64)
    for lo, _, q in split_nodes([(0, n_shards, np.asarray(quotas, dtype=np.int64))], sum(quotas), n_shards, seed):
        out[:, lo] = q
    return out


def split_quotas(spark: SparkSession, quotas: dict[int, int], n_shards: int, seed: int) -> DataFrame:
    """(pool, shard, drawn) of the tree's leaves, where drawn > 0."""
    ship_package(spark)
    pools, total = sorted(quotas), sum(quotas.values())
    root = (0, n_shards, np.array([quotas[p] for p in pools], dtype=np.int64))
    top = split_nodes([root], total, n_shards, seed, FRONTIER)
    nodes = spark.createDataFrame([(lo, hi, q.tolist()) for lo, hi, q in top], "lo int, hi int, q array<bigint>")

    def leaves(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for lo, hi, q in zip(p["lo"], p["hi"], p["q"]):
                for shard, _, own in split_nodes([(int(lo), int(hi), np.asarray(q, dtype=np.int64))], total, n_shards, seed):
                    at = np.flatnonzero(own)
                    yield pd.DataFrame({"pool": np.array(pools, dtype=np.int32)[at], "shard": np.full(len(at), shard, dtype=np.int32), "drawn": own[at]})

    return materialize(nodes.repartition(F.col("lo")).mapInPandas(leaves, "pool int, shard int, drawn bigint"), "tree")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _rank(doc_id: str, digest: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, digest)


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = SEED, tree_seed: int | None = None) -> DataFrame:
    """One row per distinct (doc_id, source, text digest) of docs:
    doc_id, source, digest (of the text), size, copies (equal rows), source_size,
    target, epochs (whole takes), extra (how many of the copies are taken once more)
    and placements, an array of (epoch, shard); also its block: sk, block, bits (2**bits
    blocks a source) and partial (whether the mix takes only some of the block's rows once
    more). The tree's draws depend on tree_seed."""
    text = text_or_empty()
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"))
    base = base.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("copies"))
    # A null source gets a key of its own, so that joins are plain equi-joins.
    base = base.withColumn("sk", _source_key(F.col("source")))
    base = materialize(base.withColumn("rank", _rank("doc_id", "digest", seed)), "mix")
    total = base.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    bits = max(BLOCK_BITS, math.ceil(math.log2(max(1, total / BLOCK_WORDS))))
    base = base.withColumn("block", F.shiftrightunsigned("rank", 64 - bits))
    blocks = materialize(base.groupBy("sk", "source", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("words")), "blocks")
    quota = source_quotas(blocks.groupBy("sk", "source").agg(F.sum("words").alias("s")), weights, seed)

    order = Window.partitionBy("sk").orderBy(F.xxhash64("sk", "block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, 0)
    parts = blocks.join(quota, "sk").withColumn("need", F.col("rest") - (F.sum("words").over(order) - F.col("words")))
    parts = materialize(parts.withColumn("drawn", F.col("epochs") + (F.col("need") > 0).cast("int")), "parts")

    quotas = {r.pool: r.q for r in parts.groupBy("pool").agg(F.sum("drawn").alias("q")).collect()}  # POOLS rows at most
    n_shards = max(MIN_SHARDS, math.ceil(total / SHARD_WORDS))
    tree = split_quotas(docs.sparkSession, quotas, n_shards, seed if tree_seed is None else tree_seed)
    ends = F.sum("drawn").over(Window.partitionBy("pool").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    room = tree.withColumn("end", ends).select("pool", "shard", F.explode(F.expr("sequence(`end` - drawn, `end` - 1)")).alias("draw"))
    draws = parts.where("drawn > 0").select("pool", "sk", "block", F.explode(F.expr("sequence(0, drawn - 1)")).alias("epoch"))
    number = Window.partitionBy("pool").orderBy(F.xxhash64("sk", "block", "epoch", F.lit(seed + 1)), "block", "epoch", "sk")
    draws = draws.withColumn("draw", (F.row_number().over(number) - 1).cast("bigint")).join(room, ["pool", "draw"])
    placed = draws.groupBy("sk", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("placements"))
    parts = materialize(parts.join(placed, ["sk", "block"], "left").select("sk", "block", "words", "need", "source_size", "target", "epochs", "placements"), "placed")

    out = base.join(parts.hint("shuffle_hash"), ["sk", "block"])  # alike at every size: blocks grow with the input
    inside = Window.partitionBy("sk", "block").orderBy("rank", "doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = out.where("need > 0 and need < words").withColumn("left", F.col("need") - (F.sum(F.col("size") * F.col("copies")).over(inside) - F.col("size") * F.col("copies")))
    cut = cut.withColumn("extra", F.expr("if(size = 0, 0L, greatest(0L, least(copies, bigint(floor(left / size + 0.5)))))")).drop("left")
    full = out.where("not (need > 0 and need < words)").withColumn("extra", F.expr("if(need > 0, copies, 0L)"))
    partial = F.expr("need > 0 and need < words").alias("partial")
    return full.unionByName(cut).select("doc_id", "source", "digest", "size", "copies", "source_size", "target", "epochs", "extra", "placements", "sk", "block", F.lit(bits).alias("bits"), partial)


def taken_by_row(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document row: its words, the words that the mix takes of it, n_takes,
    and places, its takes as shard:slot in order. A take is a placement of the row's block
    by the tree; slots number a shard's rows in the order of its local shuffle."""
    rows = expand(plan, "copies").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("takes", F.expr("filter(placements, p -> p.epoch < epochs or p.epoch = epochs and `copy` < extra)")).drop("placements", "copies"), "takes")
    each = rows.where("size(takes) > 0").select("row", "doc_id", "digest", "copy", F.inline("takes"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "digest", "epoch", "copy"), "row", "epoch")
    each = each.select("row", "shard", (F.row_number().over(local) - 1).alias("slot"))
    places = each.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "slot"))), lambda p: F.concat_ws(":", p["shard"].cast("string"), p["slot"].cast("string"))), ",").alias("places"), F.count(F.lit(1)).cast("int").alias("n_takes"))
    times = F.coalesce("n_takes", F.lit(0))
    return rows.join(places, "row", "left").select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("n_takes"), F.coalesce("places", F.lit("")).alias("places"))


def mixed_rows(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' columns, every document as often as it is taken, dealt
    to output shards and shuffled inside each. plan is plan_mix's of docs and seed. A row
    finds its block by its own hash; only rows of the blocks that are taken in part, one
    a source, are looked up one by one. Texts are shuffled once, to their shards."""
    names = docs.columns
    plan = materialize(plan.where("size(placements) > 0"), "plan")
    some = plan.select("bits").first()
    if some is None:
        return docs.limit(0)
    blocks = materialize(plan.groupBy("sk", "block").agg(F.first("partial").alias("partial"), F.first("placements").alias("placements")), "blocks")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").alias("k_id"), _source_key(F.col("source").cast("string")).alias("sk"), F.xxhash64(text_or_empty()).alias("k_digest"))
    keyed = keyed.withColumn("block", F.shiftrightunsigned(_rank("k_id", "k_digest", seed), 64 - some.bits))
    columns = ["row", "k_id", "k_digest", "times", "at"]
    whole = keyed.join(sized(blocks.where("not partial").drop("partial")), ["sk", "block"]).withColumn("times", F.lit(1).cast("bigint")).withColumn("at", F.explode("placements")).select(*columns)

    part = plan.where("partial").select(F.col("sk").alias("p_sk"), F.col("doc_id").alias("p_id"), F.col("digest").alias("p_digest"), "copies", "epochs", "extra", "placements")
    part = materialize(part.where("epochs > 0 or extra > 0"), "partial")
    found = keyed.join(sized(part), keyed.k_id.eqNullSafe(part.p_id) & (keyed.sk == part.p_sk) & (keyed.k_digest == part.p_digest))
    # Equal rows are taken by number, from one of them.
    one = found.where("copies = 1").select("row", "k_id", "k_digest", "copies", "epochs", "extra", "placements")
    many = found.where("copies > 1").groupBy("sk", "k_id", "k_digest").agg(*(F.first(c).alias(c) for c in ("row", "copies", "epochs", "extra", "placements")))
    taken = one.unionByName(many.select(*one.columns)).withColumn("at", F.explode("placements"))
    taken = taken.withColumn("times", F.when(F.col("at.epoch") < F.col("epochs"), F.col("copies")).otherwise(F.col("extra"))).where("times > 0").select(*columns)
    draws = expand(taken, "times").unionByName(whole.withColumn("copy", F.lit(0).cast("bigint"))).withColumn("shard", F.col("at.shard"))
    draws = draws.repartition(F.col("shard")).sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "k_id", "k_digest", "at.epoch", "copy"))
    return draws.select(*(F.col(f"row.`{c}`").alias(c) for c in names))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken_by_row(plan_mix(docs))
