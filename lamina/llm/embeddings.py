"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own (k-means on at
most SAMPLE vectors, those with the smallest hash), and pairs of codewords are the
cells of a product grid. Every vector lives in its nearest cell and visits its nearest
cells in the order of a multi-sequence traversal (computed at once from the ranks that
its first cells can have). The number of cells visited is one for all vectors: the
smallest with which, in a calibration on the sample, pairs exactly at the threshold
(each vector and a copy turned by the threshold's angle in a random direction) find
each other from either side with TARGET_RECALL; closer pairs are found more often.
Residents and visitors of a cell are then compared in double precision.

Equal vectors are one class with a number of copies. Cells are worked on in blocks of
residents by blocks of visitors; what leaves a block is one row per linked vector. In a
cell of many residents, those within half the threshold's angle of a common direction
(any will do) are all linked with each other, by the triangle inequality of angles: they
are counted, not compared, so that m close copies cost m rows. The index
holds every vector; only the codebooks come from the sample, and they are what is
broadcast (at most 2 * MAX_CODES vectors).

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link; equal rows are
separate vectors that link; a null vec_id is not taken as a component's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship_package, sized
from .pairs import LINKED, by_unit, components, linked

THRESHOLD = 0.9
TARGET_RECALL = 0.98
SAMPLE = 10_000
CALIBRATION = 1000
PER_CELL = 200
MAX_CODES = 1024
RESIDENTS, VISITORS = 128, 512
#: Residents that a cell's common direction is the mean of, on average.
CENTRE = 64


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflows nor vanishes when squared
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1)[None, :] - 2 * x @ c.T


def padded(x: np.ndarray, size: int) -> np.ndarray:
    return x[:, :size] if x.shape[1] >= size else np.pad(x, ((0, 0), (0, size - x.shape[1])))


def nearest_cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """Each row's ``visits`` nearest cells, nearest first. A cell of rank r has both of
    its codewords among the r nearest of their halves, so only those with a product of
    ranks of at most ``visits`` can be in the traversal's first ``visits``."""
    half = books[0].shape[1]
    x = padded(x, 2 * half)
    d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    k = len(books[0])
    visits = min(visits, k * k)
    near1, near2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    i, j = np.meshgrid(np.arange(min(k, visits)), np.arange(min(k, visits)), indexing="ij")
    ok = (i + 1) * (j + 1) <= visits
    i, j = i[ok], j[ok]
    rows = np.arange(len(x))[:, None]
    sums = d1[rows, near1[:, i]] + d2[rows, near2[:, j]]
    cells = near1[:, i] * k + near2[:, j]
    order = np.lexsort((cells, sums), axis=1)[:, :visits]
    return cells[rows, order].astype(np.int32)


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL, seed: int = 9) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """(codebooks, number of cells to visit) for n vectors, from unit vectors of the sample."""
    rng = np.random.default_rng(seed)
    half = max(1, sample.shape[1] // 2)
    sample = padded(sample, 2 * half)
    k = int(min(MAX_CODES, len(sample), 1 << max(0, round(np.log2(max(1.0, n / PER_CELL)) / 2))))
    books = kmeans(sample[:, :half], k, rng), kmeans(sample[:, half:], k, rng)
    q = sample[rng.choice(len(sample), min(CALIBRATION, len(sample)), replace=False)]
    z = rng.standard_normal(q.shape)
    z -= (z * q).sum(axis=1, keepdims=True) * q
    turned = threshold * q + np.sqrt(1 - threshold**2) * z / np.maximum(1e-12, np.sqrt((z * z).sum(axis=1, keepdims=True)))
    most = min(k * k, 256)
    while True:
        a, b = nearest_cells(q, books, most), nearest_cells(turned, books, most)
        ranks = []
        for own, other in ((a, b), (b, a)):
            hit = own == other[:, :1]
            ranks.append(np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, most + 1))
        need = int(np.quantile(np.minimum(*ranks), target, method="higher"))
        if need <= most or most == k * k:
            return books, min(need, k * k)
        most = min(k * k, 4 * most)


def _vectors(f: pd.DataFrame, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(f["vec"]), dtype=kind).reshape(len(f), -1).astype(np.float64))


def _unit_links(threshold: float, kind: str):
    def work(g: pd.DataFrame) -> pd.DataFrame | None:
        resident = g["resident"].to_numpy()
        out = []
        width = g["vec"].map(len).to_numpy()
        for w in np.unique(width):
            own = g[(width == w) & resident]
            other = g[(width == w) & ~resident]
            if not len(own) or not len(other):
                continue
            i, j = np.nonzero(_vectors(own, kind) @ _vectors(other, kind).T >= threshold)
            a, b = own["node"].to_numpy(), other["node"].to_numpy()
            keep = a[i] != b[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            # A resident counts its visitors; a visitor counts a resident only if that
            # one doesn't come to the visitor's own cell, where it would be counted.
            visits = np.array([np.frombuffer(x, dtype=np.int32) for x in own["cells"]])
            home = np.frombuffer(b"".join(x[:4] for x in other["cells"]), dtype=np.int32)
            alone = ~(visits[i] == home[j][:, None]).any(axis=1)
            nodes = np.concatenate([a, b])
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, i, other["copies"].to_numpy()[j])
            np.add.at(links, len(a) + j[alone], own["copies"].to_numpy()[i[alone]])
            # a node can be here twice, as a resident and as a visitor
            keys, at = np.unique(nodes, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, links)
            out.append(linked(keys, at[i], at[len(a) + j], total))
        return pd.concat(out) if out else None

    return work


def _direction(kind: str):
    """The mean of some residents' directions (of the commonest length)."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        width = g["vec"].map(len)
        mean = _vectors(g[width == width.mode()[0]], kind).mean(axis=0)
        return pd.DataFrame({"cell": g["cell"].iloc[:1], "centre": [mean.tobytes()]})

    return work


def _near_centre(parts: Iterator[pd.DataFrame], threshold: float, kind: str) -> Iterator[pd.DataFrame]:
    """(cell, node, copies) of the residents within half the threshold's angle."""
    half = np.sqrt((1 + threshold) / 2) + 1e-9
    for p in parts:
        keep = []
        for v, c in zip(p["vec"], p["centre"]):
            x, m = np.frombuffer(v, dtype=kind).astype(np.float64), np.frombuffer(c, dtype=np.float64)
            keep.append(len(x) == len(m) and bool(m.any()) and float(unit(x[None, :])[0] @ unit(m[None, :])[0]) >= half)
        yield p[["cell", "node", "copies"]][np.array(keep, dtype=bool)]


def cell_links(placed: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Links (node, root, links) between residents and visitors of cells, of placed (node,
    copies, vec, cells as bytes, visited), a written table."""
    home = F.col("visited")[0]
    per_cell = placed.groupBy(home.alias("cell")).agg(F.count(F.lit(1)).alias("r")).where(F.col("r") > RESIDENTS)
    large = materialize(per_cell, "large")
    near = None
    if large.isEmpty():
        marked = placed.withColumn("core", F.lit(False))
    else:
        inside = placed.select(home.alias("cell"), "node", "copies", "vec").join(sized(large), "cell")
        some = inside.where(f"pmod(xxhash64(node, 11), r) < {CENTRE}").select("cell", "vec")
        centres = materialize(by_unit(some, ["cell"], _direction(kind), "cell int, centre binary"), "centres")
        cores = materialize(inside.join(sized(centres), "cell").select("cell", "node", "copies", "vec", "centre").mapInPandas(lambda p: _near_centre(p, threshold, kind), "cell int, node bigint, copies bigint"), "cores")
        whole = materialize(cores.groupBy("cell").agg(F.min("node").alias("root"), F.sum("copies").alias("in_core")), "whole")
        near = cores.join(sized(whole), "cell").select("node", "root", (F.col("in_core") - F.col("copies")).alias("links"))
        marked = placed.join(sized(cores.select("node", F.lit(True).alias("is_core"))), "node", "left").withColumn("core", F.coalesce("is_core", F.lit(False))).drop("is_core")

    # Part 0 of a cell: all residents, and the visitors that aren't of its own core; part 1: the other
    # residents, and the visitors of its core. Core meets core in neither.
    residents = marked.select("node", "copies", "vec", "cells", home.alias("cell"), F.explode(F.when(F.col("core"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("part"))
    visitors = marked.select("node", "copies", "vec", F.expr("substring(cells, 1, 4)").alias("cells"), "core", home.alias("home"), F.explode("visited").alias("cell"))
    visitors = visitors.withColumn("part", (F.col("core") & (F.col("cell") == F.col("home"))).cast("int")).drop("core", "home")
    keys = ["cell", "part"]
    counts = residents.groupBy(*keys).agg(F.count(F.lit(1)).alias("r")).join(visitors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    counts = counts.select(*keys, F.expr(f"int(ceil(r / {RESIDENTS}))").alias("nr"), F.expr(f"int(ceil(n / {VISITORS}))").alias("nv"))
    counts = sized(materialize(counts, "cells"))
    deal = lambda df, own, other, flag: df.join(counts, keys).select(
        *keys, F.expr(f"int(pmod(xxhash64(node, 3), {own}))").alias("mine"), F.explode(F.expr(f"sequence(0, {other} - 1)")).alias("theirs"), "node", "copies", "vec", "cells", F.lit(flag).alias("resident"))
    rest = ["node", "copies", "vec", "cells", "resident"]
    both = deal(residents, "nr", "nv", True).select(*keys, F.col("mine").alias("br"), F.col("theirs").alias("bv"), *rest)
    both = both.unionByName(deal(visitors, "nv", "nr", False).select(*keys, F.col("theirs").alias("br"), F.col("mine").alias("bv"), *rest))
    out = by_unit(both, [*keys, "br", "bv"], _unit_links(threshold, kind), LINKED)
    return out if near is None else out.unionByName(near)


def cosine_links(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links (others linked directly), component_id
    (smallest vec_id reachable) and kept."""
    spark = vectors.sparkSession
    ship_package(spark)
    single = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    kind = "<f4" if single else "<f8"  # floats are exact in either
    e = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.exists(e, lambda x: x != 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select("vec_id", F.when(good, e).alias("v"))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    first = classes.select(F.col("h1").alias("a"), F.col("h2").alias("b"), F.col("low").alias("i"), "node", "copies")
    live = rows.where("v is not null").join(sized(first), F.col("vec_id").eqNullSafe(F.col("i")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))).select("node", "copies", "h1", "h2", "v")
    if not classes.where("copies > 1").isEmpty():
        live = live.dropDuplicates(["node"])  # rows that repeat the smallest id and its vector

    n = classes.count()
    drawn = classes.select("node").orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(SAMPLE)
    picked = [np.asarray(r.v) for r in live.join(F.broadcast(drawn), "node").orderBy("h1", "h2").select("v").collect()]
    if picked:
        widths = np.bincount([len(x) for x in picked])
        books, visits = fit(unit(np.stack([x for x in picked if len(x) == widths.argmax()])), n, threshold, target)
    else:
        books, visits = (np.zeros((1, 1)), np.zeros((1, 1))), 1
    shared = spark.sparkContext.broadcast((books, visits))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, count = shared.value
        size = 2 * codes[0].shape[1]
        for p in parts:
            for at in range(0, len(p), 1000):
                q = p.iloc[at : at + 1000]
                x = [np.asarray(v, dtype=np.float64) for v in q["v"]]
                rows = unit(np.concatenate([padded(unit(v[None, :]), size) for v in x]) + 1e-300)
                cells = nearest_cells(rows, codes, count)
                yield pd.DataFrame({"node": q["node"].to_numpy(), "copies": q["copies"].to_numpy(), "vec": [v.astype(kind).tobytes() for v in x], "cells": [c.tobytes() for c in cells], "visited": list(cells)})

    placed = materialize(live.select("node", "copies", "v").mapInPandas(place, "node bigint, copies bigint, vec binary, cells binary, visited array<int>"), "placed")
    links = materialize(cell_links(placed, threshold, kind), "links")

    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    low = groups.join(classes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least"))
    low = sized(materialize(low, "low"))
    out = classes.join(degree, "node", "left").join(groups.join(low, "component").drop("component"), "node", "left")
    out = materialize(out.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("links"), F.coalesce("least", "low").alias("least")), "nodes")
    each = rows.select("vec_id", "h1", "h2", F.col("v").isNotNull().alias("valid")).join(out.withColumn("found", F.lit(True)), ["h1", "h2"], "left")
    each = each.select("vec_id", F.when(F.col("valid"), F.col("links")).otherwise(0).cast("bigint").alias("n_links"), F.when(F.col("valid"), F.col("least")).otherwise(F.col("vec_id")).alias("component_id"))
    return each.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    return cosine_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP9_SQL = """
with recursive e as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id a, b.vec_id b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
c as (select a vec_id, least(a, min(b)) c from reach group by a),
n as (select a vec_id, count(*) n from link group by a)
select vec_id, cast(coalesce(n.n, 0) as bigint) n_links, coalesce(c.c, vec_id) component_id, coalesce(c.c, vec_id) = vec_id kept
from embeddings left join n using (vec_id) left join c using (vec_id)
"""
