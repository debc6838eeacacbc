"""Pairs inside groups without emitting them: units, spanning edges, components.

A unit is a bounded number of members of a group, so that a hot group is spread over
many tasks and none of them, nor the driver, holds it whole. A unit compares its members
in numpy and returns one row per linked member: its number of links there, and the root
of a spanning tree. Pairs themselves never leave a unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, materialize, sized

LINKED = "node bigint, root bigint, links bigint"


def by_unit(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str = LINKED) -> DataFrame:
    """Apply work to each group of keys. Groups are streamed from sorted partitions:
    memory is bounded by a unit and an Arrow batch, and small groups cost little."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            k = part[keys].to_numpy()
            starts = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1
            if held and (held[-1][keys].to_numpy()[-1] == k[0]).all():
                cuts = [0, *starts.tolist()]
            else:
                if held:
                    yield from done(pd.concat(held) if len(held) > 1 else held[0])
                held, cuts = [], [0, *starts.tolist()]
            out = []
            for a, b in zip(cuts, [*cuts[1:], None]):
                piece = part.iloc[a:b]
                if b is None:
                    held.append(piece)
                else:
                    whole = pd.concat([*held, piece]) if held else piece
                    held = []
                    out += done(whole)
            if out:
                yield pd.concat(out)
        if held:
            yield from done(pd.concat(held) if len(held) > 1 else held[0])

    def done(group: pd.DataFrame) -> list[pd.DataFrame]:
        got = work(group)
        return [] if got is None or not len(got) else [got]

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given: small in bytes, but not in work
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def linked(nodes: np.ndarray, i: np.ndarray, j: np.ndarray, links: np.ndarray) -> pd.DataFrame | None:
    """LINKED rows of a unit: pairs (i, j) are positions in nodes, links is per position."""
    if not len(i):
        return None
    label = nodes.astype(np.int64).copy()
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    used = np.unique(np.concatenate([i, j]))
    return pd.DataFrame({"node": nodes[used].astype(np.int64), "root": label[used], "links": links[used].astype(np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for every node
    with an edge to another. Each round points every node to its least neighbour, follows
    pointers eightfold, and contracts the edges; a hub's edges are combined before
    shuffles, and each round is three written tables, counted as they are written."""
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e, left = counted(edges.where("a <> b").select(*pair("a", "b")).distinct(), "edges")
    rounds: list[tuple[DataFrame, int]] = []
    while left:
        both = e.select(F.col("a").alias("node"), "b").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("b")))
        p, n = counted(both.groupBy("node").agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "pointers")
        small = sized(p, rows=n)
        jumped = p
        for _ in range(3):
            step = small.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = jumped.join(step, "to").select("node", F.col("next").alias("to"))
        p = materialize(jumped, "pointers")
        rounds.append((p, n))
        small = sized(p, rows=n)
        e = e.join(small.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(small.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        e, left = counted(e.select(*pair("x", "y")).where("a <> b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = rounds[0][0]
    for p, n in rounds[1:]:
        step = sized(p, rows=n).select(F.col("node").alias("to"), F.col("to").alias("next"))
        out = out.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    return materialize(out.select("node", F.col("to").alias("component")), "components")
