"""N-gram Jaccard join by a MinHash LSH forest.

Documents are sets of five-word shingles. Those with equal sets are one class, so
copies of any number are one member from then on. A class's signature is one path of
DEPTH MinHash digits for each tree of the forest. Each tree is a prefix trie, held as
its sorted paths: the matched prefix of two neighbours in that order is the trie node
that both are under, so one range sort gives the nodes of all levels, and a hot node
is spread over as many tasks as it needs. Every path is linked to the first one of the
longest node that it shares, which is one row a path and no pair of members.

The join starts with whole paths and shortens the matched prefix level by level until
a pair as similar as the least similar link of the forest meets with the target
probability. Every link is compared, so many close copies can't hide a few looser ones.
The level at which even pairs exactly at the threshold meet with the target probability
ends the search; one link of ends that aren't similar leads there, because paths that
are similar may be linked by way of it only.

Classes that are reachable over links of that level are a cluster, and all its pairs
are verified on whole shingle sets. A cluster is cut into blocks by the bytes of its
members. Most clusters are one block. In the others, members within half the
threshold's distance of a common centre (a set; any will do) are all linked with each
other by the triangle inequality of the Jaccard distance, and are counted, not
compared; only the others meet all blocks. So a group of m close copies costs m rows.
Only members that are far from the centre, but still in the cluster, are compared pair
by pair, dealt over all tasks.

Defined results: words are lower-cased runs of letters and digits; a text of one to
four words is one shingle; a text without words (null, empty) links with nothing;
rows that are equal are copies and count as links of each other; a null doc_id keeps
a null class unless another of its group has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import counted, materialize, ship_package, sized, text_or_empty
from .pairs import by_unit, components, linked
from .tokens import mix, shingles

THRESHOLD = 0.8
TARGET_RECALL = 0.998
DEPTH, SHORTEST = 8, 4
TREES = 16
#: Signatures of a pair at the threshold agree in fewer values than agree_bound with at most this probability.
UNVERIFIED = 1.1e-6
CHUNK = 4096
#: A cluster is cut into at most PARTS blocks of BLOCK_BYTES of signatures and sets, or
#: more: larger ones up to LARGE_BLOCK_BYTES, so that members of a huge one travel less often.
BLOCK_BYTES, LARGE_BLOCK_BYTES, PARTS = 1 << 18, 1 << 22, 16
#: What a member counts for beside its sets, so that blocks of very short texts are small too.
MEMBER_BYTES = 1024
#: Members that a cluster's centre is the majority of, on average.
CENTRE = 64

_DIGIT = 16  # bits; a path is two longs of four digits each


def trees_for(threshold: float, target: float = TARGET_RECALL) -> int:
    """Trees with which pairs at the threshold meet at level SHORTEST with the target
    probability; TREES at least."""
    return max(TREES, math.ceil(math.log(1 - target) / math.log(1 - min(threshold, 0.999) ** SHORTEST)))


def meeting(similarity: float, level: int, trees: int) -> float:
    """The probability that a pair shares ``level`` digits in some tree."""
    return 1 - (1 - similarity**level) ** trees


def agree_bound(threshold: float, values: int) -> int:
    """The number of values in which a pair's signatures must agree for the pair to be
    verified, by the binomial tail at the threshold."""
    below, k = 0.0, 0
    while k < values:
        below += math.comb(values, k) * threshold**k * (1 - threshold) ** (values - k)
        if below > UNVERIFIED:
            break
        k += 1
    return k


def hashes(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_606)
    return (rng.integers(0, 1 << 31, values, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 1 << 32, values, dtype=np.uint32)


def signature(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The MinHash digits of a set of shingles."""
    mul, add = family
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK]
        np.minimum(out, (part[None, :] * mul[:, None] + add[:, None]).min(axis=1), out=out)
    return (mix(out.astype(np.uint64)) >> np.uint64(64 - _DIGIT)).astype(np.uint16)


def paths(digits: np.ndarray) -> np.ndarray:
    """The two longs of each tree's path, most significant digit first."""
    four = digits.reshape(-1, 2, 4).astype(np.uint64)
    out = np.zeros(four.shape[:2], dtype=np.uint64)
    for d in range(4):
        out = (out << np.uint64(_DIGIT)) | four[:, :, d]
    return out.view(np.int64)


def _sign(parts: Iterator[pd.DataFrame], trees: int) -> Iterator[pd.DataFrame]:
    family = hashes(trees * DEPTH)
    for p in parts:
        rows = []
        for doc_id, digest, text in zip(p["doc_id"], p["digest"], p["text"]):
            s = shingles(text)
            if len(s):
                f1, f2 = mix(s).sum(dtype=np.uint64), mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)).sum(dtype=np.uint64)
                rows.append((doc_id, digest, len(s), int(f1.view(np.int64)), int(f2.view(np.int64)), signature(s, family).tobytes()))
            else:
                rows.append((doc_id, digest, 0, 0, 0, b""))
        yield pd.DataFrame(rows, columns=["doc_id", "digest", "n", "f1", "f2", "sig"])


def _spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each path of a signature."""
    for p in parts:
        if len(p):
            every = [paths(np.frombuffer(s, dtype=np.uint16)) for s in p["sig"]]
            trees = len(every[0])
            both = np.concatenate(every)
            yield pd.DataFrame({"tree": np.tile(np.arange(trees, dtype=np.int16), len(p)), "hi": both[:, 0], "lo": both[:, 1], "node": np.repeat(p["node"].to_numpy(), trees)})


def matched(hi: np.ndarray, lo: np.ndarray, hi2: np.ndarray, lo2: np.ndarray) -> np.ndarray:
    """Digits that two arrays of paths have in common from the start."""
    x, y = (hi ^ hi2).view(np.uint64), (lo ^ lo2).view(np.uint64)
    out = np.zeros(len(x), dtype=np.int64)
    for d in range(1, 5):
        cut = np.uint64(64 - _DIGIT * d)
        out += (x >> cut) == 0
        out += (x == 0) & ((y >> cut) == 0)
    return out


EDGE = "a bigint, b bigint, level int, part int, tree smallint, hi bigint, lo bigint"


def _trie(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted paths of a range: a link (a, b, level) of each path to the first one of the
    longest node that it shares with its neighbour, if that has SHORTEST digits. The
    range's first and last path come with the range's number, a and b alike."""
    part = TaskContext.get().partitionId()
    before = None  # the last path of the batch before, and the first nodes of its open trie nodes by level
    ends = lambda p, i: pd.DataFrame({"a": p["node"].iloc[[i]], "b": p["node"].iloc[[i]], "level": -1, "part": part, "tree": p["tree"].iloc[[i]], "hi": p["hi"].iloc[[i]], "lo": p["lo"].iloc[[i]]})
    last = None
    for p in parts:
        if not len(p):
            continue
        if last is None:
            yield ends(p, 0)
        last = ends(p, -1)
        tree, hi, lo, node = (p[c].to_numpy() for c in ("tree", "hi", "lo", "node"))
        if before is not None:
            tree, hi, lo, node = (np.concatenate([[x], y]) for x, y in zip(before[0], (tree, hi, lo, node)))
        level = np.zeros(len(node), dtype=np.int64)
        level[1:] = np.where(tree[1:] == tree[:-1], matched(hi[1:], lo[1:], hi[:-1], lo[:-1]), 0)
        at, own, open_ = np.arange(len(node)), node.copy(), []
        for d in range(DEPTH + 1):
            start = np.maximum.accumulate(np.where(level < d, at, 0))
            first = node[start]
            if before is not None:  # nodes that go on from the batch before
                first = np.where(start == 0, before[1][d], first)
            own = np.where(level == d, first, own)
            open_.append(first[-1])
        link = np.flatnonzero(level >= SHORTEST)
        link = link[link > 0]
        yield pd.DataFrame({"a": own[link], "b": node[link], "level": level[link], "part": -1, "tree": tree[link], "hi": 0, "lo": 0})
        before = ((tree[-1], hi[-1], lo[-1], node[-1]), open_)
    if last is not None:
        yield last


def _join_ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        level = np.where(p["tree"] == p["tree2"], matched(*(p[c].to_numpy() for c in ("hi", "lo", "hi2", "lo2"))), 0)
        yield pd.DataFrame({"a": p["a"], "b": p["b"], "level": level})[level >= SHORTEST]


def forest(classes: DataFrame) -> DataFrame:
    """Links (a, b, level) of the forest over classes (node, sig), as a written table:
    nodes are under one trie node of ``level`` digits in some tree just if they are
    connected by links of that level or longer ones."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = classes.select("node", "sig").mapInPandas(_spread, "tree smallint, hi bigint, lo bigint, node bigint")
    order = ["tree", "hi", "lo", "node"]
    found = materialize(every.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_trie, EDGE), "trie")
    # One or two rows for each range: the last path of a range and the first of the next that has one.
    ends = found.where("part >= 0").distinct()
    w = Window.orderBy("part", *(c for c in ("tree", "hi", "lo", "a")))
    ends = ends.select("b", "tree", "hi", "lo", *(F.lag(c).over(w).alias(d) for c, d in (("a", "a"), ("tree", "tree2"), ("hi", "hi2"), ("lo", "lo2")))).where("a is not null and a <> b")
    links = found.where("part < 0").select("a", "b", "level").unionByName(ends.mapInPandas(_join_ends, "a bigint, b bigint, level int"))
    return materialize(links.where("a <> b").groupBy("a", "b").agg(F.max("level").alias("level")), "forest")


def choose_level(links: DataFrame, classes: DataFrame, threshold: float, trees: int, target: float = TARGET_RECALL) -> int:
    """The longest prefix with which pairs like the least similar of all links meet with
    the target probability; pairs at the threshold count where a link is below it."""
    reaches = lambda similarity, least: max([k for k in range(least, DEPTH + 1) if meeting(similarity, k, trees) >= target], default=least)
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    both = classes.select("node", "sig").join(sized(ends), "node").groupBy("a", "b").agg(F.min("sig").alias("s"), F.max("sig").alias("s2"))

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(len(p), -1) for c in ("s", "s2"))
                yield pd.DataFrame({"same": [int((x == y).sum(axis=1).min())]})

    same = both.select("s", "s2").mapInPandas(compare, "same int").agg(F.min("same")).first()[0]
    return reaches(threshold if same is None else max(threshold, same / (trees * DEPTH)), reaches(threshold, SHORTEST))


def _blocks(size: str) -> str:
    """SQL for the number of blocks for ``size`` bytes."""
    return f"int(greatest(1, ceil({size} / greatest({BLOCK_BYTES}, least({LARGE_BLOCK_BYTES}, {size} / {PARTS})))))"


def _agreeing(left: np.ndarray, right: np.ndarray, agree: int) -> np.ndarray:
    """Which signatures (rows) of left and right agree in ``agree`` values or more."""
    same = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(left.shape[1]):
        same += left[:, k][:, None] == right[:, k][None, :]
    return same >= agree


def similar(g: pd.DataFrame, left: np.ndarray, right: np.ndarray, want, threshold: float, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions in g, i in left and j in right, that ``want(i, j)`` asks
    for and whose shingle sets have at least the threshold's similarity."""
    sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint16).reshape(len(g), -1)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]]
    n = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(n)]
    own = lambda i: ids[start[i] : start[i + 1]]
    flag = np.zeros(ids.max(initial=0) + 1, dtype=bool)
    out_i, out_j = [], []
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        for to in range(0, len(right), 1024):
            cols = right[to : to + 1024]
            small, large = np.minimum(n[rows][:, None], n[cols]), np.maximum(n[rows][:, None], n[cols])
            ok = _agreeing(sig[rows], sig[cols], agree) & (small >= threshold * large - 1e-9) & want(rows[:, None], cols[None, :])
            for r in np.flatnonzero(ok.any(axis=1)):
                i, js = rows[r], cols[ok[r]]
                flag[own(i)] = True
                common = np.add.reduceat(flag[np.concatenate([own(j) for j in js])].astype(np.int64), np.r_[0, np.cumsum(n[js])[:-1]])
                flag[own(i)] = False
                js = js[common >= threshold * (n[i] + n[js] - common) - 1e-9]
                out_i.append(np.full(len(js), i))
                out_j.append(js)
    none = np.empty(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _counted(g: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame | None:
    copies = g["copies"].to_numpy()
    links = np.zeros(len(g), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    return linked(g["node"].to_numpy(), i, j, links)


def _whole_cluster(threshold: float, agree: int):
    def work(g: pd.DataFrame) -> pd.DataFrame | None:
        every = np.arange(len(g))
        return _counted(g, *similar(g, every, every, lambda i, j: i < j, threshold, agree))

    return work


def _part_of_cluster(threshold: float, agree: int):
    """Members far from the centre (left) against a block of all members (right). Two far
    ones meet twice, and count where the smaller one is on the left."""

    def work(g: pd.DataFrame) -> pd.DataFrame | None:
        is_left, core, node = (g[c].to_numpy() for c in ("side", "core", "node"))
        want = lambda i, j: (core[j] | (node[i] < node[j])) & (node[i] != node[j])
        i, j = similar(g, np.flatnonzero(is_left), np.flatnonzero(~is_left), want, threshold, agree)
        got = _counted(g, i, j)
        return got if got is None else got.groupby("node", as_index=False).agg({"root": "min", "links": "sum"})

    return work


def _centre(g: pd.DataFrame) -> pd.DataFrame:
    """The shingles that most of some members have."""
    s, n = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in g["shingles"]]), return_counts=True)
    return pd.DataFrame({"component": g["component"].iloc[:1], "centre": [s[2 * n > len(g)].tobytes()]})


def _near_centre(parts: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for p in parts:
        core = []
        for s, c in zip(p["shingles"], p["centre"]):
            if c is None:
                core.append(False)
                continue
            a, b = np.frombuffer(s, dtype=np.uint64), np.frombuffer(c, dtype=np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            # distances d and e of two members with d + e <= 1 - threshold: their similarity reaches it
            core.append(common >= (1 + threshold) / 2 * (len(a) + len(b) - common) + 1e-9)
        yield p.drop(columns="centre").assign(core=core)


MEMBER = "component bigint, blocks int, block int, node bigint, copies bigint, sig binary, shingles binary"


def verified(members: DataFrame, threshold: float, agree: int) -> DataFrame:
    """Links (node, root, links) inside the clusters of members, a written table of MEMBER:
    every linked pair counts for both, and roots span each linked group."""
    schema = "node bigint, root bigint, links bigint"
    out = by_unit(members.where("blocks = 1"), ["component"], _whole_cluster(threshold, agree), schema)
    large = members.where("blocks > 1")
    if large.isEmpty():
        return out
    sizes = large.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.first("blocks").alias("blocks"))
    sizes, n = counted(sizes, "large")
    some = large.join(sized(sizes.select("component", "members"), rows=n), "component").where(f"pmod(xxhash64(node, 11), members) < {CENTRE}")
    centres = by_unit(some.select("component", "shingles"), ["component"], _centre, "component bigint, centre binary")
    centres = materialize(sizes.join(centres, "component").select("component", "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "centres")
    placed = large.join(sized(centres), ["component", "block"], "left").select(*(c.split()[0] for c in MEMBER.split(", ")), "centre")
    placed = materialize(placed.mapInPandas(lambda p: _near_centre(p, threshold), MEMBER + ", core boolean"), "placed")

    far_bytes = F.sum(F.when(~F.col("core"), F.octet_length("shingles") + F.octet_length("sig") + MEMBER_BYTES)).alias("bytes")
    kinds = placed.groupBy("component").agg(F.min(F.when(F.col("core"), F.col("node"))).alias("root"), F.sum(F.when(F.col("core"), F.col("copies"))).alias("in_core"), far_bytes)
    kinds, n = counted(kinds.select("component", "root", "in_core", F.expr(f"if(bytes is null, 0, {_blocks('bytes')})").alias("strips")), "kinds")
    both = placed.join(sized(kinds, rows=n), "component")
    near = both.where("core").select("node", "root", (F.col("in_core") - F.col("copies")).alias("links"))
    both = both.where("strips > 0")
    mine = F.expr("int(pmod(xxhash64(node, 7), strips))")
    columns = ["component", "strip", "block", "node", "copies", "sig", "shingles", "core", "side"]
    left = both.where("not core").withColumn("strip", mine).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(True))
    right = both.withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).withColumn("side", F.lit(False))
    rest = by_unit(left.select(*columns).unionByName(right.select(*columns)), ["component", "strip", "block"], _part_of_cluster(threshold, agree), schema)
    return out.unionByName(near).unionByName(rest)


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, digest (of the text), n_shingles, n_links
    (other rows whose sets have at least the threshold's similarity), class_id (the
    smallest doc_id reachable over links) and group_id (a number of the group that is
    reachable, null for rows without words)."""
    ship_package(docs.sparkSession)
    trees = trees_for(threshold)
    agree = agree_bound(threshold, trees * DEPTH)
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    signed = texts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(lambda p: _sign(p, trees), "doc_id string, digest bigint, n bigint, f1 bigint, f2 bigint, sig binary")
    signed = materialize(signed.withColumn("doc_id", F.col("doc_id").cast("bigint")), "signed")

    classes = signed.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    links = forest(classes)
    level = choose_level(links, classes, threshold, trees)
    clusters = components(links.where(F.col("level") >= level).select("a", "b"))

    inside = clusters.join(classes.select("node", "copies", "rep", "n", "sig"), "node")
    blocks = inside.groupBy("component").agg(F.sum(8 * F.col("n") + F.octet_length("sig") + MEMBER_BYTES).alias("bytes")).select("component", F.expr(_blocks("bytes")).alias("blocks"))
    blocks, n = counted(blocks, "blocks")
    inside = inside.join(sized(blocks, rows=n), "component").withColumn("block", F.expr("int(pmod(xxhash64(node, 5), blocks))"))
    inside, n = counted(inside, "clustered")

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"node": p["node"], "shingles": [shingles(t).tobytes() for t in p["text"]]})

    keys = inside.select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.digest").alias("r_digest"))
    of = texts.join(sized(keys, rows=n), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")))
    whole, found = counted(of.select("node", "text").mapInPandas(sets, "node bigint, shingles binary"), "sets")
    if found > n:  # equal rows stand for one class
        whole = whole.dropDuplicates(["node"])
    members = materialize(inside.drop("rep", "n").join(whole, "node").select(*(c.split()[0] for c in MEMBER.split(", "))), "members")
    links = materialize(verified(members, threshold, agree), "links")

    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    low = groups.join(classes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("class_low"))
    low, n = counted(low, "low")
    low = sized(low, rows=n)  # one row a group; members stay where they are
    nodes = classes.select("node", "f1", "f2", "copies", "low").join(degree, "node", "left").join(groups.join(low, "component"), "node", "left")
    nodes = nodes.select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("class_low", "low").alias("class_id"), F.coalesce("component", "node").alias("group_id"))
    nodes = materialize(nodes, "nodes")
    rows = signed.select("doc_id", "digest", F.col("n").alias("n_shingles"), "f1", "f2")
    rows = rows.join(nodes.withColumn("found", F.lit(True)), ["f1", "f2"], "left")
    with_words = F.col("n_shingles") > 0
    return rows.select(
        "doc_id", "digest", "n_shingles",
        F.when(with_words, F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"),
        F.when(with_words, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(with_words, F.col("group_id")).alias("group_id"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id (nulls last), then
    digest. Rows without words are in no group and stay. The rows to drop are fewer than
    those to keep, so the texts are joined to them."""
    links = materialize(jaccard_links(docs, threshold).where("group_id is not null").select("doc_id", "digest", "group_id"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    keepers = links.groupBy("group_id").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id", "first.doc_id", "first.digest")
    keepers, n = counted(keepers.select("group_id", F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest")), "keepers")
    lost = links.join(sized(keepers, rows=n), "group_id").where("not (doc_id <=> k_id and digest = k_digest)")
    lost, n = counted(lost.select(F.col("doc_id").alias("l_id"), F.col("digest").alias("l_digest")).distinct(), "lost")
    again, m = counted(links.groupBy(F.col("doc_id").alias("l_id"), F.col("digest").alias("l_digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    return without(without(docs, lost, n), again, m, once=True)


def without(docs: DataFrame, keys: DataFrame, n: int, once: bool = False) -> DataFrame:
    """docs without the rows whose (doc_id, digest of the text) is among keys (a written
    table of n rows with columns l_id, l_digest); if ``once``, with one row for each of them."""
    if not n:
        return docs
    k = sized(keys, rows=n)
    same = docs["doc_id"].eqNullSafe(k["l_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == k["l_digest"])
    kept = docs.join(k, same, "left_anti")
    if not once:
        return kept
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    one = docs.join(k, same).select(k["l_id"].alias("i"), k["l_digest"].alias("d"), row).groupBy("i", "d").agg(F.first("row").alias("row"))
    return kept.unionByName(one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_links(docs).select("doc_id", "class_id", "n_links", "n_shingles", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


OP6_SQL = r"""
with recursive d as (select row_number() over () rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
s as (select distinct rid, array_to_string(w[i:i + n - 1], ' ') t from (select rid, w, least(5, len(w)) n, unnest(range(1, len(w) - least(5, len(w)) + 2)) i from d where len(w) > 0) x),
n as (select rid, count(*) n from s group by rid),
c as (select a.rid a, b.rid b, count(*) c from s a join s b on a.t = b.t and a.rid <> b.rid group by 1, 2),
link as (select a, b from c join n x on x.rid = a join n y on y.rid = b where c * 10 >= 8 * (x.n + y.n - c)),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
low as (select a rid, min(doc_id) m from reach join d on d.rid = reach.b group by a),
deg as (select a rid, count(*) k from link group by a)
select doc_id, least(coalesce(m, doc_id), doc_id) class_id, cast(coalesce(k, 0) as bigint) n_links, cast(coalesce(n.n, 0) as bigint) n_shingles, least(coalesce(m, doc_id), doc_id) = doc_id kept
from d left join n using (rid) left join low using (rid) left join deg using (rid)
"""
