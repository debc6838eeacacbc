import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import jaccard


def brute(rows, threshold=0.8):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, group = defaultdict(int), list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    return links, [root(i) for i in range(len(rows))], sets


def corpus(text):
    rng = random.Random(8)
    out = []
    for _ in range(12):
        base = text(rng, rng.randint(30, 400)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    tight = text(rng, 80).split()
    out += [" ".join(tight[:k] + ["x"] + tight[k + 1 :]) for k in range(0, 80)]  # one group of near copies
    out += [out[0]] * 5 + [out[0].upper() + " !!", None, "", "", "one two", "one two", "ONE, two", "lonely", "..."]
    return [(i, t, "s") for i, t in enumerate(out)]


def test_equals_brute_force(make, text):
    rows = corpus(text)
    links, group, sets = brute(rows)
    got = {r.doc_id: r for r in jaccard.jaccard_links(make(rows, extra=True).repartition(6)).collect()}
    low = defaultdict(lambda: 10**9)
    for i, g in enumerate(group):
        low[g] = min(low[g], i)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].class_id, got[i].n_shingles) == (links[i], low[group[i]], len(sets[i])), i


def test_one_of_each_group_stays(make, text):
    rows = corpus(text)
    _, group, sets = brute(rows)
    docs = make(rows, extra=True)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {min(j for j in range(len(rows)) if group[j] == group[i]) if sets[i] else i for i in range(len(rows))}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_repeated_and_null_ids(make, text):
    t = text(random.Random(1), 50)
    rows = [(4, t, "s"), (4, t, "s"), (None, t + " more", "s"), (None, None, None), (7, "alone in here", "s")]
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in jaccard.jaccard_links(make(rows)).collect())
    assert got == sorted([(4, 4, 2), (4, 4, 2), (-1, 4, 2), (-1, -1, 0), (7, 7, 0)])
    kept = sorted((r.doc_id or -1, r.text or "") for r in jaccard.drop_near_duplicates(make(rows)).collect())
    assert kept == [(-1, ""), (4, t), (7, "alone in here")]


def test_empty_table(make):
    assert jaccard.jaccard_links(make([])).collect() == []
    assert jaccard.drop_near_duplicates(make([])).collect() == []


@pytest.mark.parametrize("target, level", [(0.9, 8), (0.99, 6), (0.998, 5), (0.9995, 4)])
def test_prefix_is_shortened_until_the_target(spark, target, level):
    """Links whose signatures agree in 4 of 5 digits: the level is that of pairs at 0.8."""
    sig = lambda k: b"".join((x if x % 5 < 4 or not k else 60_000 + x).to_bytes(2, "little") for x in range(128))
    classes = spark.createDataFrame([(0, sig(0)), (1, sig(1))], "node bigint, sig binary")
    links = spark.createDataFrame([(0, 1, 8)], "a bigint, b bigint, level int")
    assert jaccard.choose_level(links, classes, 0.79, 16, target) == level
    assert jaccard.choose_level(links.limit(0), classes, 0.8, 16, target) == level


def test_one_loose_link_among_many_close_ones_decides_the_level(spark):
    """30,000 links of equal signatures and one of a pair at 0.8, the last in the order of a hash."""
    sig = lambda k: b"".join((x if x % 5 < 4 or not k else 60_000 + x).to_bytes(2, "little") for x in range(128))
    links = spark.range(30_000).selectExpr("id div 150 a", "1000 + id % 150 b", "8 level")
    loose = spark.range(200_000).selectExpr("5000 + id a", "300000 + id b", "8 level").orderBy(F.xxhash64("a", "b").desc()).limit(1)
    assert loose.select(F.xxhash64("a", "b")).first()[0] > links.select(F.xxhash64("a", "b").alias("h")).orderBy("h").collect()[20_000].h
    ids = [*range(200), *range(1000, 1150)]
    classes = spark.createDataFrame([*((i, sig(0)) for i in ids), *zip(loose.first()[:2], (sig(0), sig(1)))], "node bigint, sig binary")
    assert jaccard.choose_level(links, classes, 0.79, 16) == 8
    assert jaccard.choose_level(links.unionByName(loose), classes, 0.79, 16) == 5


def test_pairs_at_the_threshold_beside_thousands_of_close_copies(make, crowded):
    rows, want = crowded
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_links(make(rows)).collect()}
    assert [got[i] for i, _, _ in rows] == want


@pytest.mark.parametrize("threshold, bound", [(0.8, 57), (0.6, 35), (0.5, 25), (1.0, 96)])
def test_bound_of_the_signatures_follows_the_threshold(threshold, bound):
    assert jaccard.agree_bound(threshold, 96) == bound


def test_links_of_a_level_connect_just_the_paths_of_one_node(spark):
    rng = np.random.default_rng(3)
    digits = rng.integers(0, 3, (300, 2, jaccard.DEPTH)).astype(np.uint16)
    rows = [(i, d.tobytes()) for i, d in enumerate(digits)]
    classes = spark.createDataFrame(rows, "node bigint, sig binary").repartition(5)
    links = [(r.a, r.b, r.level) for r in jaccard.forest(classes).collect()]
    for level in range(jaccard.SHORTEST, jaccard.DEPTH + 1):
        label = list(range(len(rows)))

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for t in range(2):
            seen = {}
            for i, d in enumerate(digits):
                label[root(i)] = root(seen.setdefault(d[t, :level].tobytes(), i))
        want = [root(i) for i in range(len(rows))]
        label = list(range(len(rows)))
        for a, b, k in links:
            if k >= level:
                label[root(a)] = root(b)
        got = [root(i) for i in range(len(rows))]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got)), level


def test_clusters_of_many_blocks_equal_brute_force(make, text, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(jaccard, "LARGE_BLOCK_BYTES", 40_000)
    rng = random.Random(21)
    base = text(rng, 120, 10**6).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 3) if i % 2 else rng.randint(2, 6)):
            w[rng.randrange(len(w))] = f"c{rng.random()}"
        rows.append((i, " ".join(w), "s"))
    rows += [(200 + i, rows[i][1], "s") for i in range(5)]
    links, group, _ = brute(rows)
    got = {r.doc_id: r for r in jaccard.jaccard_links(make(rows)).collect()}
    assert [got[r[0]].n_links for r in rows] == [links[i] for i in range(len(rows))]
    assert len({(group[i], got[r[0]].class_id) for i, r in enumerate(rows)}) == len(set(group))


def test_thousands_of_near_copies_of_one_text(make, text):
    rng = random.Random(5)
    base = text(rng, 200, 10**6).split()
    rows = [(i, " ".join([*base[:k], f"z{i}", *base[k + 1 :]]), "s") for i, k in enumerate(rng.randrange(200) for _ in range(5000))]
    rows += [(5000 + i, text(rng, 200, 10**6), "s") for i in range(100)]
    got = jaccard.jaccard_links(make(rows).repartition(8)).groupBy("class_id", "n_links").count().collect()
    assert sorted((r.class_id, r.n_links, r["count"]) for r in got) == [(0, 4999, 5000), *((5000 + i, 0, 1) for i in range(100))]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.9])
def test_recall_at_thresholds(make, text, threshold):
    """Pairs whose similarity is spread around the threshold, many just over it."""
    rng = random.Random(7)
    rows = []
    for _ in range(150):
        w = text(rng, 104, 10**6).split()
        rows.append(" ".join(w))
        at = rng.sample(range(0, 100, 5), 20)
        changes = max(0, round(20 * (1 - threshold) / (1 + threshold)) - rng.randint(0, 3))
        for k in at[:changes]:
            w[k + 4] = f"c{rng.random()}"
        rows.append(" ".join(w))
    rows = [(i, t, "s") for i, t in enumerate(rows)]
    links, _, _ = brute(rows, threshold)
    got = jaccard.jaccard_links(make(rows), threshold).collect()
    assert sum(links.values()) > 100
    assert all(r.n_links <= links[r.doc_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.99 * sum(links.values())


@pytest.mark.parametrize("threshold, changes", [(0.6, 4), (0.5, 5)])
def test_pairs_at_a_lower_threshold(make, text, threshold, changes):
    rng = random.Random(12)
    rows = []
    for i in range(60):  # 80 or 75 shingles, of which each change takes five
        w = text(rng, 84 if changes == 4 else 79, 10**6).split()
        rows += [" ".join(w), " ".join(f"x{k}" if k % 10 == 5 and k < 10 * changes else x for k, x in enumerate(w))]
    rows = [(i, t, "s") for i, t in enumerate(rows)]
    links, group, sets = brute(rows, threshold)
    assert sum(links.values()) == len(rows) and all(len(sets[i] & sets[i + 1]) == pytest.approx(threshold * len(sets[i] | sets[i + 1])) for i in range(0, len(rows), 2))
    assert all(r.n_links == links[r.doc_id] for r in jaccard.jaccard_links(make(rows), threshold).collect())
