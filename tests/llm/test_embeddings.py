import math

import numpy as np
import pytest

from lamina.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(np.float64)
            a = a / np.abs(a).max()
            good[k] = a / np.linalg.norm(a)
    links, group = [0] * len(rows), list(range(len(rows)))
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return links, group


def test_finds_links_and_components(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows), (base + 0.1 * rng.standard_normal(16)).tolist()))
    hot = rng.standard_normal(16)
    rows += [(len(rows) + k, (hot + 0.05 * rng.standard_normal(16)).tolist()) for k in range(300)]
    links, group = brute(rows)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    got = {r.vec_id: r for r in embeddings.cosine_links(df).collect()}
    found = sum(got[i].n_links for i in range(len(rows)))
    assert all(got[i].n_links <= links[i] for i in range(len(rows)))  # none below the threshold
    assert found >= 0.97 * sum(links)
    assert sum(got[i].component_id == group[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (5, v), (9, [2.0, 4.0, 6.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 3.0]), (4, [1.0, float("nan"), 3.0]), (6, [float("inf"), 0.0, 0.0]), (7, []), (8, v + [0.0]), (None, v), (10, [1e-30, 2e-30, 3e-30])]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embeddings.cosine_links(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)).collect())
    assert got == sorted([(5, 4, 5, True), (5, 4, 5, True), (9, 4, 5, False), (0, 4, 5, False), (10, 4, 5, False), *((i, 0, i, True) for i in (1, 2, 3, 4, 6, 7, 8))])


def test_empty_table(spark):
    assert embeddings.cosine_links(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("visits", [1, 5, 40, 64])
def test_traversal_is_in_order(visits):
    rng = np.random.default_rng(2)
    books = rng.standard_normal((8, 4)), rng.standard_normal((8, 4))
    x = rng.standard_normal((20, 8))
    cells = embeddings.nearest_cells(x, books, visits)
    whole = (embeddings.distances(x[:, :4], books[0])[:, :, None] + embeddings.distances(x[:, 4:], books[1])[:, None, :]).reshape(20, -1)
    assert (cells == np.argsort(whole, axis=1, kind="stable")[:, :visits]).all()


def test_thousands_of_equal_vectors(spark):
    rng = np.random.default_rng(4)
    v, w = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(i, v.tolist(), 0) for i in range(20_000)] + [(30_000, (2 * v).tolist(), 0), (30_001, w.tolist(), 0)]
    got = embeddings.cosine_links(spark.createDataFrame(rows, SCHEMA).repartition(8)).groupBy("n_links", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == sorted([(20_000, 0, False, 20_000), (20_000, 0, True, 1), (0, 30_001, True, 1)])


@pytest.mark.parametrize("noise, core", [(0.02, True), (0.3, False)])
def test_many_near_copies_in_one_cell(spark, noise, core):
    """Close ones are counted around a centre, others compared; either is exact."""
    rng = np.random.default_rng(8)
    hot = rng.standard_normal(16)
    rows = [(i, (hot + noise * rng.standard_normal(16)).tolist()) for i in range(1500)] + [(5000 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    rows += [(9000 + i, (hot + 0.45 * rng.standard_normal(16)).tolist()) for i in range(100)]
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {r.vec_id: r.n_links for r in embeddings.cosine_links(df).collect()}
    found = np.array([got[i] for i, _ in rows])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    assert found[:1500].min() >= 1499 if core else found[:1500].min() < 1400


def test_doubles_and_floats(spark):
    rows = [(1, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3000001]), (3, [-1.0, 0.0, 0.0])]
    for kind in ("float", "double"):
        got = embeddings.cosine_links(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>"))
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
