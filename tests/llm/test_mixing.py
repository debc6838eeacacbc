import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamina.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 1000, 1000], [3, 1, 1]) == pytest.approx([30, 990, 990])
    assert mixing.targets([0, 5], [1, 1]) == pytest.approx([0, 5])
    assert mixing.targets([], []) == []
    got = mixing.targets([1, 2, 4000, 5], [1, 2, 3, 1])
    assert sum(got) == pytest.approx(4008) and all(t <= 3 * s + 1e-9 for t, s in zip(got, [1, 2, 4000, 5]))


def test_splitting_tree_is_exact():
    q = [0, 7, 1000, 31, 5]
    s = mixing.split_tree(q, 13, 4)
    assert s.sum(axis=1).tolist() == q and s.sum(axis=0).max() - s.sum(axis=0).min() <= 1
    assert (s == mixing.split_tree(q, 13, 4)).all() and (s != mixing.split_tree(q, 13, 5)).any()


def test_splitting_tree_is_hypergeometric():
    mean = np.mean([mixing.split_tree([10, 30], 2, seed)[0, 0] for seed in range(400)])
    assert abs(mean - 5) < 0.3


def rows(text):
    rng = random.Random(4)
    return [(i, text(rng, rng.randint(1, 40)), rng.choice(["a", "b", "b", "b", "c", None, "é"])) for i in range(1500)]


def test_query_rows(make, text):
    data = rows(text) + [(5000, None, "a"), (5001, "", "b"), (5002, "  \t\n", None), (5003, "nbsp one word", "a")]
    docs = make(data, extra=True)
    got = mixing.taken_by_row(mixing.plan_mix(docs)).collect()
    assert len(got) == len(data)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in data}
    source = {i: s for i, _, s in data}
    size = Counter()
    for i, _, s in data:
        size[s] += words[i]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [(1, 2, 3)[k % 3] for k in range(len(order))])))
    taken = defaultdict(int)
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == size[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in order)
    again = mixing.taken_by_row(mixing.plan_mix(docs.repartition(7))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_holds_what_the_plan_takes(make, text):
    docs = make(rows(text)[:300] + [(1, "equal row here", "a")] * 4, extra=True)
    plan = mixing.plan_mix(docs)
    taken = sum(r.n_takes for r in mixing.taken_by_row(plan).collect())
    mixed = mixing.mixed_rows(docs, plan)
    assert mixed.columns == docs.columns and mixed.count() == taken
    shards = [p.shard for r in plan.collect() for p in r.placements or ()]
    assert len(set(shards)) > 20
    places = [p for r in mixing.taken_by_row(plan).collect() for p in r.places.split(",") if p]
    assert len(places) == len(set(places)) == taken


def test_one_hot_row_and_empty_table(make):
    hot = make([(1, "same words here", "a")] * 50 + [(2, "other", "b")])
    got = mixing.taken_by_row(mixing.plan_mix(hot)).collect()
    assert len(got) == 51 and abs(sum(r.taken for r in got if r.doc_id == 1) - [r.target for r in got if r.doc_id == 1][0]) <= 3
    assert mixing.taken_by_row(mixing.plan_mix(make([]))).collect() == []
    assert mixing.mixed_rows(make([]), mixing.plan_mix(make([]))).collect() == []


def test_many_sources_in_few_pools(make, text, monkeypatch):
    rng = random.Random(6)
    data = [(i, text(rng, rng.randint(1, 60) if i % 9 else 900), rng.choice([None, "é", *(f"s{k}" for k in range(120))])) for i in range(900)]
    data += [(1000, None, "no words"), (1, data[1][1], data[1][2])]
    docs = make(data, extra=True)
    key = lambda r: (r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.n_takes)
    apart = sorted(map(key, mixing.taken_by_row(mixing.plan_mix(docs)).collect()))
    monkeypatch.setattr(mixing, "POOLS", 8)
    plan = mixing.plan_mix(docs)
    assert sorted(map(key, mixing.taken_by_row(plan).collect())) == apart and any(abs(t - 3 * s) < 1e-3 for _, _, s, t, _, _ in apart if s)
    size = Counter()
    for i, t, s in data:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [(1, 2, 3)[k % 3] for k in range(len(order))])))
    source = {i: s for i, _, s in data}
    assert all(t == pytest.approx(want[source[i]], abs=1e-3) for i, _, _, t, _, _ in apart)
    assert mixing.mixed_rows(docs, plan).count() == sum(k[-1] for k in apart)
    again = mixing.plan_mix(docs.repartition(5))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, plan.collect()))
    assert len({at.shard for r in plan.collect() for at in r.placements or ()}) > 20


def test_the_tree_decides_the_places(make, text):
    docs = make(rows(text))
    one, same, other = (mixing.taken_by_row(mixing.plan_mix(docs, tree_seed=s)).collect() for s in (1, 1, 2))
    assert sorted(one) == sorted(same)
    by = lambda got: {(r.doc_id, r.taken, r.n_takes): r.places for r in got}
    assert by(one).keys() == by(other).keys() and sum(by(one)[k] != by(other)[k] for k in by(one)) > len(one) // 2
    slots = defaultdict(list)
    for r in one:
        places = [tuple(map(int, p.split(":"))) for p in r.places.split(",") if p]
        assert len(places) == r.n_takes
        for shard, slot in places:
            slots[shard].append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(slots) < mixing.MIN_SHARDS


def test_tasks_and_driver_split_alike(spark, monkeypatch):
    quotas = {3: 900, 5: 77, 11: 2000, 40: 0}
    want = mixing.split_tree([quotas[p] for p in sorted(quotas)], 300, 9)
    for frontier in (1, 7, 64, 1000):
        monkeypatch.setattr(mixing, "FRONTIER", frontier)
        got = {(r.pool, r.shard): r.drawn for r in mixing.split_quotas(spark, quotas, 300, 9).collect()}
        assert got == {(p, s): want[i, s] for i, p in enumerate(sorted(quotas)) for s in range(300) if want[i, s]}
