import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lamina.llm import substrings


def brute(texts, length):
    blobs = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] > gone[:-1]).sum() + gone[0]), kept))
    return out


def corpus(text):
    rng = random.Random(5)
    base = [text(rng, rng.randint(1, 300)) for _ in range(12)]
    passage, other = text(rng, 60), text(rng, 45)
    docs = base + [base[0], base[0], None, "", "", "short", "ab" * 300, "a" * 199, "b" * 200, "b" * 201, "é" * 150]
    docs += [text(rng, 20) + passage + text(rng, 20) for _ in range(15)]
    docs += [other + " " + other, passage[:250] + text(rng, 10), base[3][5:400] + passage[20:300], base[2] + base[4]]
    return docs


@pytest.mark.parametrize("hot, few", [(1000, 200), (2, 200), (2, 3)])
def test_equals_brute_force(spark, make, text, monkeypatch, hot, few):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "FEW", few)
    docs = corpus(text)
    got = sorted(substrings.remove_repeats(make(docs, extra=True).repartition(5)).collect(), key=lambda r: r.doc_id)
    for r, want in zip(got, brute(docs, 200)):
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, r.doc_id


def test_repeated_ids_and_null_ids(spark, make, text):
    t = text(random.Random(1), 100)
    got = substrings.remove_repeats(make([(1, t, "s"), (1, t, "s"), (None, t[:-1], "s"), (2, "x", "s")])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == sorted([(len(t), len(t), 1)] * 2 + [(len(t) - 1, len(t) - 1, 1), (1, 0, 0)])


def test_empty_table(make):
    assert substrings.remove_repeats(make([])).collect() == []


def test_long_texts_in_pieces(text, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 1 << 14)
    t = text(random.Random(2), 30_000).encode()
    whole = set()
    for buf, _, offset, a, lo, hi, _ in substrings.anchors([t[:500], t]):
        for o, x, y, z in zip(offset, a, lo, hi):
            assert y <= x <= y + 200 - substrings.GRAM and z + 200 - substrings.GRAM >= x >= z
            whole |= set(range(y + o, z + o + 1)) if len(buf) > 500 else set()
    assert set(range(len(t) - 199)) <= whole | set(range(301))


def test_groups_over_a_piece(monkeypatch):
    ctx = [hashlib.sha512(str(i // 2).encode()).digest() * 4 for i in range(6)]
    key, lead, one = np.zeros(6, np.int64), np.zeros(6, np.int32), np.ones(6, np.int64)
    plain = sorted(zip(*substrings.repeated(key, lead, ctx, one)))
    monkeypatch.setattr(substrings, "_UP", substrings._UP[:1000])
    monkeypatch.setattr(substrings, "_DOWN", substrings._DOWN[:1000])
    assert sorted(zip(*substrings.repeated(key, lead, ctx, one))) == plain and len(plain) == 6 * 57


def shared_starts(words):
    """Of each word, how many characters it starts with that another one starts with too."""
    order, out = sorted(range(len(words)), key=words.__getitem__), [0] * len(words)
    for i, j in zip(order, order[1:]):
        k = next((k for k, (p, q) in enumerate(zip(words[i], words[j])) if p != q), min(len(words[i]), len(words[j])))
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


@pytest.mark.parametrize("n, size", [(3000, 190), (20_000, 260)])
def test_one_passage_in_thousands_of_texts(make, text, n, size):
    """Under 200 bytes nothing is repeated, though all texts share an anchor."""
    rng = random.Random(3)
    passage = text(rng, 100)[:size]
    own = [(f"<{rng.random()}{i}", f"{i}{rng.random()}>") for i in range(n)]
    got = substrings.remove_repeats(make([(i, a * 3 + passage + b * 3, "s") for i, (a, b) in enumerate(own)]).repartition(6)).collect()
    assert len(got) == n
    left, right = shared_starts([(a * 3)[::-1] for a, _ in own]), shared_starts([b * 3 for _, b in own])
    for r in got:
        a, b = own[r.doc_id]
        whole, x, y = a * 3 + passage + b * 3, len(a) * 3 - left[r.doc_id], len(a) * 3 + size + right[r.doc_id]
        if size < 200:
            assert (r.n_removed, r.n_spans, bytes(r.kept).decode()) == (0, 0, whole)
        else:
            assert (r.n_removed, r.n_spans, bytes(r.kept).decode()) == (y - x, 1, whole[:x] + whole[y:])


def test_hot_groups_are_cut_until_they_are_small(spark, make, text, monkeypatch):
    """What a task is given of one key, with 2,000 texts around one passage."""
    monkeypatch.setattr(substrings, "HOT", 50)
    monkeypatch.setattr(substrings, "FEW", 20)
    seen = []
    real = substrings.materialize

    def spy(df, what="table"):
        out = real(df, what)
        if what == "contexts":
            seen.append(out.where("far > near").groupBy("key").count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(substrings, "materialize", spy)
    rng = random.Random(4)
    passage = text(rng, 100)[:190]
    substrings.remove_repeats(make([(i, text(rng, 60, 10**6) + passage + text(rng, 60, 10**6), "s") for i in range(2000)])).collect()
    assert seen[0] > 1000 and seen[-1] <= 20
