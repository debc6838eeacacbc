import math
import random
import zlib

import numpy as np
import pytest

from lamina.llm import quality
from lamina.llm.tokens import token_hashes


def data(text, n, seed):
    rng = random.Random(seed)
    good = [text(rng, rng.randint(20, 200)) for _ in range(n)]
    bad = [" ".join(w + rng.choice(["$$$", "###", "!!"]) for w in text(rng, rng.randint(20, 200)).split()) for _ in range(n // 3)]
    return good, bad


def test_held_out_accuracy(text):
    good, bad = data(text, 300, 1)
    rows = [quality.features(t.encode()) for t in good + bad]
    model = quality.fit(rows, np.array([1] * len(good) + [0] * len(bad)))
    good, bad = data(text, 100, 2)
    right = sum(quality.margin(quality.features(t.encode()), model) >= 0 for t in good) + sum(quality.margin(quality.features(t.encode()), model) < 0 for t in bad)
    assert right / (len(good) + len(bad)) > 0.97


def test_log_count_ratios_by_hand():
    rows = [np.array([0, 1], np.int32), np.array([1], np.int32), np.array([2], np.int32)]
    r = quality.log_count_ratios(rows, np.array([1, 1, 0]), bits=2)
    p, q = np.array([2, 3, 1, 1]), np.array([1, 1, 2, 1])
    assert np.allclose(r, np.log(p / p.sum() / (q / q.sum())))


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 16, 5)).astype(np.int32) for _ in range(60)]
    labels = np.array([int(3 in r or 7 in r) for r in rows])
    ratio = np.ones(16)
    w, b = quality.dual_coordinate_descent(rows, ratio, labels, epochs=400)
    y = 2.0 * labels - 1
    cost = lambda w, b: 0.5 * (w @ w + b * b) + sum(2.0 * len(y) / (2 * (y == yi).sum()) * max(0, 1 - yi * (w[r].sum() / np.sqrt(len(r)) + b)) for r, yi in zip(rows, y))
    best = cost(w, b)
    for _ in range(200):
        assert cost(w + rng.normal(0, 0.05, 16), b + rng.normal(0, 0.05)) > best - 1e-3


def test_whole_texts_are_read():
    text = "word " * 700_000 + "tail"
    assert len(token_hashes(text.encode())) == 700_001
    assert token_hashes(text.encode())[-1] == token_hashes(b"tail")[0]


def test_query_shape_nulls_empties_and_repeats(spark, make, text):
    good, bad = data(text, 60, 3)
    docs = make([*good, *bad, None, "", "", (7, good[7], "s"), (None, good[7], "s")], extra=True)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(i, 0) for i in range(60, 80)] + [(1, None), (2, 0), (None, 1), (9999, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.score_documents(docs.select("doc_id", "text"), model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 60").count() > 55


def test_no_labels_and_empty_table(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in quality.score_documents(make(["a", None]), quality.train(make(["a"]), none)).collect()] == [0.5, 0.5]
    assert quality.score_documents(make([]), quality.train(make([]), none)).collect() == []


def test_words_between_other_white_space(text):
    from lamina.llm.tokens import shingles

    words = [f"w{i}" for i in range(400_000)]
    assert len(token_hashes("\n".join(words).encode())) == len(words)
    assert (token_hashes("\n".join(words).encode()) == token_hashes(" ".join(words).encode())).all()
    long = b"a " + b"x" * 5_000_000 + b" b"
    assert len(token_hashes(long)) == 3 and token_hashes(long)[1] == token_hashes(b"x" * 5_000_000)[0] != token_hashes(b"x" * 4_999_999)[0]
    assert len(shingles("\n".join(words))) == len(words) - 4


def plain_features(t):
    """The feature numbers of a text, a token at a time."""
    mask = (1 << 64) - 1
    h = [int(x) for x in token_hashes(t.encode())]
    both = h + [((a * 0xC2B2AE3D27D4EB4F + b) & mask) ^ 0x5851F42D for a, b in zip(h, h[1:])]
    return sorted({(((x ^ (x >> 29)) * 0x9E3779B97F4A7C15) & mask) >> (64 - quality.BITS) for x in both})


def test_query_equals_a_plain_version(spark, make, text, tmp_path):
    good, bad = data(text, 90, 5)
    texts = [*good, *bad, None, "", "only new words here", "$$$ ### !!"]
    make(texts).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    make(texts).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))]
    label = {i: int(i < len(good)) for i in range(len(good) + len(bad))}
    schema = "doc_id bigint, quality int, toxic int"
    spark.createDataFrame([(i, y, 0) for i, y in label.items()], schema).write.parquet(str(tmp_path / "a" / "labels.parquet"))
    # labels of held-out rows turned around: no score may change
    spark.createDataFrame([(i, 1 - y if held[i] else y, 0) for i, y in label.items()], schema).write.parquet(str(tmp_path / "b" / "labels.parquet"))
    got = {r.doc_id: r for r in quality.op2_quality_classifier(spark, str(tmp_path / "a")).collect()}
    again = {r.doc_id: r for r in quality.op2_quality_classifier(spark, str(tmp_path / "b")).collect()}
    assert got == again and len(got) == len(texts)

    train = sorted((label[i], np.array(plain_features(texts[i]), np.int32).tobytes()) for i in label if not held[i])
    rows, y = [np.frombuffer(f, np.int32) for _, f in train], np.array([q for q, _ in train])
    j0 = int(rows[0][0])
    count = {k: sum(j0 in r for r, v in zip(rows, y) if v == k) for k in (0, 1)}
    ratio = quality.log_count_ratios(rows, y)
    total = {k: sum(len(r) for r, v in zip(rows, y) if v == k) + (1 << quality.BITS) for k in (0, 1)}
    assert ratio[j0] == pytest.approx(math.log((1 + count[1]) / total[1]) - math.log((1 + count[0]) / total[0]))
    w, bias = quality.dual_coordinate_descent(rows, ratio, y)
    used = w != 0
    w[used] = 0.75 * w[used] + 0.25 * np.abs(w[used]).mean() * np.sign(w[used])
    for i, t in enumerate(texts):
        f = plain_features(t or "")
        norm = math.sqrt(sum(ratio[j] ** 2 for j in f))
        m = bias + (sum(ratio[j] * w[j] for j in f) / norm if norm else 0)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-2 * max(-30, min(30, m)))), abs=1e-4)
        assert (got[i].held_out, got[i].predicted) == (held[i], int(got[i].score >= 0.5))
    tested = [i for i in label if held[i]]
    assert sum(got[i].predicted == label[i] for i in tested) / len(tested) > 0.95


def test_repeated_ids_do_not_widen_the_training_set(spark, make, text):
    good, bad = data(text, 30, 6)
    docs = make([(i % 10, t, "s") for i, t in enumerate(good + bad)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, quality int")
    assert quality.training_rows(docs, labels).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(10))
    assert quality.training_rows(docs, labels, 2).count() == 2
