import hashlib
import random
import re

from lamina.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids |= wins[tuple(w[k : k + n])]
        names = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((len(w), len(hit), len(ids - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def test_equals_brute_force(spark, make, text):
    rng = random.Random(3)
    items = [(i, text(rng, rng.randint(1, 40), 300)) for i in range(12)] + [(20, None), (21, "..."), (22, "solo"), (23, "Two words"), (None, text(rng, 15, 300)), (3, text(rng, 12, 300)), (30, "É à B c d é f g h i j"), (31, "É à B c d é f g h i j")]
    docs = [text(rng, rng.randint(0, 200), 300) for _ in range(40)]
    for k in range(20):
        w = words(items[k % len(items)][1])
        a = rng.randrange(max(1, len(w) - 10))
        docs.append(text(rng, 30, 300) + " " + ", ".join(w[a : a + rng.choice([9, 10, 11, 40])]).upper() + "! " + text(rng, 5, 300))
    docs += [None, "", "...", "SOLO", "a two-WORDS b", "É à b C d é f g h i j", "é à b C d é f g h i j", " ".join(words(items[0][1]) * 30)]
    docs += [docs[45]] * 3
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(make(docs, extra=True).repartition(4), b).collect()}
    for i, want in enumerate(brute(docs, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, i
    kept = decontamination.drop_contaminated(make(docs, extra=True), b)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(brute(docs, items)) if not w[4]]


def test_repeated_null_and_empty(spark, make):
    b = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    got = decontamination.decontaminate(make([(5, "x a b c d", "s"), (5, "x a b c d", "s"), (None, "a b c d", "s"), (5, "other", "s")]), b).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got) == [(0, 4, 4), (5, 1, 0), (5, 5, 4), (5, 5, 4)]
    assert decontamination.decontaminate(make([]), b).collect() == []
    none = decontamination.decontaminate(make(["a b"]), b.where("false")).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none] == [(2, 0, False)]
