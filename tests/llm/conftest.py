import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """make(texts) gives documents with ids from 0; rows (id, text, source) as they are."""

    def build(rows, extra=False):
        rows = [(i, r, "s") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        data = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
        if not extra:
            return spark.createDataFrame(data, DOCS)
        names = ["size", "copies", "digest", "row", "l_id", "k_id", "score_", "shard", "slot", "f1", "at"]
        return spark.createDataFrame([(*r, *range(len(names))) for r in data], DOCS + "".join(f", {n} bigint" for n in names))

    return build


def prose(rng: random.Random, n: int, words: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(words):x}" for _ in range(n))


@pytest.fixture(scope="session")
def text():
    return prose


@pytest.fixture(scope="session")
def crowded():
    """Rows, and the links of each: 2,500 near copies of one text, and 60 pairs whose 90
    shingles and 90 have just 80 in common (a similarity of 0.8)."""
    rng = random.Random(31)
    base = prose(rng, 200, 10**6).split()
    rows = [" ".join([*base[:k], f"z{i}", *base[k + 1 :]]) for i, k in enumerate(rng.randrange(200) for _ in range(2500))]
    for _ in range(60):
        w = prose(rng, 94, 10**6).split()
        rows += [" ".join(w), " ".join(f"x{k}" if k in (20, 60) else x for k, x in enumerate(w))]
    return [(i, t, "s") for i, t in enumerate(rows)], [2499] * 2500 + [1] * 120
