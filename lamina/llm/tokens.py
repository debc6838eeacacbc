"""Vectorised token hashes of UTF-8 texts."""

from __future__ import annotations

import numpy as np

#: Texts are worked on in pieces of at most this many bytes.
PIECE = 1 << 20

_ODD = 0x100000001B3
_INV = pow(_ODD, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = powers(_ODD, PIECE + 1), powers(_INV, PIECE + 1)
# 0: white space and controls, 1: letters and digits (bytes of other scripts included), 2: the rest.
_CLASS = np.array([1 if chr(b).isalnum() and b < 128 or b >= 128 else 0 if b <= 32 or b == 127 else 2 for b in range(256)], dtype=np.uint8)
_WORDS = np.where(_CLASS == 1, 1, 0).astype(np.uint8)


def token_hashes(data: bytes, marks: bool = True) -> np.ndarray:
    """64-bit hashes of a text's tokens, in order: runs of letters and digits and, if
    ``marks``, runs of other visible characters. Pieces end where a run does; a longer
    run makes its piece longer."""
    classes = _CLASS if marks else _WORDS
    out = []
    at, size = 0, PIECE
    while at < len(data):
        a = np.frombuffer(data, dtype=np.uint8, count=min(size, len(data) - at), offset=at)
        kind = classes[a]
        edge = np.empty(len(a) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        cuts = np.flatnonzero(edge)
        if at + len(a) < len(data):  # the last run may go on
            if len(cuts) == 2:
                size *= 2
                continue
            cuts = cuts[:-1]
        up, down = (_UP, _DOWN) if len(a) <= PIECE else (powers(_ODD, len(a)), powers(_INV, len(a)))
        starts, ends = cuts[:-1], cuts[1:]
        keep = kind[starts] > 0
        starts, ends = starts[keep], ends[keep]
        sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
        out.append((sums[ends] - sums[starts]) * down[starts])
        at, size = at + int(cuts[-1]), PIECE
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words, but not
    none, is one shingle."""
    t = mix(token_hashes(text.lower().encode(), marks=False))
    if not len(t):
        return t
    w = min(width, len(t))
    out = np.zeros(len(t) - w + 1, dtype=np.uint64)
    for i in range(w):
        out = out * np.uint64(0x9E3779B97F4A7C15) + t[i : len(t) - w + 1 + i]
    return np.unique(mix(out + np.uint64(w)))
