"""Repeated substrings by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first LENGTH bytes only, by most-significant-digit
passes; a group that is still together after the last pass is exactly one repeated
LENGTH-byte string, and suffixes that are alone in a group leave the sort at once.

The first pass deals the suffixes over the cluster. Its digit is the least-hashed
GRAM-byte string inside the suffix's first LENGTH bytes (equal strings have the same
one at the same place), and only suffixes whose digit occurs twice stay. About one
byte in 85 is such an anchor, so what is shuffled is anchors, not suffixes. The later
passes run inside each anchor's group on the suffixes around it: the place of the
anchor, then digits of DIGIT bytes, until LENGTH bytes are used up. A group is known by
one 64-bit hash of its digits so far, so two strings count as equal if those hashes,
compared inside a task's batch of at most a few megabytes, are.

Equal texts are one text with a number of copies from the start. Groups of an anchor
with over HOT members are dealt by more of their bytes: suffixes go by how far before
the anchor they start, in ranges that double, and by the bytes that all suffixes of the
range share; equal surroundings are combined before the shuffle. Where over FEW different
surroundings still share those bytes, the range is cut in halves, whose suffixes share
more bytes, and so on: a range of one suffix shares all its bytes, and is one row. So
no task gets a group that grows with the number of documents that share a passage.

Defined results: null text is empty; texts of under LENGTH bytes lose nothing; copies
of a longer text are removed whole; equal rows get equal results; a null doc_id is
kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package, sized, text_or_empty
from .tokens import _DOWN, _INV, _ODD, _UP, PIECE, mix, powers

LENGTH = 200
GRAM = 32
DIGIT = 50
HOT = 1000
FEW = 100

KEY = "f1 bigint, f2 int"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Texts packed into buffers of at most PIECE bytes, with segments (text number,
    start in the buffer, bytes, offset in the text). Long texts are cut into pieces that
    overlap by length - 1 bytes, so that every window is whole in one of them."""
    parts, segments, size = [], [], 0
    for n, t in enumerate(texts):
        at = 0
        while len(t) - at >= length:
            piece = t[at : at + PIECE]
            if size + len(piece) > PIECE:
                yield np.frombuffer(b"".join(parts), dtype=np.uint8), segments
                parts, segments, size = [], [], 0
            parts.append(piece)
            segments.append((n, size, len(piece), at))
            size += len(piece)
            if at + len(piece) >= len(t):
                break
            at += len(piece) - length + 1
    if parts:
        yield np.frombuffer(b"".join(parts), dtype=np.uint8), segments


def _prefix(buf: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    up = _UP if len(buf) < len(_UP) else powers(_ODD, len(buf))
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return sums


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    p = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    p[: len(x)] = x
    p = p.reshape(-1, w)
    before = np.minimum.accumulate(p, axis=1).ravel()
    after = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each buffer: (bytes, text number, offset from buffer to text positions, anchor,
    first window, last window - all in the buffer -, gram hash) of its anchors in order."""
    w = length - GRAM + 1
    for buf, segments in _pieces(texts, length):
        sums = _prefix(buf)
        n = len(buf) - GRAM + 1
        h = mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:n])
        packed = (h & ~np.uint64(PIECE - 1)) | np.arange(n, dtype=np.uint64)  # the leftmost of equal grams
        at = (_sliding_min(packed, w) & np.uint64(PIECE - 1)).astype(np.int64)
        start, size = np.array([s[1] for s in segments]), np.array([s[2] for s in segments])
        valid = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(valid, start, 1)
        np.add.at(valid, np.minimum(start + size - length + 1, len(at)), -1)
        p = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        a = at[p]
        segment = np.searchsorted(start, p, side="right") - 1
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (segment[1:] != segment[:-1])])
        last = np.r_[first[1:], len(p)] - 1
        seg = segment[first]
        yield buf, np.array([s[0] for s in segments])[seg], np.array([s[3] - s[1] for s in segments])[seg], a[first], p[first], p[last], h[a[first]]


def _ordinals(text: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Number of each anchor in its text; a text's buffers follow each other."""
    out = np.empty(len(text), dtype=np.int64)
    cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        t = int(text[a])
        out[a:b] = np.arange(b - a) + seen.get(t, 0)
        seen[t] = seen.get(t, 0) + b - a
    return out


def _grams(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for p in parts:
        f1, f2, seen = p["f1"].to_numpy(), p["f2"].to_numpy(), {}
        for _, text, _, _, _, _, gram in anchors([bytes(t) for t in p["body"]], length):
            yield pd.DataFrame({"f1": f1[text], "f2": f2[text], "ordinal": _ordinals(text, seen).astype(np.int32), "gram": gram.view(np.int64)})


def _contexts(parts: Iterator[pd.DataFrame], length: int, hot: bool) -> Iterator[pd.DataFrame]:
    """Rows (f1, f2, key, first, lead, ctx) of the candidate anchors: the windows from
    text position ``first`` on, the first of which starts ``lead`` bytes before the anchor,
    and the bytes they cover. Hot ones are cut into ranges (near to far bytes before the
    anchor) that double, and those with equal surroundings in one text are one row with an
    array ``firsts``."""
    for p in parts:
        f1, f2, wanted, seen = p["f1"].to_numpy(), p["f2"].to_numpy(), p["ordinals"].tolist(), {}
        for buf, text, offset, a, lo, hi, gram in anchors([bytes(t) for t in p["body"]], length):
            number = _ordinals(text, seen)
            cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            keep = np.concatenate([np.isin(number[x:y], wanted[text[x]]) for x, y in zip(cuts, [*cuts[1:], len(text)])]) if len(text) else np.empty(0, bool)
            text, offset, a, lo, hi, key = text[keep], offset[keep], a[keep], lo[keep], hi[keep], gram[keep]
            if hot:
                sums = _prefix(buf)
                out = []
                for j in range((length - GRAM).bit_length() + 1):
                    near, far = (1 << j) >> 1, min((1 << j) - 1, length - GRAM)
                    x, y = np.maximum(lo, a - far), np.minimum(hi, a - near)
                    ok = x <= y
                    s, e = a[ok] - near, a[ok] - far + length
                    shared = mix((sums[e] - sums[s]) * _DOWN[s])
                    out.append((text[ok], offset[ok], a[ok], x[ok], y[ok], mix(key[ok] * _GOLD + shared + np.uint64(j)), np.full(ok.sum(), near), np.full(ok.sum(), far)))
                text, offset, a, lo, hi, key, nears, fars = (np.concatenate(c) for c in zip(*out))
            data = buf.tobytes()
            ctx = [data[x : y + length] for x, y in zip(lo.tolist(), hi.tolist())]
            key, first, lead = key.view(np.int64), lo + offset, (a - lo).astype(np.int32)
            if not hot:
                yield pd.DataFrame({"f1": f1[text], "f2": f2[text], "key": key, "first": first, "lead": lead, "ctx": ctx})
                continue
            same: dict[tuple, list[int]] = {}  # a text that repeats a line has the same surroundings again and again
            for t, k, l, c, x, n, f in zip(text.tolist(), key.tolist(), lead.tolist(), ctx, first.tolist(), nears.tolist(), fars.tolist()):
                same.setdefault((t, k, l, c, n, f), []).append(x)
            t, k, l, c, n, f = (list(x) for x in zip(*same)) if same else ([], [], [], [], [], [])
            yield pd.DataFrame({"f1": f1[t], "f2": f2[t], "key": k, "firsts": list(same.values()), "lead": l, "near": n, "far": f, "ctx": c})


def _halve(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows of LEVEL with each range in two halves: their windows, the bytes that they
    cover, and a key from the bytes that all windows of the half share."""
    names = [c.split()[0] for c in LEVEL.split(", ")]
    for p in parts:
        out = []
        for i, shift, key, near, far, lead, ctx, n in zip(*(p[c].tolist() for c in names)):
            least = lead - (len(ctx) - length)  # the last window starts that far before the anchor
            middle = (near + far) // 2
            for half, (lo, hi) in enumerate(((near, middle), (middle + 1, far))):
                x, y = min(hi, lead), max(lo, least)
                if x < y:
                    continue
                shared = _prefix(np.frombuffer(ctx[lead - lo : lead - hi + length], dtype=np.uint8))[-1:]
                own = mix(np.array([key], dtype=np.int64).view(np.uint64) * _GOLD + mix(shared) + np.uint64(half))
                out.append((i, shift + lead - x, int(own.view(np.int64)[0]), lo, hi, x, ctx[lead - x : lead - y + length], n))
        yield pd.DataFrame(out, columns=names)


#: Contexts on a level of the cut: id of a row of hot contexts, and what its windows are shifted by in it.
LEVEL = "id bigint, shift int, key bigint, near int, far int, lead int, ctx binary, n bigint"


def repeated(key: np.ndarray, lead: np.ndarray, ctx: list[bytes], weight: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The radix passes over the windows of some contexts, whole groups of keys: (context
    number, window number in it) of those whose string occurs twice (contexts count by
    weight)."""
    sizes = np.array([len(c) for c in ctx])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    buf = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    sums = _prefix(buf)
    down = _DOWN if len(buf) < len(_DOWN) else powers(_INV, len(buf) + 1)
    windows = sizes - length + 1
    row = np.repeat(np.arange(len(ctx)), windows)
    number = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
    group = mix(key.view(np.uint64)[row] * _GOLD + (lead[row] - number).astype(np.uint64))
    for depth in range(0, length, DIGIT):
        d = min(DIGIT, length - depth)
        at = starts[row] + number + depth
        digit = (sums[at + d] - sums[at]) * down[at]
        group = mix(group * _GOLD + mix(digit))
        _, which, count = np.unique(group, return_inverse=True, return_counts=True)
        if weight.max(initial=1) > 1:
            count = np.bincount(which, weights=weight[row])
        stay = count[which] > 1
        row, number, group = row[stay], number[stay], group[stay]
        if not len(row):
            break
    return row, number


def _runs(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((number, row))
    row, number = row[order], number[order]
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)]) if len(row) else np.empty(0, int)
    end = np.r_[cut[1:], len(row)] - 1 if len(row) else cut
    return row[cut], number[cut], number[end]


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key in chunks of whole keys, of about half a piece."""
    held: list[pd.DataFrame] = []
    size = 0
    for part in parts:
        key = part["key"].to_numpy()
        total = np.cumsum(part["ctx"].map(len).to_numpy())
        edges = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(part)]
        at = base = 0
        for e in edges.tolist():
            if e == len(part):
                break  # its key may go on in the next batch
            if size + total[e - 1] - base > PIECE // 2:
                yield pd.concat([*held, part.iloc[at:e]]) if held else part.iloc[at:e]
                held, size, at, base = [], 0, e, total[e - 1]
        if at < len(part):
            rest = part.iloc[at:]
            held.append(rest)
            size += int(total[-1] - base)
    if held:
        yield pd.concat(held)


def _spans(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for g in _chunks(parts):
        row, number = repeated(g["key"].to_numpy(), g["lead"].to_numpy(), g["ctx"].tolist(), np.ones(len(g), np.int64), length)
        r, a, b = _runs(row, number)
        first = g["first"].to_numpy()[r]
        yield pd.DataFrame({"f1": g["f1"].to_numpy()[r], "f2": g["f2"].to_numpy()[r], "start": first + a, "end": first + b + length})


def _hot_spans(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for g in _chunks(parts):
        row, number = repeated(g["key"].to_numpy(), g["lead"].to_numpy(), g["ctx"].tolist(), g["n"].to_numpy(), length)
        r, a, b = _runs(row, number)
        yield pd.DataFrame({"key": g["key"].to_numpy()[r], "lead": g["lead"].to_numpy()[r], "c1": g["c1"].to_numpy()[r], "c2": g["c2"].to_numpy()[r], "a": a, "b": b + length})


def hot_marks(level: DataFrame, length: int) -> DataFrame:
    """(id, a, b): the runs of repeated windows' bytes in the contexts of level (LEVEL).
    Each round finishes the groups of FEW different contexts or less, and halves the
    ranges of the others."""
    out: list[DataFrame] = []
    group = ["key", "near", "far", "lead", "c1", "c2"]
    while True:
        level = level.withColumns({"c1": F.xxhash64("ctx"), "c2": F.hash(F.lit(3), "ctx")})
        distinct = materialize(level.groupBy(*group).agg(F.first("ctx").alias("ctx"), F.sum("n").alias("n")), "contexts")
        sizes = distinct.where("far > near").groupBy("key").agg(F.count(F.lit(1)).alias("contexts"))
        many = materialize(sizes.where(F.col("contexts") > FEW).select("key"), "many")
        few = distinct.join(sized(many), "key", "left_anti")
        marks = few.repartition("key").sortWithinPartitions("key").mapInPandas(lambda p: _hot_spans(p, length), "key bigint, lead int, c1 bigint, c2 int, a bigint, b bigint")
        found = level.select("id", "shift", "key", "lead", "c1", "c2").join(sized(materialize(marks, "marks")), ["key", "lead", "c1", "c2"])
        out.append(found.select("id", (F.col("shift") + F.col("a")).alias("a"), (F.col("shift") + F.col("b")).alias("b")))
        if many.isEmpty():
            return reduce(DataFrame.unionByName, out)
        rest = level.join(sized(many), "key").select(*(c.split()[0] for c in LEVEL.split(", ")))
        level = materialize(rest.mapInPandas(lambda p: _halve(p, length), LEVEL), "halves")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts of docs: doc_id, f1, f2, body, copies; spans by f1, f2: an array of
    (start, end), not merged, where the text's bytes are in a repeated string that also
    starts elsewhere - copies of the same text aside)."""
    ship_package(docs.sparkSession)
    text = text_or_empty()
    keyed = docs.select("doc_id", text.cast("binary").alias("body"), F.xxhash64(text).alias("f1"), F.hash(F.lit(17), text).alias("f2"))
    copies = keyed.where(F.octet_length("body") >= length).groupBy("f1", "f2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("low"), F.count(F.lit(1)).alias("copies"))
    copies = materialize(copies.where("copies > 1").select("f1", "f2", F.col("low.doc_id").alias("low"), "copies"), "copies")
    rows = keyed.join(sized(copies), ["f1", "f2"], "left")
    # of equal texts, those with the smallest id stand for all; more of them do no harm
    one = rows.where("copies is null or doc_id <=> low").where(F.octet_length("body") >= length).select("f1", "f2", "body")

    grams = materialize(one.mapInPandas(lambda p: _grams(p, length), f"{KEY}, ordinal int, gram bigint"), "grams")
    twice = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > HOT).alias("hot")), "repeated")
    found = materialize(grams.join(twice, "gram").groupBy("f1", "f2", "hot").agg(F.collect_list("ordinal").alias("ordinals")), "candidates")
    kinds = {r.hot for r in found.select("hot").distinct().collect()}  # two rows at most

    # Texts are joined to their candidates, and later to their spans, with the smaller side
    # hashed: the texts are shuffled, at every size, but not sorted.
    spans = []
    if False in kinds:
        plain = found.where("not hot").drop("hot")
        c = one.join(plain.hint("shuffle_hash"), ["f1", "f2"]).mapInPandas(lambda p: _contexts(p, length, False), f"{KEY}, key bigint, first bigint, lead int, ctx binary")
        spans.append(c.repartition("key").sortWithinPartitions("key").mapInPandas(lambda p: _spans(p, length), f"{KEY}, start bigint, end bigint").select("f1", "f2", F.array(F.struct("start", "end")).alias("spans")))
    if True in kinds:
        c = one.join(found.where("hot").drop("hot").hint("shuffle_hash"), ["f1", "f2"]).mapInPandas(lambda p: _contexts(p, length, True), f"{KEY}, key bigint, firsts array<bigint>, lead int, near int, far int, ctx binary")
        c = materialize(c.withColumn("id", F.monotonically_increasing_id()), "hot")
        marks = hot_marks(c.select("id", F.lit(0).alias("shift"), "key", "near", "far", "lead", "ctx", F.size("firsts").cast("bigint").alias("n")), length)
        at = F.transform("firsts", lambda x: F.struct((x + F.col("a")).alias("start"), (x + F.col("b")).alias("end")))
        spans.append(c.select("id", "f1", "f2", "firsts").join(marks, "id").select("f1", "f2", at.alias("spans")))
    if spans:
        out = spans[0] if len(spans) == 1 else spans[0].unionByName(spans[1])
    else:
        out = docs.sparkSession.createDataFrame([], f"{KEY}, spans array<struct<start: bigint, end: bigint>>")
    return rows, materialize(out.groupBy("f1", "f2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def _removed(n: int, copies: int | None, spans: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    if copies and n >= length:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans) if spans is not None else ():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    rows, spans = repeated_spans(docs, length)
    joined = rows.select("doc_id", "f1", "f2", "body", "copies").join(spans.hint("shuffle_hash"), ["f1", "f2"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "body", F.coalesce("copies", F.lit(0)).alias("copies"), "spans")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for doc_id, body, copies, found in zip(p["doc_id"], p["body"], p["copies"], p["spans"]):
                body = bytes(body)
                gone = _removed(len(body), copies, found, length)
                edges = [0, *(x for run in gone for x in run), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id, len(body), len(body) - len(kept), len(gone), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInPandas(cut, "doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op3_radix_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
with d as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) h from documents),
b as (select rid, base, substr(h, 2 * base + 1, 1398) h from (select rid, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 500)) base from d) x),
w as (select rid, base + j i, md5_number(substr(h, 2 * j + 1, 400)) k from (select rid, base, h, unnest(range(0, least(500, len(h) // 2 - 199))) j from b) x),
k as (select k from w group by k having count(*) > 1),
r as (select rid, i, case when i <= lag(i) over (partition by rid order by i) + 200 then 0 else 1 end first from w semi join k using (k)),
g as (select rid, i, sum(first) over (partition by rid order by i) run from r),
s as (select rid, run, min(i) a, max(i) + 200 b from g group by rid, run),
p as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) prior from s),
o as (select p.rid, count(*) n, sum(b - a) gone, max(b) last, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' order by a) kept from p join d on p.rid = d.rid group by p.rid)
select doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(gone, 0) as bigint) n_removed, cast(coalesce(n, 0) as bigint) n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) kept_sha256
from d left join o using (rid)
"""
