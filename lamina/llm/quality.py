"""Quality classifier: naive Bayes support vectors.

Features are indicators of token n-grams (unigrams and bigrams), hashed to 2**BITS
buckets. A token is a run of letters and digits, or a run of other visible characters;
case counts. Each indicator is scaled by its class log-count ratio
``log((p / |p|) / (q / |q|))`` and a linear L2-regularised hinge-loss model is fitted
on the scaled indicators by dual coordinate descent; its weights are interpolated
with their mean size, and the margin goes through a logistic function.

The classifier is fitted on at most ``max_train`` labelled rows (those with the
smallest hash of their id, not the first ones); scoring reads every whole text.
One task fits on those rows' hashed features; what reaches the driver and is broadcast
is the model, two vectors of 2**BITS floats, whatever the input's size. Texts are worked on in
bounded pieces, so memory is bounded by the longest text's tokens.

Defined results: null text counts as empty; an empty text gets the bias alone;
labels that are null, contradictory or without a document are not used; without
both classes in the training rows every score is the share of label 1 in them (0.5
without any); equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, text_or_empty
from .tokens import token_hashes

BITS = 20
MAX_TRAIN = 6000

_MUL = 0x9E3779B97F4A7C15


def features(data: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers of a text: its unigrams and bigrams."""
    t = token_hashes(data)
    both = np.concatenate([t, (t[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + t[1:]) ^ np.uint64(0x5851F42D)]) if len(t) else t
    mixed = (both ^ (both >> np.uint64(29))) * np.uint64(_MUL)
    return np.unique((mixed >> np.uint64(64 - bits)).astype(np.int32))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0) -> np.ndarray:
    """Class log-count ratio of every feature from document frequencies."""
    counts = []
    for y in (1, 0):
        own = [r for r, label in zip(rows, labels) if label == y]
        counts.append(alpha + np.bincount(np.concatenate(own), minlength=1 << bits).astype(np.float64))
    p, q = counts
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, c: float = 2.0, epochs: int = 15, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM over the scaled indicators: one dual
    variable in [0, C_i] a row, updated in turn by its exact one-variable minimum. C is
    weighted by class, so that the rarer one counts as much."""
    y = np.where(labels == 1, 1.0, -1.0)
    top = c * np.where(labels == 1, len(y) / (2 * max(1, (labels == 1).sum())), len(y) / (2 * max(1, (labels == 0).sum())))
    scale = np.array([1 / max(1e-9, np.sqrt((ratio[r] ** 2).sum())) for r in rows])
    values = [ratio[r] * s for r, s in zip(rows, scale)]
    square = np.array([(v * v).sum() + 1.0 for v in values])
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            r, v = rows[i], values[i]
            new = min(max(dual[i] - (y[i] * (w[r] @ v + bias) - 1) / square[i], 0.0), top[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[r] += step * v
                bias += step
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, beta: float = 0.25) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared ratios, weights on the plain indicators, bias). The margin of a text
    is bias + sum(weights) / sqrt(sum(squared ratios)) over its features."""
    if len(set(labels.tolist())) < 2:
        share = min(max(float(np.mean(labels)) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share)))
    ratio = log_count_ratios(rows, labels, bits)
    w, bias = dual_coordinate_descent(rows, ratio, labels)
    used = w != 0
    w[used] = (1 - beta) * w[used] + beta * np.abs(w[used]).mean() * np.sign(w[used])
    return (ratio**2).astype(np.float32), (ratio * w).astype(np.float32), float(bias)


def margin(f: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> float:
    squares, weights, bias = model
    if not len(f):
        return bias
    norm = float(squares[f].sum(dtype=np.float64)) ** 0.5
    return bias + float(weights[f].sum(dtype=np.float64)) / norm if norm > 0 else bias


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(quality, features) of at most max_train labelled documents that aren't held out."""
    ship_package(docs.sparkSession)
    usable = labels.where("quality in (0, 1) and doc_id is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select("doc_id", "quality")
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id")
    # of rows that repeat an id, the text with the least hash is taken: max_train bounds the rows
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("quality", "text")

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"quality": p["quality"], "f": [features(t.encode()).tobytes() for t in p["text"]]})

    return rows.mapInPandas(extract, "quality int, f binary")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of fit, from rows in an order of their own."""

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted((int(y), bytes(f)) for p in parts for y, f in zip(p["quality"], p["f"]))
        squares, weights, bias = fit([np.frombuffer(f, dtype=np.int32) for _, f in got], np.array([y for y, _ in got], dtype=np.int64))
        yield pd.DataFrame({"squares": [squares.tobytes()], "weights": [weights.tobytes()], "bias": [bias]})

    r = training_rows(docs, labels, max_train).repartition(1).mapInPandas(one, "squares binary, weights binary, bias double").first()
    return np.frombuffer(r.squares, np.float32), np.frombuffer(r.weights, np.float32), float(r.bias)


def scorer(model: tuple[np.ndarray, np.ndarray, float]) -> Callable[[pd.Series], pd.Series]:
    def score(texts: pd.Series) -> pd.Series:
        m = np.array([margin(features(t.encode()), model) for t in texts])
        return pd.Series(1 / (1 + np.exp(-2 * np.clip(m, -30, 30))))

    return score


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "score") -> DataFrame:
    """docs with a score column, 0 to 1."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return scorer(shared.value)(texts)

    return docs.withColumn(name, score(text_or_empty()))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose score is at least ``least``."""
    name = "score_"
    while name in docs.columns:
        name += "_"
    return score_documents(docs, train(docs, labels), name).where(F.col(name) >= least).drop(name)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
    scored = score_documents(docs, model).select("doc_id", held.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
