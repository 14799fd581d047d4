"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Presence of a hashed character n-gram is a feature; its scale is r = log((p / |p|) / (q / |q|)), with p and q the
smoothed numbers of toxic and other documents that hold it. Logistic regression over the scaled features gives the
weights. The counts cover every labelled training row; only the regression is fitted on a sample, whose bound is
`Settings.fit_rows` distinct rows for each class.

A feature counts only if at least `least_documents` training documents hold it and the size of its ratio is at least `least_ratio`;
a corpus with fewer documents, or without any n-gram that tells the classes apart, learns the intercept alone.

Null and empty texts hold no n-gram and get the score of the intercept. Of repeated labels of a document the
largest counts; null labels count as none. With no training rows, or with rows of one class only, every score is the share of toxic
rows (0 without any). Rows with the same doc_id each get a row of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import grams
from quire.llm.shared import held_out, runs, sampled, thrifty


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (4, 5)
    bits: int = 20
    alpha: float = 1.0
    least_documents: int = 3  # a feature is held by so many training documents
    least_ratio: float = 0.7  # and its |r| is at least this
    fit_rows: int = 2000  # expected distinct rows of each class in the regression's sample
    ridge: float = 1e-3
    steps: int = 200
    broadcast_labels: int = 1_000_000  # up to so many label rows (16 bytes each) are broadcast; more are joined by a shuffle


@dataclass(frozen=True)
class Model:
    orders: tuple[int, ...]
    bits: int
    weights: np.ndarray  # of each hashed feature, scale included
    intercept: float


def _present(texts: list[str | None], orders: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of the distinct features of each text, by blocks; a text cut into pieces can give a feature in several."""
    for codes, rows, left in grams.blocks(texts, max(orders)):
        keys = []
        for n in orders:
            at, h = grams.hashed(codes, left, n, bits)
            if wanted is not None:
                keep = wanted[h]
                at, h = at[keep], h[keep]
            keys.append(rows[at] << bits | h)
        key = np.unique(np.concatenate(keys))
        yield key >> bits, key & ((1 << bits) - 1)


def _distinct(texts: list[str | None], orders: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, row, feature) of some texts at a time; row counts from the first. Memory follows a block, or one text's distinct features."""
    for a, b in runs(np.array([len(t or "") for t in texts], np.int64), grams.BLOCK):
        found = [row << bits | f for row, f in _present(texts[a:b], orders, bits, wanted)]
        key = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        yield a, b, key >> bits, key & ((1 << bits) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text, toxic) of the rows that may be learnt from."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if labels.count() <= settings.broadcast_labels:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, "doc_id")


def _feature_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """(feature, toxic documents, other documents) that hold it; feature -1 counts the documents."""
    orders, bits = settings.orders, settings.bits

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros((2, 1 << bits), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            texts, toxic = batch.column("text").to_pylist(), (batch.column("toxic").to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            for a, b, row, feature in _distinct(texts, orders, bits):
                own = toxic[a:b][row]
                for k in (0, 1):
                    np.add.at(totals[k], feature[own == k], 1)
            for k in (0, 1):
                n[k] += int((toxic == k).sum())
        used = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(totals[1][used], n[1]).astype(np.int64)), pa.array(np.append(totals[0][used], n[0]).astype(np.int64))], names=["feature", "toxic", "other"])

    parts = rows.select("text", "toxic").mapInArrow(count, "feature long, toxic long, other long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_count_ratios(rows: DataFrame, settings: Settings) -> tuple[np.ndarray, int, int]:
    """r of each hashed feature (0: not used), and the numbers of toxic and other rows. What the driver gets is bounded by 2 ** bits."""
    counts = _feature_counts(rows, settings).where((F.col("toxic") + F.col("other") >= settings.least_documents) | (F.col("feature") < 0)).toPandas()
    total = counts[counts.feature < 0]
    n = [int(total[k].sum()) for k in ("toxic", "other")]
    counts = counts[counts.feature >= 0]
    p, q = (np.log((counts[k].to_numpy() + settings.alpha) / (m + 2 * settings.alpha)) for k, m in zip(("toxic", "other"), n, strict=True))
    r = np.zeros(1 << settings.bits, np.float32)
    r[counts.feature.to_numpy()] = np.where(np.abs(p - q) >= settings.least_ratio, p - q, 0)
    return r, *n


def _regression(row: np.ndarray, feature: np.ndarray, x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps: (features, weights, intercept). Classes weigh the same."""
    names, column = np.unique(feature, return_inverse=True)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(len(names)), 0.0
    v, c = w.copy(), b
    squares = np.bincount(row, x * x, len(y)) + 1
    step = 1 / (0.25 * float((weight * squares).sum()) + ridge)
    for k in range(steps):
        margin = np.bincount(row, x * v[column], len(y)) + c
        slope = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        w2, b2 = v - step * (np.bincount(column, x * slope[row], len(names)) + ridge * v), c - step * float(slope.sum())
        ahead = k / (k + 3)
        v, c = w2 + ahead * (w2 - w), b2 + ahead * (b2 - b)
        w, b = w2, b2
    return names, w, b


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows of docs that are not held out."""
    rows = training_rows(docs, labels, settings)
    r, toxic, other = log_count_ratios(rows, settings)
    size = 1 << settings.bits
    if not toxic or not other:
        share = min(max(toxic / max(1, toxic + other), 1e-9), 1 - 1e-9)
        return Model(settings.orders, settings.bits, np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    sample = sampled(rows.select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic")), "toxic", settings.fit_rows, 2)
    ratio, orders, bits, ridge, steps = docs.sparkSession.sparkContext.broadcast(r), settings.orders, settings.bits, settings.ridge, settings.steps

    @thrifty
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b, row, feature in _distinct(texts, orders, bits, ratio.value != 0):
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a).cast(pa.int32()), lists], names=["toxic", "features"])

    def regress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        y = np.concatenate([b.column("toxic").to_numpy() > 0 for b in kept] or [np.empty(0, bool)]).astype(float)
        lists = [b.column("features") for b in kept]
        row = np.repeat(np.arange(len(y)), np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists] or [np.empty(0, np.int64)]))
        feature = np.concatenate([x.flatten().to_numpy() for x in lists] or [np.empty(0, np.int64)])
        names, w, b = _regression(row, feature, ratio.value[feature].astype(float), y, ridge, steps)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(names, -1).astype(np.int64)), pa.array(np.append(w, b))], names=["feature", "weight"])

    # One task sees the features of the sample, 2 x fit_rows rows of at most 2 ** bits features, never of the corpus.
    found = sample.select("text", "toxic").mapInArrow(features, "toxic int, features array<int>").repartition(1).mapInArrow(regress, "feature long, weight double").toPandas()
    weights, learnt = np.zeros(size, np.float32), found[found.feature >= 0]
    at = learnt.feature.to_numpy()
    weights[at] = learnt.weight.to_numpy() * r[at]
    return Model(settings.orders, settings.bits, weights, float(found.weight[found.feature < 0].sum()))


def scorer(model: Model, spark) -> "callable":
    """A column function from text to its score."""
    held = spark.sparkContext.broadcast((model.weights, model.intercept))
    orders, bits = model.orders, model.bits

    @F.arrow_udf("double")
    @thrifty
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, intercept = held.value
        used = weights != 0
        for part in parts:
            margin = np.full(len(part), intercept)
            for a, b, row, feature in _distinct(part.to_pylist(), orders, bits, used):
                margin[a:b] += np.bincount(row, weights[feature], b - a)
            yield pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    score: Column = scorer(model, docs.sparkSession)(F.col("text"))
    return docs.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is below 0.5, with the columns of docs."""
    return docs.where(scorer(model, docs.sparkSession)(F.col("text")) < 0.5)
