"""Language ID: nearest of several clustered centroids per language, over normalised TF-IDF character n-gram vectors.

A text becomes a vector of hashed character n-grams of orders 1 to 3, weighted log(1 + tf) * idf and scaled to length
1; idf comes from all training rows. The vectors of a bounded sample of each language (`Settings.fit_rows` expected
distinct rows) are clustered by spherical k-means. A text gets the language of the centroid with the largest cosine, and is
rejected when it is too far from it: below `floor * min(1, sqrt(n_chars / 200))`, the floor being a share of a low
quantile of the cosines that the language's own sample had. Clusters of less than `Settings.least_share` of the sample
are outliers and give no centroid, so a few junk rows neither lower the floor nor attract their like.

A null text, or one without a letter, is `und` with score 0 and rejected. Texts of any length count whole. With no
training rows all texts are `und`. Ties between centroids go to the first in (language, cluster) order. Rows with the
same doc_id each get a row of their own; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import grams
from quire.llm.shared import held_out, sampled, thrifty

UNKNOWN = "und"
_LATIN = re.compile("[A-Za-z]")
_ROWS = 256  # rows of a dense block


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 12
    centroids: int = 4
    fit_rows: int = 1000  # expected distinct rows of each language in the sample that is clustered
    rounds: int = 12
    least_share: float = 0.02  # of the sample's rows in a cluster that counts
    quantile: float = 0.01  # of the sample's cosines, from which the floor is taken
    slack: float = 0.7  # of that quantile
    full_chars: int = 200  # shorter texts may lie farther off
    broadcast_languages: int = 10_000  # the sizes of up to so many languages are broadcast; more are joined by a shuffle


@dataclass(frozen=True)
class Model:
    settings: Settings
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray


def _has_letter(text: str) -> bool:
    """Whether a character is a letter, of the categories L; numbers that look like letters are none."""
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def _counts(texts: list[str | None], settings: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, n-gram counts of up to _ROWS texts)."""
    size = 1 << settings.bits
    for first in range(0, len(texts), _ROWS):
        some = texts[first : first + _ROWS]
        tf = np.zeros(len(some) * size, np.float32)
        for codes, rows, left in grams.blocks(some, max(settings.orders)):
            for n in settings.orders:
                at, h = grams.hashed(codes, left, n, settings.bits)
                key = rows[at] * size + h
                if len(key):
                    low = int(key.min())
                    part = np.bincount(key - low)
                    tf[low : low + len(part)] += part
        yield first, tf.reshape(len(some), size)


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _idf(rows: DataFrame, settings: Settings) -> np.ndarray:
    """Over all rows; the driver gets one number for each of the 2 ** bits features."""

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << settings.bits, np.int64), 0
        for batch in batches:
            for _, tf in _counts(batch.column(0).to_pylist(), settings):
                df += (tf > 0).sum(axis=0)
                n += len(tf)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(df)), -1)), pa.array(np.append(df, n))], names=["feature", "n"])

    got = rows.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << settings.bits)
    known = got.feature.to_numpy() >= 0
    df[got.feature[known].to_numpy()] = got.n[known].to_numpy()
    return (np.log((1 + int(got.n[~known].sum())) / (1 + df)) + 1).astype(np.float32)


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; each next first centroid is the vector farthest from those before."""
    centres = x.mean(axis=0, keepdims=True)
    near = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres = np.vstack([centres, x[near.argmin()]])
        near = np.maximum(near, x @ centres[-1])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.vstack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the rows of docs that have a lang and a text and are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    idf = _idf(rows, settings)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text"])
        x = np.vstack([_vectors(tf, shared.value) for _, tf in _counts(part.text.tolist(), settings)])
        centres = _clusters(x, settings.centroids, settings.rounds)
        filled = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
        centres = centres[filled >= min(settings.least_share * len(x), filled.max())]
        long = (part.text.str.len() >= settings.full_chars).to_numpy()
        near = (x @ centres.T).max(axis=1)
        floor = settings.slack * float(np.quantile(near[long] if long.any() else near, settings.quantile))
        return pd.DataFrame({"lang": part.lang.iloc[0], "cluster": range(len(centres)), "centroid": list(centres.astype(np.float32)), "floor": floor})

    sample = sampled(rows, "lang", settings.fit_rows, settings.broadcast_languages)
    found = sample.select("doc_id", "lang", "text").groupBy("lang").applyInPandas(cluster, "lang string, cluster int, centroid array<float>, floor double").toPandas().sort_values(["lang", "cluster"])
    size = 1 << settings.bits
    return Model(settings, idf, found.lang.tolist(), np.vstack([*found.centroid, np.empty((0, size), np.float32)]).astype(np.float32), found.floor.to_numpy(float))


def predictor(model: Model, spark) -> Callable[[Column], Column]:
    """A column function from text to struct<lang, score, rejected>."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    @thrifty
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for part in parts:
            texts = part.to_pylist()
            best, score = np.full(len(texts), len(m.languages)), np.zeros(len(texts))
            if m.languages:
                for first, tf in _counts(texts, m.settings):
                    near = _vectors(tf, m.idf) @ m.centroids.T
                    best[first : first + len(near)], score[first : first + len(near)] = near.argmax(axis=1), near.max(axis=1)
            blank = np.array([not t or not _has_letter(t) for t in texts], bool)
            best[blank], score[blank] = len(m.languages), 0.0
            score = np.clip(score, 0, 1)
            length = np.array([len(t or "") for t in texts])
            floor = np.append(m.floors, 2.0)[best] * np.minimum(1, np.sqrt(length / m.settings.full_chars))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array((score < floor) | (best == len(m.languages)))], names=["lang", "score", "rejected"])

    return predict


def predict_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs."""
    guess = predictor(model, docs.sparkSession)(F.col("text"))
    out = docs.select("doc_id", held_out().alias("held_out"), guess.alias("guess"))
    return out.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"), F.col("guess.rejected").alias("rejected"))


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs."""
    return docs.where(~predictor(model, docs.sparkSession)(F.col("text"))["rejected"])
