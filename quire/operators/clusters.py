"""Exact nearest vectors by cosine with whole clusters passed over.

Vectors are dealt to the nearest of some centroids, fitted on a bounded sample; a cluster's radius is its largest angle to
its centroid. By the triangle inequality no member of a cluster lies nearer to a query than their angle less the radius. Each
query first meets the clusters that lie nearest and hold enough vectors, which gives its running kth score; then only
those whose bound reaches it. The rows are those of `retrieval.cosine_top`.

A cluster is dealt into parts of bounded size, by a hash, so that one with very many vectors, equal ones too, is many tasks' work. A task
holds a part and streams the queries past it; neither queries nor vectors pass through the driver, which gets the sample
(at most SAMPLE_OF * MOST_CENTROIDS vectors) and a count and a radius for each cluster.

Vectors that are null, empty or zero, or hold null or NaN components, are left out; vectors only meet those of their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.retrieval import LEAST, _nearest, _unit, usable
from quire.sources.documents import kept

MOST_CENTROIDS, SAMPLE_OF, ROUNDS = 1024, 16, 8
PART_ROWS = 8192
_SLACK = 1e-7  # of angles


@dataclass(frozen=True)
class Clusters:
    """For each length of vectors: centroids, and radius, number of vectors and number of parts of each."""

    centroids: dict[int, np.ndarray]
    radius: dict[int, np.ndarray]
    count: dict[int, np.ndarray]
    parts: dict[int, np.ndarray]


def _fitted(vectors: DataFrame) -> dict[int, np.ndarray]:
    wanted = min(MOST_CENTROIDS, max(1, math.isqrt(vectors.count())))
    sample = vectors.orderBy(F.xxhash64("embedding"), "id").select("embedding").limit(SAMPLE_OF * wanted).toArrow()
    out = {}
    sizes = sample.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(sample) else np.empty(0, int)
    for size in np.unique(sizes).tolist():
        x = _unit(sample.take(pa.array(np.flatnonzero(sizes == size))).column("embedding"))
        # The first ones far apart from each other, then the mean directions of what lies nearest.
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(wanted, len(x)) and near.min() < 1 - 1e-9:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        centres = x[chosen]
        for _ in range(ROUNDS):
            own = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
        out[size] = centres
    return out


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors) of a batch."""
    lists = batch.column("embedding")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, _unit(pa.chunked_array([lists.take(pa.array(at))]))


def _angle(near: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(near, -1.0, 1.0))


def _dealt(vectors: DataFrame) -> tuple[DataFrame, Clusters]:
    """id, embedding, size, cluster, part; and the clusters. A length that the sample lacks is one cluster around a first axis."""
    centroids = _fitted(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _by_size(batch):
                near = x @ shared.value.get(size, np.eye(1, size)).T
                own = near.argmax(axis=1)
                angle = _angle(near[np.arange(len(own)), own])
                rows = batch.take(pa.array(at))
                columns = [rows.column("id"), rows.column("embedding"), pa.array(np.full(len(at), size, np.int32)), pa.array(own.astype(np.int32)), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "embedding", "size", "cluster", "angle"])

    own = kept(vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(nearest, "id long, embedding array<double>, size int, cluster int, angle double"), "clustered")
    told = own.groupBy("size", "cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    radius, count = {}, {}
    for size in {r["size"] for r in told}:
        n = len(centroids.get(size, np.eye(1, size)))
        radius[size], count[size] = np.zeros(n), np.zeros(n, np.int64)
        for r in told:
            if r["size"] == size:
                radius[size][r["cluster"]], count[size][r["cluster"]] = r["radius"], r["n"]
    return own.drop("angle"), Clusters({s: centroids.get(s, np.eye(1, s)) for s in radius}, radius, count, {s: -(-n // PART_ROWS) for s, n in count.items()})


def _reach(queries: DataFrame, clusters: Clusters, most: int, again: bool) -> DataFrame:
    """query_id, embedding, least, size, cluster, part of the parts that each query (query_id, embedding, least) is held against.

    First the nearest clusters until they hold `most` vectors; again: all others whose bound reaches `least`.
    """
    shared = queries.sparkSession.sparkContext.broadcast(clusters)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for size, at, x in _by_size(batch):
                if size not in c.centroids:
                    continue
                bound = np.maximum(_angle(x @ c.centroids[size].T) - c.radius[size], 0.0)
                bound[:, c.count[size] == 0] = np.inf
                order = np.argsort(bound, axis=1, kind="stable")
                held = np.cumsum(c.count[size][order], axis=1)
                first = np.zeros_like(bound, bool)
                np.put_along_axis(first, order, np.hstack([np.ones((len(at), 1), bool), held[:, :-1] < most]), axis=1)
                least = batch.column("least").to_numpy()[at]
                wanted = (~first if again else first) & np.isfinite(bound)
                if again:
                    wanted &= np.cos(np.minimum(bound, math.pi)) + _SLACK >= least[:, None]
                q, k = np.nonzero(wanted)
                parts = c.parts[size][k]
                q, k, part = np.repeat(q, parts), np.repeat(k, parts), np.concatenate([np.arange(n) for n in parts]) if len(parts) else np.empty(0, int)
                for a in range(0, len(q), 4096):
                    here = slice(a, a + 4096)
                    rows = batch.take(pa.array(at[q[here]]))
                    columns = [rows.column(n) for n in ("query_id", "embedding", "least")]
                    columns += [pa.array(np.full(len(rows), size, np.int32)), pa.array(k[here].astype(np.int32)), pa.array(part[here].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "embedding", "least", "size", "cluster", "part"])

    return queries.mapInArrow(reach, "query_id long, embedding array<double>, least double, size int, cluster int, part int")


def _met(asked: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """query_id, id, score: the best of each part for each of its queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, x = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("size", "cluster", "part", "side")], axis=1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                rows = batch.slice(a, b - a)
                if tuple(keys[a, :3]) != key:
                    key, held, x = tuple(keys[a, :3]), [], None
                if keys[a, 3] == 0:
                    held.append(rows)
                    continue
                if x is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held)
                    ids, x = table.column("id").to_numpy(), _unit(table.column("embedding"))
                least = rows.column("least").to_numpy()
                y = _unit(pa.chunked_array([rows.column("embedding")]))
                for c in range(0, len(y), 256):
                    score, name = _nearest(np.round(y[c : c + 256] @ x.T, 9), ids, most)
                    fit = (score > LEAST) & (score >= least[c : c + 256, None] - _SLACK)
                    q = np.broadcast_to(rows.column("id").to_numpy()[c : c + 256, None], score.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(q[fit]), pa.array(name[fit]), pa.array(score[fit])], names=["query_id", "id", "score"])

    sides = [
        vectors.select("size", "cluster", "part", F.lit(0).alias("side"), "id", F.lit(0.0).alias("least"), "embedding"),
        asked.select("size", "cluster", "part", F.lit(1).alias("side"), F.col("query_id").alias("id"), "least", "embedding"),
    ]
    both = sides[0].unionByName(sides[1]).repartition("size", "cluster", "part").sortWithinPartitions("size", "cluster", "part", "side")
    return both.mapInArrow(search, "query_id long, id long, score double")


def nearest(queries: DataFrame, vectors: DataFrame, most: int = 5) -> tuple[DataFrame, int]:
    """query_id, id, score, rank: the nearest vectors (id, embedding) of each query (query_id, embedding), and how many pairs were compared.

    Scores of 0.1 or less don't count, ties go to the larger id. A query_id names one query.
    """
    own, clusters = _dealt(vectors.where(usable()).select("id", "embedding"))
    spark = vectors.sparkSession
    parts = spark.createDataFrame([(int(s), k, int(n)) for s in clusters.parts for k, n in enumerate(clusters.parts[s])], "size int, cluster int, parts int")
    own = kept(own.join(F.broadcast(parts), ["size", "cluster"]).withColumn("part", F.pmod(F.xxhash64("id", "embedding"), F.col("parts")).cast("int")).drop("parts"), "parts")
    sizes = own.groupBy("size", "cluster", "part").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id")))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= most)
    asked = kept(queries.where(usable()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(LEAST).alias("least")), "queries")
    first = kept(_reach(asked, clusters, most, False), "first")
    found = kept(best(_met(first, own, most)), "found")
    kth = found.where(F.col("rank") == most).select("query_id", F.col("score").alias("kth"))
    later = asked.join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce("kth", "least").alias("least"))
    again = kept(_reach(later, clusters, most, True), "again")
    pairs = first.unionByName(again).join(sizes, ["size", "cluster", "part"]).agg(F.sum("n").alias("n")).first()["n"]
    return best(found.drop("rank").unionByName(_met(again, own, most))), int(pairs or 0)
