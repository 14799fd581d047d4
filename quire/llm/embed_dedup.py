"""Embedding near-dedup through a pivot-permutation index.

Each vector is described by a permutation: its `nearest` first pivots, reference points drawn from the vectors themselves,
in the order of their closeness. The description is made of centred vectors, from which the mean direction of the sample is taken, so that
it tells vectors apart that all have one direction in common. The inverted lists hold, for each two pivots, the vectors that have both among their
first (the part that the two pivots' own lists share): vectors with a shared-pivot count of at least two meet in a list,
and whatever shares less is never retrieved. Where `least_shared` is larger, shared pivots are counted before anything else is done for a pair.
Every pair that is retrieved is verified, by the cosine of the vectors as they are, in double precision; none that passes is dropped.

Pivots and mean are fitted on a bounded sample (`sample_of` times as many vectors, in the order of a hash); every vector
is indexed. The number of pivots grows with the square root of the number of vectors, up to `most_pivots` and `most_pivot_bytes`
(beyond that lists grow with the table); near copies of a pivot give no other. `nearest` is fitted, too: partners are planted beside vectors
of the sample, at cosines from the threshold to 0.99, and it is the smallest number up to `most_nearest` with which
`recall` of them are retrieved. With under three pivots, as in a table of near copies alone, there is a single list.

Equal vectors are one class, compared once. Lists are dealt into blocks, each pair of rows of a list meets once, and a
pair of classes counts only in the list of the first two pivots that it shares; tasks return sums and spanning links, never all pairs.

Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing. Vectors of
different lengths never link. Rows with the same vec_id are rows of their own. Columns other than vec_id and embedding
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.buckets import forest, in_blocks, pairs_by_lag, whole_groups
from quire.llm.components import components
from quire.llm.shared import thrifty, written


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    nearest: int = 6  # at least
    most_nearest: int = 12
    recall: float = 0.95  # of planted partners
    least_shared: int = 2
    pivots_of_root: float = 9.0  # pivots for the square root of the number of classes
    least_pivots: int = 64
    most_pivots: int = 32_768
    most_pivot_bytes: int = 64 << 20
    sample_of: int = 2
    apart: float = 0.9  # cosine of centred vectors below which a vector is a pivot of its own
    block: int = 512


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _padded(column: pa.Array, fill: np.ndarray | None = None) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled up on the right with 0 or with their row's value of `fill`."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype) if fill is None else np.repeat(fill[:, None], width, axis=1)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a batch of lists."""
    x = _padded(column).astype(np.float64)
    if not len(x):
        return x
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Pivots:
    """Of one length of vectors: the mean direction, the pivots (centred), and how many describe a vector."""

    mean: np.ndarray
    points: np.ndarray
    nearest: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        z = x - self.mean
        return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)

    def near(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        return np.argsort(-(self.centred(x) @ self.points.T), axis=1, kind="stable")[:, : k or self.nearest].astype(np.int32)


def _planted(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of x a vector at a cosine between the threshold and 0.99, in a direction drawn with a fixed seed."""
    draw = np.random.default_rng(5)
    noise = draw.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-12)
    c = draw.uniform(threshold, max(threshold, 0.99), len(x))[:, None]
    return c * x + np.sqrt(1 - c * c) * noise


def _fitted(x: np.ndarray, wanted: int, s: Settings) -> Pivots:
    """From a sample of unit vectors, taken in their order."""
    plain = Pivots(x.mean(axis=0), np.empty((0, x.shape[1])), s.nearest)
    z = plain.centred(x)
    picked = np.empty(wanted, np.int64)
    n = 0
    for first in range(0, len(x), 512):
        part = np.arange(first, min(first + 512, len(x)))
        if n == wanted:
            break
        alike = ((z[part] @ z[picked[:n]].T >= s.apart) | (x[part] @ x[picked[:n]].T >= s.threshold)).any(axis=1)
        among = (z[part] @ z[part].T >= s.apart) | (x[part] @ x[part].T >= s.threshold)
        own: list[int] = []
        for i in np.flatnonzero(~alike).tolist():
            if n + len(own) < wanted and not among[i, own].any():
                own.append(i)
        picked[n : n + len(own)] = part[own]
        n += len(own)
    points = z[picked[:n]]
    some = x[:: max(1, len(x) // 1000)]
    a, b = (Pivots(plain.mean, points, 0).near(v, s.most_nearest) for v in (some, _planted(some, s.threshold)))
    nearest = s.nearest
    while nearest < min(s.most_nearest, n):
        shared = (a[:, :nearest, None] == b[:, None, :nearest]).sum(axis=(1, 2))
        if (shared >= max(2, s.least_shared)).mean() >= s.recall:
            break
        nearest += 1
    return Pivots(plain.mean, points, nearest)


def _pivots(classes: DataFrame, n: int, s: Settings) -> dict[int, Pivots]:
    """For each length of vectors; the driver gets at most sample_of times as many vectors as there are pivots."""
    longest = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    wanted = int(min(max(s.pivots_of_root * math.sqrt(n), s.least_pivots), s.most_pivots, max(s.least_pivots, s.most_pivot_bytes // (8 * longest))))
    rows = classes.orderBy("h1", "h2").select(F.col("embedding").cast("array<double>").alias("embedding")).limit(s.sample_of * wanted).toArrow().column("embedding").combine_chunks()
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False) if len(rows) else np.empty(0, int)
    return {size: _fitted(_matrix(rows.take(pa.array(np.flatnonzero(sizes == size)))), wanted, s) for size in np.unique(sizes).tolist()}


def _permutations(classes: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """cid, near: the first pivots of each class, the nearest first; and keys: the lists that it is in."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    @thrifty
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column("embedding"), batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                at, p = pa.array(np.flatnonzero(sizes == size)), shared.value.get(size)
                x = _matrix(lists.take(at))
                if p is None or min(p.nearest, len(p.points)) < 3:  # too few to tell vectors apart: one list
                    near, keys = np.empty((len(x), 0), np.int32), np.full((len(x), 1), -size, np.int64)
                else:
                    near = p.near(x)
                    first = np.sort(near, axis=1).astype(np.int64)
                    keys = np.stack([_list_of(first[:, i], first[:, j], size) for i, j in combinations(range(near.shape[1]), 2)], axis=1)
                out = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in (near, keys)]
                yield pa.RecordBatch.from_arrays([batch.column("cid").take(at), *out], names=["cid", "near", "keys"])

    return classes.select("cid", "embedding").mapInArrow(describe, "cid long, near array<int>, keys array<long>")


def _list_of(a: np.ndarray, b: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """The list of two pivots, a < b, of vectors of a size."""
    return (size << 40) + (a << 20) + b


def _shared(near: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of permutations: how many pivots they share; the list of the first two of these (without the size)."""
    same = near[i][:, :, None] == near[j][:, None, :]
    pivots = np.sort(np.where(same.any(axis=2), near[i], np.iinfo(np.int32).max), axis=1).astype(np.int64)
    return same.sum(axis=(1, 2)), _list_of(pivots[:, 0], pivots[:, 1], 0)


def _counts(near: np.ndarray) -> np.ndarray:
    """How many pivots each two rows share."""
    known, at = np.unique(near, return_inverse=True)
    held = np.zeros((len(near), len(known)), np.float32)
    held[np.repeat(np.arange(len(near)), near.shape[1]), at.ravel()] = 1
    return held @ held.T


def _verify(s: Settings):
    @thrifty
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["key", "block_x", "block_y"], 5000):
            key, cid, copies = (table.column(c).to_numpy() for c in ("key", "cid", "copies"))
            own, block_x, block_y = (table.column(c).to_numpy() for c in ("block", "block_x", "block_y"))
            # Vectors of another length may have fewer pivots; what fills them up differs from row to row.
            near = _padded(table.column("near").combine_chunks(), -1 - np.arange(len(table), dtype=np.int32))
            x, sizes = _matrix(table.column("embedding").combine_chunks()), np.bincount(group)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            counted = near.shape[1] and s.least_shared > 2  # all rows of a list share two
            for g in np.flatnonzero(sizes > 32).tolist():  # a product of matrices leaves few pairs to look at
                first, n = int(np.searchsorted(group, g)), int(sizes[g])
                own_rows = slice(first, first + n)
                pick = np.triu(_counts(near[own_rows]) >= s.least_shared if counted else np.ones((n, n), bool), 1)
                i, j = np.nonzero(pick & (x[own_rows] @ x[own_rows].T >= s.threshold - 1e-9)) if pick.any() else (np.empty(0, int),) * 2
                pairs.append((i + first, j + first))
            small = np.flatnonzero(sizes[group] <= 32)
            pairs += [(small[i], small[j]) for i, j in pairs_by_lag(group[small])]
            links, root = np.zeros(len(table), np.int64), np.arange(len(table))
            for i, j in ((i[a : a + 50_000], j[a : a + 50_000]) for i, j in pairs for a in range(0, len(i), 50_000)):
                # Rows of one block meet in the tasks of other blocks too; they count where both blocks are theirs.
                ok = ((own[i] != own[j]) | (block_x[i] == block_y[i])) & (cid[i] != cid[j])
                i, j = i[ok], j[ok]
                if near.shape[1]:
                    count, first_list = _shared(near, i, j)
                    ok = ((count >= s.least_shared) & (first_list == key[i] & ((1 << 40) - 1))) | (key[i] < 0)
                    i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= s.threshold
                i, j = i[ok], j[ok]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                root = forest(len(table), root[i], root[j])[root]
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[root[at]]), pa.array(links[at])], names=["a", "b", "links"])

    return verify


def list_pairs(permutations: DataFrame) -> int:
    """How many pairs meet in the lists, those that meet in several as often."""
    n = permutations.select(F.explode("keys").alias("key")).groupBy("key").count()
    return int(n.agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).first()[0] or 0)


def indexed(classes: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, dict[int, Pivots]]:
    """The permutations of classes (cid, h1, h2, embedding), and the pivots they are made of."""
    pivots = _pivots(classes, classes.count(), settings)
    return written(_permutations(classes, pivots), "permutations"), pivots


def find_groups(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors."""
    e = F.col("embedding")
    # Two hashes, of the vector and of its reverse, name an exact class.
    h = lambda x: F.when(usable(e), F.xxhash64(x))
    rows = vectors.select("vec_id", h(e).alias("h1"), h(F.reverse(e)).alias("h2"), "embedding")
    known = rows.where(F.col("h1").isNotNull()).groupBy("h1", "h2")
    classes = known.agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    permutations, _ = indexed(classes, settings)
    members = permutations.select(F.explode("keys").alias("key"), "cid")
    attach = classes.select("cid", "copies", "embedding").join(permutations.select("cid", "near"), "cid")
    met = in_blocks(members, "key", "cid", settings.block, attach)
    met = met.select("key", "block_x", "block_y", "block", "cid", "copies", "near", "embedding").mapInArrow(_verify(settings), "a long, b long, links long")
    met = written(met, "links")
    roots = components(met.select("a", "b")).withColumnRenamed("v", "cid")
    linked = met.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    info = classes.select("cid", "h1", "h2", "first_id", "copies").join(linked, "cid", "left").join(roots, "cid", "left")
    info = written(info.select("h1", "h2", "first_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")), "classes")
    info = info.join(info.groupBy("root").agg(F.min("first_id").alias("smallest")), "root").select("h1", "h2", (F.col("links") + F.col("copies") - 1).alias("n"), "smallest")
    out = rows.drop("embedding").join(info, ["h1", "h2"], "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
