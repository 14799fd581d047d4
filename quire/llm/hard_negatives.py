"""Hard-negative mining by a norm-bucketed search.

A row's score for an anchor is the inner product of their vectors of whole numbers, floor(scale * x). An anchor's
positives are its best other rows of its label; for each of them the best rows of other labels are taken whose score lies
in a window of shares of the positive's score.

Candidates are sorted by norm, the longest first, and cut into ranges, a range into buckets. By Cauchy-Schwarz no row of a
bucket scores more than |anchor| times the bucket's largest norm, so a bucket is passed over where that is less than
what a window still asks for: its lower limit, or its running kth score. Ranges are searched in waves, few at first; a wave starts
from the kth scores that the waves before it left, and anchors that nothing in a range can serve aren't sent to it. Within a range a
task holds a block of anchors and streams the buckets past it, so its memory follows neither the number of anchors nor
that of candidates. The driver gets counts and one norm for each of at most `most_ranges` ranges.

Results are exact. Scores compare as whole numbers; components are clipped to 62 bits and scores to the range of a long. Ties go to the smaller
vec_id, a null one counting as the largest. A row whose label or vector is null, or that holds a null or non-finite
component, takes no part; a vector only meets vectors of its length; rows of the anchor's own vec_id aren't others. Rows
that repeat a vec_id are rows of their own: as candidates each takes a place, as anchors each gets its results. Columns other than vec_id,
label and embedding are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import thrifty, written

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_LONGEST = 2.0**62  # of a component, once scaled
_SLACK = 1 + 1e-9  # norms are rounded
_CELLS = 1 << 19  # scores that are looked at together


@dataclass(frozen=True)
class Settings:
    scale: float = 256.0
    positives: int = 5
    negatives: int = 10
    low: int = 30  # percent of the positive's score
    high: int = 90
    bucket: int = 512  # candidates that are passed over together
    range_rows: int = 8192  # candidates of a range, while there are at most most_ranges
    most_ranges: int = 4096
    anchor_rows: int = 16_384  # anchors that a task holds, at most about so many
    growth: int = 8  # times as many ranges in a wave as in the one before


def usable(label: Column, embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & ~bad, F.lit(False))


def _whole(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, q (whole numbers, as doubles), norm."""

    @thrifty
    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            q = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)), -_LONGEST, _LONGEST)
            ends, norm = np.append(0, np.cumsum(sizes)), np.zeros(len(sizes))
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                x = q[ends[at][:, None] + np.arange(size)]
                unit = np.maximum(np.abs(x).max(axis=1), 1.0)
                norm[at] = unit * np.sqrt(((x / unit[:, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(q)), pa.array(norm)], names=["vec_id", "label", "q", "norm"])

    kept = rows.where(usable(F.col("label"), F.col("embedding")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(scaled, "vec_id long, label string, q array<double>, norm double")


def _by_norm(rows: DataFrame, s: Settings) -> tuple[DataFrame, list[float]]:
    """The candidates with the number of their range, the longest in range 0; and the largest norm of each range."""
    n = rows.count()
    ranges = max(1, min(s.most_ranges, math.ceil(n / s.range_rows)))
    # vec_id splits rows of equal norm, as of many equal vectors, and a hash those that repeat an id, too.
    dealt = rows.repartitionByRange(ranges, F.desc("norm"), "vec_id", F.xxhash64("label", "q")).withColumn("range", F.spark_partition_id())
    dealt = written(dealt.sortWithinPartitions(F.desc("norm"), "vec_id"), "by-norm")
    norms = {r["range"]: r["norm"] for r in dealt.groupBy("range").agg(F.max("norm").alias("norm")).collect()}
    return dealt, [norms.get(k, -1.0) for k in range(max(norms, default=-1) + 1)]


def _scores(a: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of whole numbers, each of a size of at most `most`."""
    if most < 2.0**53:
        return (a @ c.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ c.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(c).T, _LEAST, _MOST).astype(np.int64)


class _Block:
    """The anchors of one length that a task holds, with the best rows of each of their windows so far."""

    def __init__(self, k: int, same: bool):
        self.k, self.same, self.parts, self.codes = k, same, [], {}

    def add(self, batch: pa.RecordBatch, at: np.ndarray) -> None:
        self.parts.append(batch.take(pa.array(at)))

    def ready(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        self.a, self.norm = _matrix(t.column("q").combine_chunks()), t.column("norm").to_numpy()
        self.own = t.column("own").fill_null(_MOST).to_numpy()
        self.nameless = t.column("own").is_null().to_numpy()
        self.label = np.array([self.codes.setdefault(x, len(self.codes)) for x in t.column("label").to_pylist()], np.int64)
        lists = t.column("windows").combine_chunks()
        self.at = np.repeat(np.arange(len(t)), lists.value_lengths().to_numpy(zero_copy_only=False))
        w = lists.flatten()
        self.wid, self.lower, self.upper, self.least = (w.field(c).to_numpy(zero_copy_only=False) for c in ("wid", "lower", "upper", "least"))
        self.least = self.least.copy()
        self.aid = t.column("id").to_numpy()[self.at]
        self.score = np.full((len(self.at), self.k), _LEAST)
        self.id = np.full((len(self.at), self.k), _MOST)
        self.filled = np.zeros((len(self.at), self.k), bool)

    def search(self, c: np.ndarray, norm: float, ids: np.ndarray, labels: list[str]) -> None:
        """Hold a bucket, whose largest norm is `norm`, against the windows that it can still serve."""
        live = np.flatnonzero(self.norm[self.at] * norm * _SLACK >= self.least)
        if not len(live):
            return
        code = np.array([self.codes.get(x, -1) for x in labels], np.int64)
        step = max(1, _CELLS // len(c))
        for first in range(0, len(live), step):
            w = live[first : first + step]
            rows, back = np.unique(self.at[w], return_inverse=True)
            s = _scores(self.a[rows], c, float(self.norm[rows].max()) * norm * _SLACK)
            fit = (self.label[rows][:, None] == code) == self.same
            if self.same:
                fit &= (self.own[rows][:, None] != ids) | self.nameless[rows][:, None]
            s, fit = s[back], fit[back]
            fit &= (s >= self.least[w][:, None]) & (s <= self.upper[w][:, None])
            i, j = np.nonzero(fit)
            if len(i):
                self._keep(w, i, s[i, j], ids[j])

    def _keep(self, w: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched, at = np.unique(i, return_inverse=True)
        held = self.filled[w[touched]]
        old, place = np.nonzero(held)
        row = np.concatenate([at, old])
        score = np.concatenate([score, self.score[w[touched]][old, place]])
        ids = np.concatenate([ids, self.id[w[touched]][old, place]])
        order = np.lexsort((ids, ~score, row))  # ~ turns the order without overflow
        row, score, ids = row[order], score[order], ids[order]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        best = place < self.k
        row, score, ids, place = row[best], score[best], ids[best], place[best]
        to = w[touched][row]
        self.score[to, place], self.id[to, place], self.filled[to, place] = score, ids, True
        full = w[touched][self.filled[w[touched], self.k - 1]]
        self.least[full] = np.maximum(self.least[full], self.score[full, self.k - 1])

    def found(self) -> pa.RecordBatch:
        w, place = np.nonzero(self.filled)
        return pa.RecordBatch.from_arrays([pa.array(self.aid[w]), pa.array(self.wid[w]), pa.array(self.id[w, place]), pa.array(self.score[w, place])], names=["aid", "wid", "id", "score"])


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _tasks(k: int, same: bool, bucket: int):
    """Over rows sorted by (range, block, side, falling norm): the anchors of a block are held, the candidates stream past."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, {}, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("range", "block")], axis=1)
            side, sizes = batch.column("side").to_numpy(), batch.column("q").value_lengths().to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1) | (side[1:] != side[:-1])))
            for a, b in zip(new, np.append(new[1:], n), strict=True):
                if (own := tuple(keys[a])) != key:
                    if ready:
                        yield from (x.found() for x in held.values())
                    key, held, ready = own, {}, False
                if side[a] == 0:
                    for size in np.unique(sizes[a:b]).tolist():
                        held.setdefault(size, _Block(k, same)).add(batch, np.flatnonzero(sizes[a:b] == size) + a)
                    continue
                if not ready:
                    for x in held.values():
                        x.ready()
                    ready = True
                for start in range(a, b, bucket):
                    part = slice(start, min(start + bucket, b))
                    norm = float(batch.column("norm")[start].as_py())
                    for size in np.unique(sizes[part]).tolist():
                        if size in held:
                            rows = batch.take(pa.array(np.flatnonzero(sizes[part] == size) + start))
                            held[size].search(_matrix(rows.column("q")), norm, rows.column("id").fill_null(_MOST).to_numpy(), rows.column("label").to_pylist())
        if ready:
            yield from (x.found() for x in held.values())

    return run


_ROWS = "range int, block int, side int, norm double, id long, own long, label string, q array<double>, windows array<struct<wid: long, lower: long, upper: long, least: long>>"


def _best(found: DataFrame, k: int) -> DataFrame:
    """aid, wid, id, score, place (from 1): the k best rows of each window."""
    order = Window.partitionBy("aid", "wid").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _search(anchors: DataFrame, windows: DataFrame, candidates: DataFrame, norms: list[float], k: int, same: bool, s: Settings) -> DataFrame:
    """aid, wid, id, score, place of the k best candidates of each window (aid, wid, lower, upper)."""
    spark = anchors.sparkSession
    known = written(spark.createDataFrame([], "aid long, wid long, id long, score long, place int"), "none")
    first, width, columns = 0, 1, [c.split()[0] for c in _ROWS.split(", ")[:9]]
    while first < len(norms):
        last = min(first + width, len(norms))
        kth = known.where(F.col("place") == k).select("aid", "wid", F.col("score").alias("kth"))
        least = F.greatest("lower", F.coalesce("kth", F.lit(_LEAST)))
        open_ = windows.join(kth, ["aid", "wid"], "left").select("aid", F.struct("wid", "lower", "upper", least.alias("least")).alias("w"))
        asked = anchors.join(open_.groupBy("aid").agg(F.collect_list("w").alias("windows")), "aid")
        longest = F.array(*map(F.lit, norms[first:last]))
        reached = F.filter(F.sequence(F.lit(first), F.lit(last - 1)), lambda r: F.col("norm") * F.get(longest, r - first) * _SLACK >= F.array_min("windows.least"))
        asked = asked.withColumn("range", F.explode(reached))
        asked = written(asked.select("range", "block", F.lit(0).alias("side"), "norm", F.col("aid").alias("id"), "own", "label", "q", "windows"), "asked")
        # Only the blocks that ask for a range get its rows.
        wanted = asked.groupBy("range").agg(F.collect_set("block").alias("blocks"))
        part = candidates.where(F.col("range").between(first, last - 1)).join(wanted, "range").withColumn("block", F.explode("blocks"))
        part = part.select("range", "block", F.lit(1).alias("side"), "norm", F.col("vec_id").alias("id"), F.lit(None).cast("long").alias("own"), "label", "q", F.lit(None).cast(asked.schema["windows"].dataType).alias("windows"))
        met = asked.select(columns).unionByName(part.select(columns)).repartition("range", "block").sortWithinPartitions("range", "block", "side", F.desc("norm"))
        found = met.mapInArrow(_tasks(k, same, s.bucket), "aid long, wid long, id long, score long")
        known = written(_best(known.drop("place").unionByName(found), k), "best")
        first, width = last, width * s.growth
    return known


def mine(vectors: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors among vectors (vec_id, label, embedding).

    is_anchor: a condition on vec_id; null is no.
    """
    s = settings
    candidates, norms = _by_norm(_whole(vectors, s.scale), s)
    anchors = written(candidates.where(F.coalesce(is_anchor, F.lit(False))).withColumns({"aid": F.monotonically_increasing_id()}), "anchors")
    blocks = max(1, math.ceil(anchors.count() / s.anchor_rows))
    anchors = anchors.select("aid", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("own"), "label", "q", "norm")
    everything = anchors.select("aid", F.lit(0).cast("long").alias("wid"), F.lit(_LEAST).alias("lower"), F.lit(_MOST).alias("upper"))
    positives = _search(anchors, everything, candidates, norms, s.positives, True, s).select("aid", F.col("place").cast("long").alias("wid"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda percent, round_: round_(F.col("positive_score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)")).cast("long")
    windows = positives.select("aid", "wid", share(s.low, F.ceil).alias("lower"), share(s.high, F.floor).alias("upper")).where("lower <= upper")
    negatives = _search(anchors, windows, candidates, norms, s.negatives, False, s)
    named = lambda c: F.when(F.col(c) != _MOST, F.col(c)).alias(c)
    out = negatives.join(positives, ["aid", "wid"]).join(anchors.select("aid", F.col("own").alias("anchor_id")), "aid")
    out = out.withColumnsRenamed({"place": "rank", "id": "negative_id", "score": "negative_score"})
    return out.select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")
