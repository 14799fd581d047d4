"""Benchmark decontamination: an FM-index for each training shard, searched backward for the benchmark's windows.

A text's words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` once A-Z are lower-cased. A window is 10 consecutive
words of an item; an item of fewer words, but not none, is one window. The alphabet of an index is the words of the
windows: a run of document words that all are such words, and that is long enough for a window, becomes a run of
symbols, and whatever else cannot hold an occurrence ends a run. Windows are searched backward through wavelet-tree
ranks, their occurrences located by sampled suffix positions, and overlapping or touching occurrences merged into
removal spans.

A shard is what a task is handed at once, at most about `Settings.shard_bytes` of text or one longer document, so
indexes never leave the task that builds them. The benchmark is the stated query set, held against all documents. It is
read in blocks of about `Settings.block_words` words, and so of no more windows, dealt by a hash of id and text. The
driver sees the texts of one block at a time; their windows are made in the Python workers, as arrays. Several blocks
are broadcast in turn: the spans of one are written to the shared folder and its broadcast is destroyed before the next
is collected; all spans are merged before anything is cut.

A null text has no words. Items whose id or text is null are left out. Repeated items, or windows that several items
share, count for each of them. Rows with the same doc_id each get a row. Columns other than doc_id and text are kept
by remove_spans and not read otherwise.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.fm_index import FMIndex
from quire.llm.shared import named, runs, scratch, thrifty, written

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_JAVA_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of text as it is
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    window: int = 10
    block_words: int = 500_000  # of benchmark text searched for at once
    shard_bytes: int = 4 << 20  # of document text under one index


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Phrases:
    """Distinct windows of one length (or those of short items), as rows of symbols filled up with 0, with the items of each."""

    def __init__(self, ids: dict[bytes, int], rows: np.ndarray, items: np.ndarray):
        self.ids = ids
        whole = np.ascontiguousarray(rows).view([("", np.void, rows.shape[1] * rows.itemsize)]).ravel()
        _, first, own = np.unique(whole, return_index=True, return_inverse=True)
        self.rows = rows[first]
        self.lengths = (self.rows > 0).sum(axis=1)
        self.shortest = int(self.lengths.min())
        pair = np.unique(np.stack([own, items]), axis=1)
        self.items = pair[1]
        self.item_starts = np.searchsorted(pair[0], np.arange(len(first) + 1))

    def runs_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the runs that can hold a window, each run ended by a 0, and the word of each."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        edges = np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]]))
        first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = end - first >= self.shortest
        first, end = first[long], end[long]
        if not len(first):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        length = end - first + 1
        at = np.arange(length.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        ids = np.append(ids, 0)
        return ids[at], at


def phrases_of(items: list[tuple[int, str]], window: int) -> list[Phrases]:
    """Of (number, text) items."""
    ids: dict[bytes, int] = {}
    full, short = ([], []), ([], [])
    for number, text in items:
        w = words_of(text)
        symbols = np.fromiter((ids.setdefault(x, len(ids) + 1) for x in w), np.int32, len(w))
        if len(w) >= window:
            rows = np.lib.stride_tricks.sliding_window_view(symbols, window)
        elif len(w):
            rows = np.pad(symbols, (0, window - len(w)))[None, :]
        else:
            continue
        kind = full if len(w) >= window else short
        kind[0].append(rows)
        kind[1].append(np.full(len(rows), number))
    return [Phrases(ids, np.concatenate(rows), np.concatenate(numbers)) for rows, numbers in (full, short) if rows]


_MADE: dict[str, list[Phrases]] = {}  # of the block that this worker has last searched for


def _phrases(shared: Broadcast, window: int) -> tuple[list[str], list[Phrases]]:
    """Names of the items and phrases of the broadcast block, made once in each Python worker."""
    block, names, items = shared.value
    if block not in _MADE:
        _MADE.clear()
        _MADE[block] = phrases_of(items, window)
    return names, _MADE[block]


def _shared(spark, block: list[tuple[str, str]]) -> Broadcast:
    """The texts of a block (item_id, text), with numbers for the ids."""
    names = sorted({i for i, _ in block})
    number = {i: k for k, i in enumerate(names)}
    return spark.sparkContext.broadcast((uuid.uuid4().hex, names, [(number[i], t) for i, t in block]))


def search_shard(texts: list[str | None], phrases: list[Phrases]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[int]]]:
    """Numbers of words, merged spans of words [start, end) and item numbers of each text."""
    counts = np.zeros(len(texts), np.int64)
    found_runs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in phrases]
    for k, text in enumerate(texts):
        words = words_of(text)
        counts[k] = len(words)
        for p, own in zip(phrases, found_runs, strict=True):
            own.append(p.runs_of(words))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[int]] = [[] for _ in texts]
    found_spans, found_items = [], []
    for p, parts in zip(phrases, found_runs, strict=True):
        sizes = np.array([len(s) for s, _ in parts], np.int64)
        if not sizes.sum():
            continue
        symbols, word, row = np.concatenate([s for s, _ in parts]), np.concatenate([w for _, w in parts]), np.repeat(np.arange(len(parts)), sizes)
        index = FMIndex(symbols)
        low, high = index.search(p.rows, p.lengths)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        if not len(which):
            continue
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        at = index.locate(place)
        found_spans.append(np.stack([row[at], word[at], word[at] + p.lengths[which]]))
        pair = np.unique(row[at] * len(count) + which)
        row_of, which = pair // len(count), pair % len(count)
        n = np.diff(p.item_starts)[which]
        item = p.items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p.item_starts[which], n)]
        found_items.append(np.stack([np.repeat(row_of, n), item]))
    if found_spans:
        rows, start, end = (x := np.concatenate(found_spans, axis=1))[:, np.lexsort((x[2], x[1], x[0]))].tolist()
        for r, a, b in zip(rows, start, end, strict=True):
            if (own := spans[r]) and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
        for r, i in zip(*np.unique(np.concatenate(found_items, axis=1), axis=1).tolist(), strict=True):
            items[r].append(i)
    return counts, spans, items


_SPANS = "array<struct<start: int, end: int>>"
_ROW, _FOUND, _CLEAN, _BLOCK = "quire_row", "quire_found", "quire_clean", "quire_block"


def _search_block(docs: DataFrame, key: str, block: list[tuple[str, str]], settings: Settings) -> tuple[DataFrame, Broadcast]:
    """key, n_words, spans, items of each row of docs, and what is broadcast for it."""
    shared = _shared(docs.sparkSession, block)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @thrifty
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, phrases = _phrases(shared, settings.window)
        for batch in batches:
            for a, b in runs(np.array([len(t or "") for t in batch.column("text").to_pylist()]), settings.shard_bytes):
                part = batch.slice(a, b - a)
                n, spans, items = search_shard(part.column("text").to_pylist(), phrases)
                lists = pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], spans_type)
                found = pa.array([[names[i] for i in s] for s in items], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists, found], names=[key, "n_words", "spans", "items"])

    kind = T.StructType([docs.schema[key], *T.StructType.fromDDL(f"n_words long, spans {_SPANS}, items array<string>").fields])
    return docs.select(key, "text").mapInArrow(search, kind), shared


def _blocks(benchmark: DataFrame, settings: Settings) -> list[DataFrame]:
    """The (item_id, text) of each block; none is collected yet."""
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = max(1, math.ceil((known.agg(F.sum(F.regexp_count("text", F.lit(_JAVA_WORD)))).first()[0] or 0) / settings.block_words))
    if n == 1:
        return [known]
    dealt = known.dropDuplicates().withColumn(_BLOCK, F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition(_BLOCK)
    path = scratch(known.sparkSession, "blocks")
    dealt.write.partitionBy(_BLOCK).parquet(path)
    dealt = known.sparkSession.read.schema(dealt.schema).parquet(path)
    return [dealt.where(F.col(_BLOCK) == k).select("item_id", "text") for k in range(n)]


def _collected(block: DataFrame) -> list[tuple[str, str]]:
    return [tuple(r) for r in block.collect()]


def find_spans(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """key, n_words, spans, items (sorted ids), n_hit of every row of docs; spans are of words, start included, end not."""
    blocks = _blocks(benchmark, settings) if benchmark is not None else []
    if len(blocks) <= 1:
        out, _ = _search_block(docs, key, _collected(blocks[0]) if blocks else [], settings)
    else:
        rows = written(docs.select(key, "text", F.monotonically_increasing_id().alias(_ROW)), "decontamination")
        out = rows.select(key, _ROW).join(_search_blocks(rows, blocks, settings), _ROW).drop(_ROW)
    out = out.withColumn("items", F.array_sort(F.array_distinct("items")))
    return out.withColumn("n_hit", _n_hit("spans"))


def _search_blocks(rows: DataFrame, blocks: list[DataFrame], settings: Settings) -> DataFrame:
    """_ROW, n_words, spans, items of each row of the written table rows: every block is searched for in the whole texts."""
    path, kind = scratch(rows.sparkSession, "spans"), None
    for block in blocks:
        items = _collected(block)
        if kind is not None and not items:
            continue
        found, shared = _search_block(rows, _ROW, items, settings)
        # The first block writes a row for each text, the others for those in which they occur.
        (found if kind is None else found.where(F.size("spans") > 0)).write.mode("append").parquet(path)
        kind = found.schema
        shared.destroy()
    found = rows.sparkSession.read.schema(kind).parquet(path).groupBy(_ROW)
    found = found.agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return found.withColumn("spans", _merged("spans"))


def _n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _merged(spans: str):
    """Overlapping or touching spans of several blocks, as one."""
    last = lambda done: F.element_at(done, -1)
    joined = lambda done, s: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    step = lambda done, s: F.when(F.size(done) == 0, F.array(s)).when(F.get(done, F.size(done) - 1)["end"] >= s["start"], joined(done, s)).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {_SPANS})"), step)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans of words."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : ends[a][0]])
        at = ends[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _cleaner(shared: Broadcast, settings: Settings) -> Callable[[Column], Column]:
    """A column function from text to what is left of it; null if that holds none of its words."""

    @F.arrow_udf(T.StringType())
    @thrifty
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, phrases = _phrases(shared, settings.window)
        for part in parts:
            texts, out = part.to_pylist(), []
            for a, b in runs(np.array([len(t or "") for t in texts]), settings.shard_bytes):
                n, spans, _ = search_shard(texts[a:b], phrases)
                for t, s, w in zip(texts[a:b], spans, n.tolist(), strict=True):
                    out.append(None if s and sum(y - x for x, y in s) == w else cut(t, s) if s else t)
            yield pa.array(out, pa.string())

    # Spark would otherwise call it once more for the filter on its result.
    return clean.asNondeterministic()


@F.arrow_udf(T.StringType())
def _cut_all(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in parts:
        yield pa.array([cut(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with benchmark passages cut out of the texts and n_chars, where there is one, set anew; other rows as they are.

    A document that had words and has none left goes. Works for a benchmark of one block without any shuffle. With more
    blocks the spans of all are merged before a text is cut once, so that no block searches what another has left.
    """
    blocks = _blocks(benchmark, settings)
    if len(blocks) == 1:
        shared = _shared(docs.sparkSession, _collected(blocks[0]))
        out = docs.withColumn(_CLEAN, _cleaner(shared, settings)(F.col("text"))).where(F.col(_CLEAN).isNotNull() | F.col("text").isNull())
    else:
        rows = written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "decontamination")
        found = _search_blocks(rows.select(_ROW, "text"), blocks, settings).where(F.size("spans") > 0)
        found = found.select(_ROW, F.struct("spans", (_n_hit("spans") == F.col("n_words")).alias("whole")).alias(_FOUND))
        out = rows.join(found, _ROW, "left").where(~F.coalesce(F.col(_FOUND)["whole"], F.lit(False)))
        out = out.withColumn(_CLEAN, _cut_all(F.col("text"), F.col(_FOUND)["spans"]))
    changed = ~F.col(_CLEAN).eqNullSafe(F.col("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(_CLEAN)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col(_CLEAN)).select(named(docs.columns))
