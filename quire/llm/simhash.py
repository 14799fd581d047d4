"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's 3-word
shingles. Fingerprints within 3 bits are linked. They are cut into a ring of 8 segments of 8 bits. If two differ in at
most 3 bits, then from some segment on every chain of l consecutive segments differs in at most floor(3 l / 8) bits in
all: chains of 2 in none, of 5 in one, of 7 in two. Candidates agree on the first two segments and on two of the next
three, which are exact keys; the longer chains prune them before the full Hamming check.

Only distinct fingerprints are compared, so copies cost nothing; a key that many fingerprints share is dealt into
blocks. Tasks return spanning links of what they find, never all pairs, and no pair is dropped.

A text of fewer than 3 words has one shingle, all its words; null, empty and blank texts have fingerprint zero, linked
like any other. Rows with the same doc_id are rows of their own. A null doc_id never is a component's smallest, unless
there is no other. Columns other than doc_id and text are not read by find_groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from quire.llm.buckets import forest, in_blocks, pairs_by_lag, whole_groups
from quire.llm.components import components
from quire.llm.shared import named, thrifty, written

SEGMENTS, WIDTH, MOST = 8, 8, 3
SHINGLE, SEED = 3, 42
_BLOCK = 1 << 17  # hashes whose bits are counted at once
_GROUP = 2000  # fingerprints of a block of a key


def _shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= SHINGLE:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -SHINGLE]]).tolist()
    ends = (ends[SHINGLE - 1 :] - 1).tolist()
    return list(map(xxh64_intdigest, [line[a:b] for a, b in zip(starts, ends, strict=True)], repeat(SEED)))


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Of each text, as uint64."""
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    rows: list[tuple[int, int]] = []

    def count() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0] + [n for _, n in rows[:-1]])
            np.add.at(ones, [r for r, _ in rows], np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
        hashes.clear()
        rows.clear()

    for row, text in enumerate(texts):
        found = _shingle_hashes(text)
        totals[row] = len(found)
        for at in range(0, len(found), _BLOCK):
            part = found[at : at + _BLOCK]
            hashes += part
            rows.append((row, len(part)))
            if len(hashes) >= _BLOCK:
                count()
    count()
    return np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


@F.arrow_udf(T.LongType())
@thrifty
def fingerprint(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fingerprint as a signed long."""
    for part in parts:
        yield pa.array(fingerprints(part.to_pylist()).view(np.int64))


def _keys(fp: str) -> Column:
    """For each of the 8 starts, the first two segments with two of the next three."""
    out = []
    for i in range(SEGMENTS):
        turned = F.col(fp) if not i else F.shiftrightunsigned(fp, WIDTH * i).bitwiseOR(F.shiftleft(fp, 64 - WIDTH * i))
        for c, mask in enumerate((0x00FFFFFFFF, 0xFF00FFFFFF, 0xFFFF00FFFF)):
            out.append(turned.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((3 * i + c) << 40)))
    return F.array(*out)


def _within(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chains from a start keep to their budgets, and then the whole."""
    x = a ^ b
    by = (start * WIDTH).astype(np.uint64)
    x = np.where(by > 0, (x >> by) | (x << ((np.uint64(64) - by) & np.uint64(63))), x)
    ok = np.bitwise_count(x & np.uint64((1 << 40) - 1)) <= 1
    ok &= np.bitwise_count(x & np.uint64((1 << 56) - 1)) <= 2
    return ok & (np.bitwise_count(x) <= MOST)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that span what all links within 3 bits join."""

    @thrifty
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["key", "block_x", "block_y"]):
            key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            start = (key >> 40) // 3
            root = np.arange(len(fp))
            for i, j in pairs_by_lag(group):
                ok = _within(fp[i], fp[j], start[i])
                ok &= root[i] != root[j]
                if ok.any():
                    i, j = root[i[ok]], root[j[ok]]
                    step = forest(len(fp), i, j)
                    root = step[root]
            at = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[root[at]].view(np.int64)), pa.array(fp[at].view(np.int64))], names=["a", "b"])

    rows = distinct.select("fp", F.explode(_keys("fp")).alias("key"))
    return in_blocks(rows, "key", "fp", _GROUP).select("key", "block_x", "block_y", "fp").mapInArrow(verify, "a long, b long")


def _grouped(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) from written rows (doc_id, fp)."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(links(classes)).withColumnRenamed("v", "fp")
    joined = written(classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    return joined.select("fp", "root").join(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")


def find_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    rows = written(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "simhash")
    out = rows.join(_grouped(rows), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, broadcast_marks: int = 1_000_000) -> DataFrame:
    """One row of each group, that of the smallest doc_id (then of the smallest hash of its text), with the columns of docs.

    Of rows with equal doc_id and text whose other columns differ any one stays.

    Rows are marked by (doc_id, hash of the text). Where at most `broadcast_marks` marks (about 40 bytes each) say what goes
    or is there repeatedly, they are broadcast and no text is exchanged; more are joined by a shuffle.
    """
    keys = ["quire_none", "quire_id", "quire_mark"]  # never null
    key = dict(zip(keys, (F.col("doc_id").isNull(), F.xxhash64("doc_id"), F.xxhash64("text")), strict=True))
    rows = written(docs.select("doc_id", *[c.alias(k) for k, c in key.items()], fingerprint(F.col("text")).alias("fp")), "simhash")
    first = F.min(F.struct(keys[0], "doc_id", *keys[1:])).alias("first")
    kept = rows.join(_grouped(rows), "fp").groupBy("root").agg(first).select(*[F.col("first")[k].alias(k) for k in keys])
    kept = written(kept.withColumn("stays", F.lit(True)), "kept")
    marked = docs.withColumns(key)
    marks = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(kept, keys, "left").where("stays is null or n > 1")
    marks = written(marks.select(*keys, F.col("stays").isNotNull().alias("stays")), "marks")
    if marks.count() > broadcast_marks:
        out = marked.join(kept.select(keys), keys, "left_semi").dropDuplicates(keys)
    else:
        out = marked.join(F.broadcast(marks.select(keys)), keys, "left_anti")
        if marks.where("stays").limit(1).count():
            repeated = marked.join(F.broadcast(marks.where("stays").select(keys)), keys, "left_semi")
            out = out.unionByName(repeated.dropDuplicates(keys))
    return out.select(named(docs.columns))
