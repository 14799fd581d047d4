"""Sharding by histogram sort: splitters are found by counting, then rows are exchanged once.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. Probes are candidate boundaries in that
order. Each round counts the exact bytes and rows below every probe across all partitions, in one aggregation whose
result has about `2 ** PROBE_BITS` rows in all, whatever the number of splitters still sought, and sets finer probes
where no boundary is within tolerance yet: first along the 64 bits of the hash, then, inside one text's copies, along
those of the id. Then rows are exchanged once, each bucket of a shard to a partition of its own that is small enough for
a task; a row's slot is its rank in the bucket after the rows that the counts found before it.

Sizes are the UTF-8 bytes of the text plus 1 (a null text: 1), so that shards are near equal in bytes: each boundary
lies within `tolerance` of a shard's size from its place, or at the edge of a group of equal texts, which is kept whole
if it has at most `whole` of a shard's size. A larger group is split between shards, at a doc_id. A null doc_id comes before all others. An empty table gives no rows. Ties, being equal in text and id, are
ordered by a hash of the whole row. All columns of docs are kept; a column named shard or slot is replaced.

Only DataFrame operations are used.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import named, written

PROBE_BITS, CELL_BITS, LEAST = 16, 12, -(1 << 63)


@dataclass(frozen=True)
class Boundary:
    """The first (key, id) of a bucket, and the exact bytes and rows before it."""

    key: int
    id: int
    bytes: int
    rows: int


@dataclass
class _Interval:
    """Keys (then ids, in the copies of one text) that share their first bits; bytes and rows before it."""

    level: int  # 0: bits of the key, 1: of the id
    prefix: int
    bits: int
    bytes: int
    rows: int
    key: int = LEAST  # of level 1


def _order(b: Boundary) -> tuple[int, int]:
    return b.key, b.id


def size_of(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 1


def _prefix(column: Column, bits: int) -> Column:
    """The first bits of a long, in the order of longs."""
    return F.shiftrightunsigned(column.bitwiseXOR(F.lit(LEAST)), 64 - bits) if bits else F.lit(0).cast("long")


def _first(prefix: int, bits: int) -> int:
    """The smallest long with these first bits."""
    return (prefix << (64 - bits)) + LEAST


def find_boundaries(keys: DataFrame, targets: list[int], slack: list[float], whole: float = 0) -> list[Boundary]:
    """For each target (ascending) the boundary with about so many bytes before it; keys: (key, id, size).

    A boundary that would fall into a key of at most `whole` bytes goes to the nearer edge of that.
    """
    found: dict[int, Boundary] = {}
    seek: list[tuple[_Interval, list[int]]] = [(_Interval(0, 0, 0, 0, 0), list(range(len(targets))))]
    while seek:
        counted: dict[tuple, list] = {}
        probe_bits = max(1, PROBE_BITS - (len(seek) - 1).bit_length())  # all rounds bring about as many rows
        for level in (0, 1):
            for bits in {i.bits for i, _ in seek if i.level == level}:
                some = [i for i, _ in seek if (i.level, i.bits) == (level, bits)]
                step = min(probe_bits, 64 - bits)
                column = F.col("id" if level else "key")
                own = keys.where(F.col("key").isin([i.key for i in some])) if level else keys
                if bits:
                    own = own.where(_prefix(column, bits).isin([i.prefix for i in some]))
                by = [F.col("key") if level else F.lit(LEAST).alias("key"), _prefix(column, bits + step).alias("probe")]
                for r in own.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
                    probe = r["probe"] & ((1 << 64) - 1)  # all 64 bits come back signed
                    counted.setdefault((level, bits, r["key"], probe >> step), []).append((probe, r["bytes"], r["rows"]))
        after: list[tuple[_Interval, list[int]]] = []
        for interval, wanted in seek:
            step = min(probe_bits, 64 - interval.bits)
            cells = sorted(counted.get((interval.level, interval.bits, interval.key, interval.prefix), []))
            finer: dict[int, tuple[_Interval, list[int]]] = {}
            below_bytes = list(accumulate((n for _, n, _ in cells), initial=interval.bytes))
            below_rows = list(accumulate((m for _, _, m in cells), initial=interval.rows))
            for t in wanted:
                # The cell that the target falls into, or the last.
                cell = min(bisect_right(below_bytes, targets[t]), len(cells)) - 1
                (probe, n, m), before, rows = cells[cell], below_bytes[cell], below_rows[cell]
                low, high = targets[t] - before, before + n - targets[t]
                bits = interval.bits + step
                last = interval.level == 1 and bits == 64
                kept = interval.level == 0 and bits == 64 and n <= whole
                if min(low, abs(high)) <= slack[t] or last or kept:
                    at, before, rows = (probe, before, rows) if low <= abs(high) else (probe + 1, before + n, rows + m)
                    first = _first(at, bits)
                    # Past the last id or key there is no boundary to name; the next larger key is one.
                    if interval.level == 0:
                        found[t] = Boundary(first, LEAST, before, rows) if at < 1 << bits else Boundary((1 << 63) - 1, (1 << 63) - 1, before, rows)
                    else:
                        found[t] = Boundary(interval.key, first, before, rows) if at < 1 << bits else Boundary(interval.key + 1, LEAST, before, rows)
                elif bits == 64:
                    finer.setdefault(probe, (_Interval(1, 0, 0, before, rows, _first(probe, 64)), []))[1].append(t)
                else:
                    finer.setdefault(probe, (_Interval(interval.level, probe, bits, before, rows, interval.key), []))[1].append(t)
            after += finer.values()
        seek = after
    out = [found[t] for t in range(len(targets))]
    for t in range(1, len(out)):  # a boundary that may lie farther off gives way to one that may not
        if slack[t] >= slack[t - 1]:
            out[t] = max(out[t], out[t - 1], key=_order)
            continue
        for before in range(t - 1, -1, -1):
            if _order(out[before]) <= _order(out[t]):
                break
            out[before] = out[t]
    return out


def _side_table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A few thousand rows as a table that the JVM makes from a literal, without a Python worker."""
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return spark.range(1).select(F.inline(listed))


def _bucket(spark: SparkSession, rows: DataFrame, bounds: list[Boundary]) -> DataFrame:
    """rows (key, id, ...) with the number of boundaries at or before each as `bucket`.

    The boundaries are dealt by the first bits of their key, 2 ** CELL_BITS rows, which is small enough to broadcast.
    """
    cells: dict[int, list[Boundary]] = {}
    for b in bounds:
        cells.setdefault((b.key - LEAST) >> (64 - CELL_BITS), []).append(b)
    table, before = [], 0
    for cell in range(1 << CELL_BITS):
        own = cells.get(cell, [])
        table.append((cell, before, [(b.key, b.id) for b in own]))
        before += len(own)
    cell = _side_table(spark, [{"cell": c, "before": n, "own": [{"key": k, "id": i} for k, i in own]} for c, n, own in table], "cell: long, before: int, own: array<struct<key: long, id: long>>")
    here = F.struct(F.col("key").alias("key"), F.col("id").alias("id"))
    bucket = F.col("before") + F.size(F.filter("own", lambda b: b <= here))
    return rows.withColumn("cell", _prefix(F.col("key"), CELL_BITS)).join(F.broadcast(cell), "cell").withColumn("bucket", bucket.cast("int")).drop("cell", "before", "own")


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, whole: float = 0.01, bucket_bytes: int = 32 << 20, most_buckets: int = 1 << 14) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (from 0 in each shard, without gaps), exchanged by bucket of a shard."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    key, ident, size = F.xxhash64("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), size_of()
    keys = written(docs.select(key.alias("key"), ident.alias("id"), size.alias("size")), "shard-keys")
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return docs.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(1, min(math.ceil(total / shards / bucket_bytes), most_buckets // shards))
    count = shards * parts
    targets = [total * k // count for k in range(1, count)]
    slack = [tolerance * total / shards if k % parts == 0 else 0.25 * total / count for k in range(1, count)]
    bounds = find_boundaries(keys, targets, slack, whole * total / shards)
    start = [0, *(b.rows for b in bounds)]
    places = _side_table(spark, [{"bucket": k, "shard": k // parts, "before_slot": start[k] - start[k // parts * parts]} for k in range(count)], "bucket: int, shard: int, before_slot: long")

    row = F.struct(*named(docs.columns))
    rows = docs.select(row.alias("row"), key.alias("key"), ident.alias("id"))
    exchanged = _bucket(spark, rows, bounds).repartitionById(count, "bucket")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "id", F.xxhash64("row")))
    ranked = exchanged.withColumn("rank", rank).join(F.broadcast(places), "bucket")
    return ranked.select("row.*", "shard", (F.col("before_slot") + F.col("rank") - 1).alias("slot"))
