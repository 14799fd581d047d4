"""Rows that share a key, brought together in groups of bounded size, however many rows a key has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, key: str, member: str, most: int, attach: DataFrame | None = None) -> DataFrame:
    """The rows of keys that have two or more, with the columns block_x and block_y, in partitions sorted by (key, block_x, block_y).

    A key of more than about `most` rows is dealt into blocks by a hash of `member`; each pair of blocks, and so each
    pair of rows, meets in a group of its own. The row's own block is the column `block`. Columns of `attach` are joined
    by member once rows without a partner are gone.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / most).cast("int")
    out = rows.join(sizes, key).withColumns({"block": F.pmod(F.xxhash64(member), blocks).cast("int"), "blocks": blocks}).drop("n")
    if attach is not None:
        out = out.join(attach, member)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))))
    out = out.withColumns({"block_x": F.least("block", "other"), "block_y": F.greatest("block", "other")}).drop("other", "blocks")
    return out.repartition(key, "block_x", "block_y").sortWithinPartitions(key, "block_x", "block_y")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Consecutive rows of sorted batches, cut at group ends only, with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, by)
        if starts[-1] > 0:
            head = table.slice(0, starts[-1])
            yield head, _numbers(starts[:-1], len(head))
            table = table.slice(starts[-1])
        held, rows = table.to_batches(), len(table)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _numbers(_starts(table, by), len(table))


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[0] = True
    for name in by:
        v = table.column(name).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _numbers(starts: np.ndarray, n: int) -> np.ndarray:
    new = np.zeros(n, np.int64)
    new[starts] = 1
    return np.cumsum(new) - 1


def pairs_by_lag(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of a group, some at a time; rows of a group are consecutive."""
    at = np.arange(len(group))
    lag = 1
    while True:
        at = at[at + lag < len(group)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return
        yield at, at + lag
        lag += 1


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is joined to by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        keep = low != high
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    return root
