"""What the operators of this package share: the folder that all executors see, and small text helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SCRATCH: dict[str, list[str]] = {}  # paths of each application


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine's own only where that is unset and all tasks run here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession, most: int = 4 << 20) -> SparkSession:
    """Have Spark hand Python at most so many bytes at once, so that a worker's memory doesn't follow the length of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).lower().removesuffix("b")) > most:
        spark.conf.set(key, str(most))
    return spark


def give_back() -> None:
    """Return what this process's allocators hold unused: Spark keeps its Python workers from one stage to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def thrifty(f: Callable) -> Callable:
    """f, an iterator function of mapInArrow or of an Arrow UDF, that gives back its memory when a task ends."""

    @functools.wraps(f)
    def run(*columns):
        try:
            yield from f(*columns)
        finally:
            give_back()

    return run


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which remove_scratch takes away."""
    path = f"{shared_root(spark)}/quire-{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this application's operators have written to the shared folder so far, and say how many paths that were.

    Results are read from there, so call it when those that are still wanted have been written elsewhere.
    """
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and outlives any executor."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, also those that hold a dot."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def whole_text(column: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is held out, as nothing may be learnt from it."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(True))


def sampled(rows: DataFrame, group: str, most: int, broadcast_groups: int) -> DataFrame:
    """About `most` distinct (doc_id, text) of each group of rows, or all where there are fewer: those of small hash.

    Copies of a row count once, and rows that repeat a doc_id are drawn one by one, so no id or copy swells the sample.
    """
    key = F.xxhash64("doc_id", "text")
    # The estimate depends on the rows alone, not on how they are dealt out.
    totals = written(rows.groupBy(group).agg(F.approx_count_distinct(key).alias("quire_distinct")), "sizes")
    if totals.count() <= broadcast_groups:
        totals = F.broadcast(totals)
    # All 64 bits of the hash count, so the sample stays as small however many rows there are.
    drawn = rows.join(totals, group).where(key.cast("double") < most / F.col("quire_distinct") * 2.0**64 - 2.0**63)
    return drawn.select("doc_id", "text", group).dropDuplicates()


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about `most`; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
