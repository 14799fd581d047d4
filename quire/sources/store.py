"""A table of rows by key, in folders by a hash of the key, so that an append or a lookup reads only what it touches.

A key lies in one of BUCKETS folders; in a folder files carry the range of their keys and a Bloom filter of them. An append
reads the keys of the folders that its rows fall into, within the range of its own keys; a lookup of single keys reads one folder, and of
its files those that may hold them. Each append adds one file to a folder that it touches.

A key's first row stays: later appends of it add nothing, so a batch that is tried again is harmless. Among rows of one batch with
the same key the first by `order` counts, and of those the one with the smallest hash. A null is a key too. Two appends
at the same time may add a key twice; let one writer append, as a stream's batches do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.documents import kept

BUCKETS = 64
BUCKET = "key_bucket"


def bucket_of(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(k.cast("string")), F.lit(BUCKETS)).cast("int")


def begun(spark: SparkSession, path: str) -> bool:
    """Whether anything has been appended at path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, with the column BUCKET; a path where nothing has been appended yet is an empty table."""
    whole = T.StructType([f for f in schema.fields if f.name != BUCKET] + [T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(whole).parquet(path) if begun(spark, path) else spark.createDataFrame([], whole)


def first_rows(rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: the first by `order`, then by the row's hash."""
    columns = ["`" + c.replace("`", "``") + "`" for c in rows.columns]
    place = F.struct(*order, F.xxhash64(F.to_json(F.struct(*columns))))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), place).alias("_row")).select("_row.*")


def touched(rows: DataFrame, key: str) -> Column | None:
    """The condition on the table that all keys of rows fulfil: their folders, and the range they lie in; None: there are no rows."""
    told = rows.agg(F.collect_set(BUCKET).alias("buckets"), F.min(key).alias("low"), F.max(key).alias("high"), F.bool_or(F.col(key).isNull()).alias("null")).first()
    if not told["buckets"]:
        return None
    k = F.col(key)
    ranged = [k.between(told["low"], told["high"])] if told["low"] is not None else []
    return F.col(BUCKET).isin(sorted(told["buckets"])) & reduce(lambda a, b: a | b, ranged + ([k.isNull()] if told["null"] else []))


def lacking(rows: DataFrame, path: str, key: str) -> DataFrame:
    """The rows (with BUCKET) whose key the table lacks; only the keys of touched folders are read."""
    some = touched(rows, key)
    if some is None:
        return rows
    known = read(rows.sparkSession, path, rows.schema).where(some).select(F.col(BUCKET).alias("_bucket"), F.col(key).alias("_known"))
    return rows.join(known, (F.col(BUCKET) == F.col("_bucket")) & F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def append(rows: DataFrame, path: str, key: str = "doc_id", order: Sequence[str] = ()) -> None:
    """Append the rows whose key the table at path lacks. rows are made once: where there are keys to hold them against, they are written first."""
    new = first_rows(rows, key, order).withColumn(BUCKET, bucket_of(key))
    fresh = lacking(kept(new, "batch"), path, key) if begun(rows.sparkSession, path) else new
    fresh = fresh.repartition(BUCKET).sortWithinPartitions(BUCKET, key)
    fresh.write.mode("append").partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def get(spark: SparkSession, path: str, schema: T.StructType, key: str, values: Sequence) -> DataFrame:
    """The rows of a few keys: their folders are read, and of their files those whose range and filter let them."""
    kind = schema[key].dataType
    told = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", kind)])).select(bucket_of(F.col("v"))).distinct().collect()
    match = F.col(key).isin([v for v in values if v is not None])
    if any(v is None for v in values):
        match |= F.col(key).isNull()
    return read(spark, path, schema).where(F.col(BUCKET).isin(sorted(r[0] for r in told)) & match).drop(BUCKET)


def find(asked: DataFrame, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The rows whose key is among those of asked (key), any number of them, by a join on folder and key."""
    keys = asked.select(key).distinct().withColumn(BUCKET, bucket_of(key))
    some = touched(keys, key)
    rows = read(asked.sparkSession, path, schema)
    if some is None:
        return rows.limit(0).drop(BUCKET)
    keys = keys.select(F.col(BUCKET).alias("_bucket"), F.col(key).alias("_asked"))
    return rows.where(some).join(keys, (F.col(BUCKET) == F.col("_bucket")) & F.col(key).eqNullSafe(F.col("_asked")), "left_semi").drop(BUCKET)
