"""Token counts through a digest cache.

The cache is a table (content_digest, tokenizer_digest, n_tokens) in a shared folder, partitioned by tokenizer_digest.
Digests of the normalised texts are joined to it; of those it lacks, each distinct text is encoded once and the counts
are appended. Counts come from the cache, also of texts that were just encoded.

Texts are read again for the misses only. Up to `broadcast_misses` digests are broadcast to the texts, and no other text
moves. More of them set bits in a map of 2 ** BITS places, broadcast instead (16 MB, however many there are): a text whose
bit isn't set stays where it is, so of the texts in the cache about misses / 2 ** BITS move, until the exact join by digest.
 Normalising may not change a count, so a text is only made non-null,
and run through the tokenizer file's own normaliser where it has one.

Kinds of tokenizer files: `.json` (tokenizers) and `.model` (sentencepiece), without begin, end or added special
tokens, truncation or padding; special strings inside a text are handled as each library does by default.

Null and empty texts have no tokens. Repeated texts, whole or across documents, are encoded once; rows with the same
doc_id each get a row. Other columns are not read. An appended row that a lost and repeated task wrote is left out by
Spark's output commit; rows that two runs at once append twice agree, and the join takes one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.shared import scratch, thrifty, whole_text, written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
BITS = 27  # places of the map of misses, as a power of two
_KNOWN_WORDS = 1 << 17  # words whose count a task remembers


def _counter(path: str):
    """A function from texts to their token counts."""
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    whole, plain = words.tokenizer(path), words.byte_level(path)
    if plain is None:
        return lambda texts: [len(e.ids) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out = []
        for first in range(0, len(texts), 256):
            split = [plain.split(t) for t in texts[first : first + 256]]
            new = [w for w in dict.fromkeys(w for s in split for w in s) if w not in known]
            if len(known) + len(new) > _KNOWN_WORDS:
                known.clear()
                new = list(dict.fromkeys(w for s in split for w in s))
            known.update(zip(new, map(len, plain.encode(new)), strict=True))
            out += [sum(map(known.__getitem__, s)) for s in split]
        return out

    return count


def _normalised(text: Column, path: str) -> Column:
    own = None if path.endswith(".model") else words.tokenizer(path).normalizer
    if own is None:
        return text

    @F.arrow_udf("string")
    def normalise(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n = words.tokenizer(path).normalizer
        for part in parts:
            yield pa.array([n.normalize_str(t) for t in part.to_pylist()], pa.string())

    return normalise(text)


def read_cache(spark: SparkSession, cache: str, tokenizer_digest: str) -> DataFrame:
    """One row for each content digest of this tokenizer version, whose folder alone is read."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == tokenizer_digest)
    return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _place(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(1 << BITS))


def _marked(misses: DataFrame) -> DataFrame:
    """quire_part, quire_bits: the places of the misses, 32,768 to a row; at most 2 ** BITS / 32,768 rows of 4 KB."""
    at = misses.select(_place(F.col("content_digest")).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("quire_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("quire_bits"))


def perhaps_missing(texts: DataFrame, misses: DataFrame) -> DataFrame:
    """The rows of texts whose digest may be among the misses: all that are, and few others; no row moves."""
    kept = texts.withColumn("quire_at", _place(F.col("content_digest")))
    kept = kept.join(F.broadcast(_marked(misses)), F.bitmap_bucket_number("quire_at") == F.col("quire_part"))
    bit = F.bitmap_bit_position("quire_at")
    byte = F.conv(F.hex(F.substring("quire_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return kept.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*texts.columns)


def _append(rows: DataFrame, cache: str) -> None:
    rows.write.mode("append").partitionBy("tokenizer_digest").parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512, broadcast_misses: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs. cache: a folder that all executors see; None: a new one.

    Digests alone are joined to the cache. Texts are only read again for those that it lacks: up to `broadcast_misses`
    digests (32 bytes each) are broadcast to the texts; more are broadcast as bits, and what passes meets them by digest in one exchange.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-cache")
    version = words.digest_of(path)
    _append(spark.createDataFrame([], CACHE_SCHEMA), cache)  # so that it can be read
    text = whole_text()
    digest = F.unhex(F.sha2(_normalised(text, path), 256)).alias("content_digest")
    keyed = written(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest), "token-digests")
    misses = keyed.select("content_digest").distinct().join(read_cache(spark, cache, version), "content_digest", "left_anti")
    misses = written(misses, "token-misses")
    missing = misses.count()

    @thrifty
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            n = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    if missing:
        # Equal texts meet in the task that reads them, and then once more by digest.
        texts = docs.select(digest, text.alias("text"))
        if missing <= broadcast_misses:
            texts = texts.join(F.broadcast(misses), "content_digest", "left_semi")
        elif read_cache(spark, cache, version).limit(1).count():  # else nothing would stay
            texts = perhaps_missing(texts, misses)
        distinct = texts.groupBy("content_digest").agg(F.first("text").alias("text"))
        if missing > broadcast_misses:
            distinct = distinct.join(misses, "content_digest", "left_semi")
        _append(distinct.mapInArrow(encode, CACHE_SCHEMA), cache)
    # Written, so that the join's sides are bare exchanges: Spark then splits the partition of a text with very many copies.
    counts = written(read_cache(spark, cache, version), "token-counts")
    counted = keyed.join(counts, "content_digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
