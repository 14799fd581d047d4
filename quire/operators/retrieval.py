"""Retrieval by cosine, context within a budget, and extractive answers."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import fixed, text
from quire.operators import sections
from quire.sources import documents

LEAST = 0.1


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector has a direction: not null, empty or zero, and without null or NaN components."""
    return F.coalesce(F.exists(embedding, lambda x: x != 0) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)


def _nearest(near: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the largest, ties to the larger id; ids are of the columns, or of each cell."""
    ids = np.broadcast_to(ids, near.shape)
    if near.shape[1] > most:
        # All that reach the last place stay, so that ties are told apart by id.
        last = np.partition(near, -most, axis=1)[:, -most]
        width = int((near >= last[:, None]).sum(axis=1).max())
        at = np.argpartition(-near, width - 1, axis=1)[:, :width]
        near, ids = np.take_along_axis(near, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((-ids, -near), axis=1)[:, :most]
    return np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)


def cosine_top(queries: DataFrame, vectors: DataFrame, most: int = 5, query_rows: int = 20_000) -> DataFrame:
    """query_id, id, score, rank: for each query its nearest vectors with a cosine above 0.1, ties to the larger id.

    queries (query_id, embedding) are taken in blocks of about `query_rows`, dealt by a hash, one after the other: a block
    is collected and broadcast, every task holds the vectors (id, embedding) that it reads against it and hands on only
    the best of each query, the result is written, and the broadcast is given up before the next. So no vector is moved or copied, and
    neither driver nor executor holds more than a block. `clusters.nearest` gives the same rows with one pass over the
    vectors for all queries. Vectors of another length than the query, null and zero ones are left out.
    """
    kind, spark = "query_id long, id long, score double", queries.sparkSession
    queries, vectors = queries.where(usable()).select("query_id", "embedding"), vectors.where(usable()).select("id", "embedding")
    blocks = max(1, -(-queries.count() // query_rows))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id")))
    folder = documents.shared_folder(spark, "nearest")
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(_by_length(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow()))
        best = _against(vectors, shared, most, kind).withColumn("rank", rank).where(F.col("rank") <= most)
        best.write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.schema(f"{kind}, rank int").parquet(folder)


def _by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(names, unit vectors) of each length of vectors; the first column names them."""
    sizes = rows.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(rows) else np.empty(0, int)
    out = {}
    for size in np.unique(sizes).tolist():
        some = rows.take(pa.array(np.flatnonzero(sizes == size)))
        out[size] = (some.column(0).to_numpy(), _unit(some.column("embedding")))
    return out


def _against(vectors: DataFrame, shared, most: int, kind: str) -> DataFrame:
    def search(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, (ids, x) in _by_length(pa.Table.from_batches([batch])).items():
                if size not in shared.value:
                    continue
                y = shared.value[size][1]
                if size not in best:
                    best[size] = (np.full((len(y), most), -2.0), np.zeros((len(y), most), np.int64))
                score, name = best[size]
                for a in range(0, len(y), 256):
                    here = slice(a, a + 256)
                    near, own = _nearest(np.round(y[here] @ x.T, 9), ids, most)
                    score[here], name[here] = _nearest(np.hstack([score[here], near]), np.hstack([name[here], own]), most)
        for size, (score, name) in best.items():
            q = np.repeat(shared.value[size][0], most)
            keep = score.ravel() > LEAST
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(name.ravel()[keep]), pa.array(score.ravel()[keep])], names=["query_id", "id", "score"])

    return vectors.mapInArrow(search, kind)


def _places(t: Column, size: int) -> Column:
    """The place of each word, by the first byte of its hash, in order of place."""
    digits = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 2), 16, 10).cast("int")
    return F.array_sort(F.transform(F.regexp_extract_all(F.lower(t), F.lit(f"{text.WORD}+"), F.lit(0)), lambda w: F.pmod(digits(w), F.lit(size))))


def _counts(places: Column, size: int) -> Column:
    """How often each place comes in a sorted list: with every place once more, counts are the distances of their first ones."""
    marked = F.array_sort(F.concat(places, F.sequence(F.lit(0), F.lit(size))))
    # A list of one holds the sorted places, so that they are found once and not for every component.
    return F.get(F.transform(F.array(marked), lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.array_position(m, k + 1) - F.array_position(m, k) - 1).cast("float"))), F.lit(0))


def hashed_vector(t: Column, size: int = 64) -> Column:
    """A default embedding without a model: counts of words by hash, in up to 256 places."""
    return _counts(_places(t, size), size)


@functools.lru_cache(1 << 18)
def _first_byte(word: str) -> int:
    return hashlib.md5(word.encode()).digest()[0]


def _cosine(size: int):
    """The cosine of the hashed vectors of two texts, from the words in the task that holds them."""

    def counts(t: str) -> list[int]:
        out = [0] * size
        for w in text.all_words(t):
            out[_first_byte(w) % size] += 1
        return out

    @F.arrow_udf(T.DoubleType())
    def near(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        asked = functools.lru_cache(4096)(lambda t: (q := counts(t), math.sqrt(sum(x * x for x in q))))

        def score(question: str | None, t: str | None) -> float | None:
            if question is None or t is None:
                return None
            (q, root), c = asked(question), counts(t)
            return sum(x * y for x, y in zip(q, c, strict=True)) / max(root * math.sqrt(sum(x * x for x in c)), 1e-10)

        for part in parts:
            yield pa.array((score(*row) for row in text.some_rows(*part)), pa.float64())

    return near


def retrieved(questions: DataFrame, chunked: DataFrame, most: int = 5, size: int = 64) -> DataFrame:
    """query_id, rank, score and the columns of chunked: of each question the nearest chunks of its own document.

    questions (query_id, doc_id, question); chunked (doc_id, chunk_id, text, and others). They meet by doc_id, and so a
    question only meets the chunks of one document. The cosine is that of hashed vectors. Scores of 0.1 or less don't count, ties go to the later chunk.
    """
    text.small_batches(questions.sparkSession)
    met = questions.select("query_id", "doc_id", "question").join(chunked, "doc_id")
    met = met.withColumn("score", F.round(_cosine(size)(F.col("question"), F.col("text")), 9)).where(F.col("score") > LEAST).drop("question")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= most)


def contexts(ranked: DataFrame, budget: int = 6000) -> DataFrame:
    """query_id, context, n_chunks from ranked (query_id, rank, text): chunks in order of rank until the first that overflows.

    Where ranked has section_name, page_numbers and score, also sources: struct<section, pages, similarity> of each chunk.
    """
    run = F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    told = {"section_name", "page_numbers", "score"} <= set(ranked.columns)
    each = ["rank", "text"]
    if told:
        section = F.coalesce(F.nullif("section_name", F.lit("")), F.lit(fixed.UNKNOWN_SECTION))
        each.append(F.struct(section.alias("section"), F.col("page_numbers").alias("pages"), F.bround("score", 3).alias("similarity")).alias("source"))
    kept = ranked.withColumn("run", run).where(F.col("run") <= budget)
    rows = F.array_sort(F.collect_list(F.struct(*each)))
    sources = [rows["source"].alias("sources")] if told else []
    return kept.groupBy("query_id").agg(F.array_join(rows["text"], "\n\n").alias("context"), F.count("*").alias("n_chunks"), *sources)


def paper_answers(questions: DataFrame, docs: DataFrame, chunked: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """questions (query_id, doc_id, question) with `result` and `sources`, answered from the chunks of their own document.

    pages (doc_id, page_number, text) are only searched for the chunks that a question has retrieved. A document without
    chunks is answered from the start of its clean_text, without sources; where no chunk is near enough there is no
    context, and so no answer.
    """
    counted = chunked.groupBy("doc_id").agg(F.count("*").alias("_chunks"))
    start = docs.select("doc_id", F.substring("clean_text", 1, 8000).alias("_start")).join(counted, "doc_id", "left")
    told = sections.chunk_pages(retrieved(questions, chunked, most), pages)
    out = questions.join(start, "doc_id").join(contexts(told), "query_id", "left")
    out = out.withColumn("context", F.when(F.col("_chunks").isNull(), F.col("_start")).otherwise(F.coalesce("context", F.lit(""))))
    out = answers(out)
    result = F.when(F.col("context") == "", _not_found(fixed.NO_RELEVANT)).otherwise(F.col("result"))
    return out.withColumn("result", result).select(*questions.columns, "result", "sources")


ANSWER = "struct<answer: string, score: double, found_in_paper: boolean, start: int, end: int>"


def _not_found(message: str) -> Column:
    return F.struct(F.lit(message).alias("answer"), F.lit(0.0).alias("score"), F.lit(False).alias("found_in_paper"), F.lit(0).alias("start"), F.lit(0).alias("end")).cast(ANSWER)


_QUESTION_STOP = frozenset(fixed.QUESTION_STOP_WORDS)


@F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("sent", T.StringType())]))
def _best_sentence(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def best(question: str | None, context: str | None) -> dict | None:
        sents = text.sentence_list(context or "", 15)
        if not sents:
            return None
        words = set(text.all_words(question or ""))
        words = words - _QUESTION_STOP or words
        shared = [len(words.intersection(text.all_words(s))) for s in sents]
        k = shared.index(max(shared))
        return {"score": shared[k] / (len(words) + 0.1), "sent": sents[k]}

    for part in parts:
        yield pa.array((best(*row) for row in text.some_rows(*part)), pa.struct([("score", pa.float64()), ("sent", pa.string())]))


def answers(questions: DataFrame, question: str = "question", context: str = "context") -> DataFrame:
    """questions with `result`: the sentence that shares most of the question's content words, the earlier one on a tie.

    The model-free answer; a narrow pass, as every question carries its context.
    """
    text.small_batches(questions.sparkSession)
    out = questions.withColumn("_best", _best_sentence(F.col(question), F.substring(context, 1, 15_000)))
    start = F.expr(f"locate(_best.sent, `{context}`) - 1")
    hit = F.struct(F.col("_best.sent").alias("answer"), F.round(F.least(F.lit(0.95), F.col("_best.score")), 4).alias("score"), F.lit(True).alias("found_in_paper"), start.alias("start"), (start + F.length("_best.sent")).alias("end")).cast(ANSWER)
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    result = F.when(blank(question) | blank(context) | F.col("_best").isNull(), _not_found(fixed.NO_CONTEXT)).when(F.col("_best.score") > 0.2, hit).otherwise(_not_found(fixed.NO_ANSWER))
    return out.withColumn("result", result).drop("_best")


def question_problem(question: Column) -> Column:
    """Why a question isn't taken: status 422 or 400; null if it is."""
    n = F.length(question)
    return F.when(question.isNull() | (n < 3) | (n > 500), F.lit(422)).when(text.strip(question) == "", F.lit(400))
