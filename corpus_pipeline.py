"""From raw documents to token ids: five stages, each an operator of quire.llm applied to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontamination, language_id, simhash, toxicity
from quire.llm.shared import read_table, small_batches, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def toxic_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the classifier learns from those of docs that are labelled."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def unknown_languages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie too far from every language's centroids, or have no letter, go."""
    small_batches(spark)
    return language_id.keep_known(docs, language_id.fit(docs))


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays."""
    small_batches(spark)
    return simhash.keep_one(docs)


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document of which nothing else is left goes."""
    small_batches(spark)
    return decontamination.remove_spans(docs, read_table(spark, sf_dir, "benchmark"))


def texts_become_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, text (decoded from the ids), n_tokens, ids_sha256, decoded_sha256 of each document."""
    small_batches(spark)
    coded = bpe.encode_and_decode(docs, TOKENIZER)
    listed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", "ids", "text", F.size("ids").cast("long").alias("n_tokens"), listed.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_go),
    ("language_id", unknown_languages_go),
    ("simhash_dedup", near_copies_go),
    ("decontamination", benchmark_passages_go),
    ("bpe", texts_become_ids),
]

#: Learnt models, fingerprints' components and merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
