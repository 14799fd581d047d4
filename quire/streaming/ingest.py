"""Ingest of arriving documents: a file stream, cleaned by the same functions, appended once per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import text
from quire.operators import sections
from quire.sources import store


def arriving(spark: SparkSession, path: str, schema: str = "doc_id long, full_text string", files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def start(stream: DataFrame, out: str, checkpoint: str, available_only: bool = True) -> StreamingQuery:
    """Clean and segment what arrives and append it to the table at out; a batch that is tried again adds nothing twice."""
    docs = stream.withColumn("clean_text", text.without_references(text.clean_text(F.col("full_text"))))

    def write(batch: DataFrame, number: int) -> None:
        store.append(sections.with_sections(batch), out)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_only else writer).start()
