"""Counts of what passes through a job, taken while it runs: rows, rejected rows by reason, characters.

`watched` adds the counts to a DataFrame without another pass over it: Spark sums them as rows go by, once for each action. A batch
job reads them from an Observation; the counts of a stream's batches come to a listener. Both are written as rows of one table,
(job, batch, metric, value). A job that fails writes none; a task that is repeated counts once, as Spark takes its counts when it has ended.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

METRICS = "job string, batch long, metric string, value long"


def counts(reason: Column, reasons: list[str], characters: dict[str, Column]) -> list[Column]:
    """rows, accepted, rejected for each of reasons (`reason` is null where a row is taken), and sums of characters."""
    other = reason.isNotNull() & ~reason.isin(reasons)
    told = [F.count(F.lit(1)).alias("rows"), F.count(F.when(reason.isNull(), 1)).alias("accepted"), F.count(F.when(other, 1)).alias("rejected: other")]
    told += [F.count(F.when(reason == r, 1)).alias(f"rejected: {r}") for r in reasons]
    return told + [F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long")).alias(name) for name, c in characters.items()]


def watched(rows: DataFrame, name: str | Observation, *told: Column) -> DataFrame:
    """rows, whose counts go to an Observation, or in a stream to listeners by this name."""
    return rows.observe(name, *told)


def record(spark: SparkSession, path: str, job: str, values: dict[str, int], batch: int = 0) -> None:
    """Append the counts of a run to the table at path."""
    rows = [(job, batch, metric, int(value)) for metric, value in values.items() if value is not None]
    spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(path)


class Listener(StreamingQueryListener):
    """Keeps the counts of the batches of streams until `record` writes them; add it with spark.streams.addListener."""

    def __init__(self, names: list[str]):
        self.names, self.seen = names, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        for name in self.names:
            if (told := (progress.get("observedMetrics") or {}).get(name)) is not None:
                self.seen.append((name, progress["batchId"], told))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def record(self, spark: SparkSession, path: str) -> None:
        """Write what has come in so far; a batch that is told twice is written once."""
        seen, self.seen = self.seen, []
        for (name, batch), told in {(n, b): t for n, b, t in seen}.items():
            record(spark, path, name, told, batch)
