"""The five tables: rules, versions, cascades and joins without exchanges; pages as a stream; metrics."""

import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quire.sources import documents, metrics, store, tables
from quire.streaming import pages


def frames_of(spark, n=6):
    docs = spark.range(n).select(F.concat(F.lit("d"), "id").alias("id"), F.lit("f.pdf").alias("filename"), F.lit("/in").alias("file_path"), F.lit(1).alias("file_size_bytes"), F.lit(2).alias("page_count"), F.lit("x").alias("extra"))
    rows = spark.range(3 * n).select("id", F.concat(F.lit("d"), F.col("id") % n).alias("document_id"))
    return {
        "documents": docs,
        "document_sections": rows.withColumns({"section_name": F.lit("abstract"), "content": F.lit("text")}),
        "document_chunks": rows.withColumns({"chunk_index": F.col("id"), "chunk_text": F.lit("text")}),
        "document_analyses": rows.where(F.col("id") < n).withColumn("executive_summary", F.lit("s")),
        "qa_messages": rows.withColumns({"question": F.lit("q"), "answer": F.lit("a")}),
    }


def test_rules(spark):
    frames = {k: tables.conform(v, k) for k, v in frames_of(spark).items()}
    assert tables.violations(frames).count() == 0 and tables.violations({k: v.limit(0) for k, v in frames.items()}).count() == 0
    odd = spark.createDataFrame([(1, "d1", "s", "t"), (1, "d1", None, "t"), (None, "nobody", "s", "t"), (None, "nobody", "s", None), (7, None, "s", "t")], "id long, document_id string, section_name string, content string")
    twice = spark.createDataFrame([(1, "d1", "a"), (2, "d1", "b"), (3, None, "c"), (4, None, "d")], "id long, document_id string, executive_summary string")
    double = frames["documents"].unionByName(frames["documents"].limit(1))
    got = {tuple(r) for r in tables.violations({"documents": double, "document_sections": tables.conform(odd, "document_sections"), "document_analyses": tables.conform(twice, "document_analyses")}).collect()}
    first = frames["documents"].limit(1).first().id
    s, a = "document_sections", "document_analyses"
    assert got == {("documents", "primary", "id", first, 2), (s, "primary", "id", "1", 2), (s, "null", "section_name", "1", 1), (s, "null", "id", None, 2), (s, "null", "content", None, 1), (s, "null", "document_id", "7", 1),
                   (s, "foreign", "document_id", "nobody", 2), (a, "unique", "document_id", "d1", 2), (a, "null", "document_id", "3", 1), (a, "null", "document_id", "4", 1)}


def test_columns_are_conformed(spark):
    rows = tables.conform(spark.createDataFrame([(5, "T")], "ID int, chunk_Text string"), "document_chunks")
    r = rows.first()
    assert (r.id, r.chunk_text, r.document_id, r.embedding_model) == (5, "T", None, "all-MiniLM-L6-v2") and r.created_at is not None
    assert rows.columns == [c.split()[0] for c in tables.TABLES["document_chunks"].columns.split(", ")]


def test_versions_and_cascades(spark, tmp_path):
    data = tables.Database(spark, f"file://{tmp_path}/db", 4)
    assert data.versions() == [] and all(t.count() == 0 for t in data.tables().values())
    assert data.save(frames_of(spark)) == 1
    old = data.tables()
    gone = spark.createDataFrame([("d1",), ("d1",), ("d4",), ("nobody",), (None,)], "id string")
    assert data.delete(gone) == 2 and data.versions() == [1, 2]
    new = tables.Database(spark, f"file://{tmp_path}/db", 4).tables()
    assert {k: t.count() for k, t in new.items()} == {"documents": 4, "document_sections": 12, "document_chunks": 12, "document_analyses": 4, "qa_messages": 12}
    assert old["documents"].count() == 6 and data.tables(1)["qa_messages"].count() == 18  # readers of the last version keep it
    assert tables.violations(new).count() == 0


def test_joins_by_document_exchange_nothing(spark, tmp_path):
    data = tables.Database(spark, f"file://{tmp_path}/db", 8)
    data.save(frames_of(spark))
    t = data.tables()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = t["documents"].withColumnRenamed("id", "document_id").join(t["document_chunks"].drop("id", "created_at"), "document_id").join(t["document_analyses"].select("document_id", "executive_summary"), "document_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 18
        plan = data.without(spark.createDataFrame([("d1",)], "id string"))["document_chunks"]._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "hashpartitioning(document_id" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broken_rules_and_second_writers_change_nothing(spark, tmp_path):
    data = tables.Database(spark, f"file://{tmp_path}/db", 4)
    data.save(frames_of(spark))
    frames = frames_of(spark)
    frames["documents"] = frames["documents"].where("id <> 'd2'")
    with pytest.raises(ValueError, match="foreign"):
        data.save(frames)
    assert data.versions() == [1] and data.tables()["documents"].count() == 6
    other = tables.Database(spark, f"file://{tmp_path}/db", 4)
    other.versions = lambda: []  # one that hasn't seen the first version
    with pytest.raises(Exception, match="exist"):
        other.save(frames_of(spark, 2))
    assert data.versions() == [1] and data.tables()["documents"].count() == 6


# -- pages as a stream --

PAGE = "doc_id long, page_number int, raw_text string, char_count int, of_pages int"
TIMED = f"{PAGE}, arrived timestamp"


def put(spark, folder, rows, second=5000):
    spark.createDataFrame(rows, PAGE).withColumn("arrived", F.timestamp_seconds(F.lit(second))).coalesce(1).write.mode("append").parquet(folder)


def test_pages_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(d, p, f"page {p} of {d} " * 5, None if d == 3 and p == 2 else 60, n) for d, n in ((1, 3), (2, 1), (3, 4), (4, 12)) for p in range(1, n + 1)]
    want = {r.doc_id: (r.total_pages, r.full_text, r.is_scanned, r.warning) for r in documents.documents_of(spark.createDataFrame(rows, PAGE)).collect()}
    odd = [(None, 1, "x", 1, 1), (9, None, "x", 1, 1), (5, 1, "lacks the second", 16, 2)]
    for k in range(2):
        folder, order = f"file://{tmp_path}/{k}", rows + rows[:4] + odd
        rng.shuffle(order)
        for i in range(0, len(order), 5):
            put(spark, f"{folder}/in", order[i : i + 5])
            pages.start(spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        got = spark.read.parquet(f"{folder}/out").collect()
        assert {r.doc_id: (r.total_pages, r.full_text, r.is_scanned, r.warning) for r in got} == want and len(got) == 4 and all(r.complete for r in got)


def test_incomplete_documents_are_emitted_late(spark, tmp_path):
    folder = f"file://{tmp_path}"

    def run(rows, second):
        put(spark, f"{folder}/in", rows, second)
        pages.start(spark.readStream.schema(TIMED).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", patience_seconds=60).awaitTermination()
        return {r.doc_id: r for r in spark.read.parquet(f"{folder}/out").collect()}

    got = run([(1, 2, "second", 6, 3), (2, 1, "whole", 5, 1)], 1000)
    assert set(got) == {2} and got[2].complete
    assert set(run([(4, 1, "other", 5, 2)], 1050)) == {2}  # within its patience
    got = run([(3, 1, "new", 3, 1)], 1100)
    assert set(got) == {1, 2, 3} and not got[1].complete and (got[1].full_text, got[1].total_pages) == ("second", 1)
    got = run([(4, 2, "in time", 7, 2), (1, 1, "too late", 8, 3)], 1105)
    assert got[4].full_text == "other\nin time" and got[4].complete and got[1].full_text == "second"


@pytest.mark.parametrize("groups", [1, 2])
def test_documents_that_share_a_state(spark, tmp_path, monkeypatch, groups):
    """A call of Python and a state for each group, not for each document: the documents are those of states of their own."""
    monkeypatch.setattr(pages, "GROUPS", groups)
    for k, test in enumerate((test_pages_in_any_order, test_incomplete_documents_are_emitted_late)):
        test(spark, tmp_path / str(k))


# -- metrics --


def test_metrics_of_batches_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, "empty"), (3, "x", "short"), (4, "yy", "strange")], "id long, t string, problem string")
    told = metrics.counts(F.col("problem"), ["empty", "short", "never"], {"characters": F.length("t")})
    want = {"rows": 4, "accepted": 1, "rejected: other": 1, "rejected: empty": 1, "rejected: short": 1, "rejected: never": 0, "characters": 6}
    seen = Observation("batch")
    metrics.watched(rows, seen, *told).write.format("noop").mode("overwrite").save()
    assert seen.get == want
    metrics.record(spark, f"file://{tmp_path}/m", "batch", seen.get)

    nothing = Observation("none")
    metrics.watched(rows.limit(0), nothing, *told).write.format("noop").mode("overwrite").save()
    assert set(nothing.get.values()) == {0}

    listener = metrics.Listener(["stream"])
    spark.streams.addListener(listener)
    try:
        for k in range(2):
            rows.write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
            metrics.watched(stream, "stream", *told).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        end = time.time() + 30
        while len(listener.seen) < 2 and time.time() < end:
            time.sleep(0.5)
        listener.record(spark, f"file://{tmp_path}/m")
    finally:
        spark.streams.removeListener(listener)
    got = {}
    for r in spark.read.parquet(f"file://{tmp_path}/m").collect():
        got.setdefault((r.job, r.batch), {})[r.metric] = r.value
    assert got == {("batch", 0): want, ("stream", 0): want, ("stream", 1): want} and listener.seen == []
