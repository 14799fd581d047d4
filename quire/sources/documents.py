"""Documents in: files with an admission check, pages put together; and results out as JSON, each document once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fixed, text

MOST_BYTES = 50 << 20
TYPES = ("application/pdf", "application/octet-stream")
SCANNED_BELOW, LEAST_CHARACTERS = 80, 200
PAGES = "doc_id string, page_number int, raw_text string, char_count int, image_count int, has_text boolean, error string"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors see; of this machine only if all tasks run here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quire-{label}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, label: str) -> DataFrame:
    """rows, written to the shared folder once for all that reads them."""
    path = shared_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, length, content of the files under path, however their suffix is written."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def admission(content: Column, content_type: Column | None = None, most_bytes: int = MOST_BYTES) -> Column:
    """The status of an upload: 415 for another type, 413 if too large, 400 if empty, 422 if it isn't a PDF, else 200."""
    size = F.octet_length(content)
    kind = F.lit(False) if content_type is None else ~F.coalesce(content_type.isin(*TYPES), F.lit(False))
    return F.when(kind, 415).when(size > most_bytes, 413).when(F.coalesce(size, F.lit(0)) == 0, 400).when(F.substring(content, 1, 4) != F.lit(b"%PDF"), 422).otherwise(200)


def file_error(path: str | None, problem: Exception | None = None) -> str:
    """Why a file gives no page: its name, what went wrong when it was opened, or that it has none."""
    name = (path or "").rsplit("/", 1)[-1]
    if not name.lower().endswith(".pdf"):
        return fixed.NOT_PDF + name
    return fixed.NO_PAGES[0] + name + fixed.NO_PAGES[1] if problem is None else f"{fixed.NOT_OPENED[0]}{name}{fixed.NOT_OPENED[1]}{problem}"


def page_rows(path: str | None, content: Any, extract: Callable[[Any], Iterator[tuple[str, int]]]) -> list[tuple]:
    """The rows of PAGES of one file; content: its bytes, or what else the extractor takes."""
    if not (path or "").rsplit("/", 1)[-1].lower().endswith(".pdf"):
        return [(path, None, None, None, None, None, file_error(path))]
    try:
        texts, problem = list(extract(b"" if content is None else content)), None
    except Exception as e:  # whatever an extractor raises is told of its file
        texts, problem = [], e
    found = [(path, k, t, len(t.strip()), n, len(t.strip()) > 10, None) for k, (t, n) in enumerate(texts, 1)]
    return found or [(path, None, None, None, None, None, file_error(path, problem))]


def read_pages(files: DataFrame, extract: Callable[[bytes], Iterator[tuple[str, int]]]) -> DataFrame:
    """Pages of files by an extractor from bytes to (text, number of images) of each page, as `pdf.pages` is one for plain files.

    A file that isn't called *.pdf, that the extractor fails on, or that has no pages, gives one row with `error` and no
    page, so that one bad file stops nothing. A null content counts as empty, a null path as one without a name.
    """

    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame(page_rows(path, content, extract), columns=[c.split()[0] for c in PAGES.split(", ")], dtype=object)

    return files.select("path", "content").mapInPandas(pages, PAGES)


def missing_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """A row with `error`, as of read_pages, for each path of asked, but null, that files lack; paths alone are read and joined."""
    lacking = asked.select("path").where("path is not null").distinct().join(files.select("path"), "path", "left_anti")
    told = {"doc_id": F.col("path"), "error": F.concat(F.lit(fixed.NOT_FOUND), "path")}
    return lacking.select(*[told.get(c.split()[0], F.lit(None).cast(c.split()[1])).alias(c.split()[0]) for c in PAGES.split(", ")])


def documents_of(pages: DataFrame, *others: str, between: str = "\n") -> DataFrame:
    """doc_id, total_pages, full_text, is_scanned, warning of documents whose pages are given; rows without a page are left out.

    others: columns that all pages of a document share; where they don't, the largest value counts. between: what stands
    between two pages; the empty text where pages are cut without regard to lines and words.
    """
    average = F.avg("char_count")
    rows = F.array_sort(F.collect_list(F.struct("page_number", "raw_text")))
    out = pages.where("page_number is not null").groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.array_join(rows["raw_text"], between).alias("full_text"), average.alias("average"), *[F.max(c).alias(c) for c in others])
    return with_warning(out, *others)


def with_warning(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, total_pages, full_text, is_scanned, warning (and others) from docs with the average of characters on a page."""
    scanned = F.col("average") < SCANNED_BELOW
    before, after = fixed.SCANNED
    warning = F.when(scanned, F.concat(F.lit(before), F.bround("average").cast("long").cast("string"), F.lit(after)))
    return docs.select("doc_id", "total_pages", "full_text", scanned.alias("is_scanned"), warning.alias("warning"), *others)


REQUEST = "document_id string, question string"


def requests(bodies: DataFrame, known: DataFrame, body: str = "body") -> DataFrame:
    """bodies with document_id (null unless it is a UUID), question and `status`: the answer that a request for a paper gets.

    422: no JSON object with both fields, or a question of under 3 or over 500 characters; 400: an id that isn't a UUID, or
    a blank question; 404: an id that `known` (document_id) lacks; else 200. A point lookup is the same with one row.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    asked = bodies.withColumn("_r", F.from_json(quoted(body), REQUEST))
    asked = asked.withColumns({"document_id": text.document_key(F.col("_r.document_id")), "question": F.col("_r.question")})
    found = known.select(text.document_key(F.col("document_id")).alias("document_id")).distinct().withColumn("_known", F.lit(True))
    out, n = asked.join(found, "document_id", "left"), F.length("question")
    bad = F.col("_r.document_id").isNull() | F.col("question").isNull() | (n < 3) | (n > 500)
    status = F.when(bad, 422).when(F.col("document_id").isNull(), 400).when(F.col("_known").isNull(), 404).when(text.strip(F.col("question")) == "", 400).otherwise(200)
    return out.withColumn("status", status).select(*map(quoted, bodies.columns), "document_id", "question", "status")


def problem(full_text: Column, clean: Column) -> Column:
    """Why a document isn't analysed; null if it is."""
    return F.when(text.strip(F.coalesce(full_text, F.lit(""))) == "", "no text").when(F.length(clean) < LEAST_CHARACTERS, "too short")


def as_json(rows: DataFrame) -> DataFrame:
    """doc_id and `json`, an object of all other columns; a null stays in it as null."""
    others = F.struct(*[c for c in rows.columns if c != "doc_id"])
    return rows.select("doc_id", F.to_json(others, {"ignoreNullFields": "false"}).alias("json"))
