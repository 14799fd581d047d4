"""Files in and out: a data source for folders of PDFs, and uploads written as files.

    files.pdfs(spark, folder, "path string, length long, n_pages int, pdf_title string").where("length > 1000")
"""

from __future__ import annotations

import importlib
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from quire.functions import text
from quire.sources import documents, pdf

FILE = "path string, length long, n_pages int, pdf_title string, pdf_author string, pdf_subject string, error string"
PAGE = "page_number int, raw_text string, char_count int, image_count int, has_text boolean"
_FILE, _PAGE = ([c.split()[0] for c in kind.split(", ")] for kind in (FILE, PAGE))
_BATCH = 4 << 20  # characters
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


@dataclass
class Files(InputPartition):
    """(path as rows tell it, path in its file system, length) of the files of a task."""

    files: list[tuple[str, str, int]]


class PdfSource(DataSource):
    """Pages or files of a folder of PDFs.

    A schema says what is read: with any column of PAGE there is a row for each page; with those of FILE alone a row for each file,
    and no text is looked at; with path and length alone no file is opened. Without a schema it is a row for each page with all columns.
    A file that isn't called *.pdf, in any case, that can't be opened or that has no pages gives a row with `error`.

    Options: path, a folder or a file of a scheme that pyarrow knows; suffix (".pdf", in any case; "" takes every file);
    partitionBytes (128 MiB), the bytes of files for each task; extract, "module:function" of an extractor of pages, as
    `documents.read_pages` takes it. Hidden files (. or _ at the start of a name) are left out. With pushFilters,
    for which spark.sql.python.filterPushdown.enabled must be on, conditions on path and length choose files before tasks are made. The driver holds a name for
    each file that is listed, as Spark's own file sources do.
    """

    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return f"{FILE}, {PAGE}"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        named = {k.lower(): v for k, v in self.options.items()}
        # Spark refuses a reader that takes conditions where the session doesn't let it.
        return (_PushingReader if named.get("pushfilters") == "true" else _Reader)(named, schema)


class _Reader(DataSourceReader):
    def __init__(self, named: dict[str, str], schema: T.StructType):
        if "path" not in named:
            raise ValueError("quire_pdf needs a path")
        # Spark makes readers where there is no session that could read a type from text.
        types = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
        known = {name: types[kind] for name, kind in map(str.split, f"{FILE}, {PAGE}".split(", "))}
        for f in schema.fields:
            if known.get(f.name) != f.dataType:
                raise ValueError(f"quire_pdf has no column {f.name} of {f.dataType.simpleString()}; it has {FILE}, {PAGE}")
        self.path, self.suffix = named["path"].rstrip("/"), named.get("suffix", ".pdf").lower()
        self.most, self.extract = int(named.get("partitionbytes", 128 << 20)), named.get("extract", "quire.sources.pdf:pages")
        self.columns, self.types = schema.names, [known[n] for n in schema.names]
        self.conditions: list[tuple[str, Any, Any]] = []

    def _chosen(self, path: str, length: int) -> bool:
        own = {"path": path, "length": length}
        return all(own[c] in value if kind is In else _COMPARED[kind](own[c], value) for c, kind, value in self.conditions)

    def partitions(self) -> list[Files]:
        files, root = FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else files.get_file_info(FileSelector(root, recursive=True))
        out, size = [Files([])], 0
        for f in sorted((f for f in found if f.is_file), key=lambda f: f.path):
            below = f.path[len(root) :].split("/")
            if any(x.startswith((".", "_")) for x in below) or not f.path.lower().endswith(self.suffix):
                continue
            path = self.path + f.path[len(root) :]
            if not self._chosen(path, f.size):
                continue
            # An empty or small file costs a read, too.
            if out[-1].files and size + f.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].files.append((path, f.path, f.size))
            size += f.size + 4096
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        module, _, function = self.extract.partition(":")
        opened, by_page = set(self.columns) - {"path", "length"}, not set(self.columns).isdisjoint(_PAGE)
        counted = not set(self.columns).isdisjoint(_FILE[2:6])
        extract = getattr(importlib.import_module(module), function) if by_page else None
        files, rows, held = FileSystem.from_uri(self.path)[0], [], 0
        for path, place, length in partition.files:
            row = {"path": path, "length": length}
            if opened:
                with files.open_input_file(place) as f:
                    data = content = f.read()
            if opened and (counted or not by_page):
                try:
                    document = pdf.opened(data)
                    # The extractor of this library takes the document that has been opened already.
                    content = document if document and extract is pdf.pages else data
                    row["n_pages"], told = pdf.told(document)
                    row |= {f"pdf_{k.lower()}": v for k, v in told.items()}
                    if not row["n_pages"]:
                        row["error"] = documents.file_error(path)
                except Exception as e:  # whatever is wrong with a file is told of it
                    row["error"] = documents.file_error(path, e)
                if not path.lower().endswith(".pdf"):
                    row = {"path": path, "length": length, "error": documents.file_error(path, None)}
            for page in documents.page_rows(path, content, extract) if by_page else [(None,) * 7]:
                own = row | dict(zip(_PAGE, page[1:6], strict=True))
                rows.append(own | {"error": page[6] or own.get("error")} if by_page else own)
                held += 200 + len(own["raw_text"] or "")
                if held > _BATCH:
                    yield self._batch(rows)
                    rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[t.simpleString()]) for c, t in zip(self.columns, self.types, strict=True)], names=self.columns)


class _PushingReader(_Reader):
    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            compared = _COMPARED.get(type(f), (lambda a, b: a in b) if isinstance(f, In) else None)
            if column in ("path", "length") and compared and f.value is not None:
                self.conditions.append((column, type(f), f.value))
            else:
                yield f


def pdfs(spark: SparkSession, path: str, schema: str | None = None, **options: str | int) -> DataFrame:
    """The files under path by PdfSource, which is registered; conditions choose files early where the session lets them."""
    spark.dataSource.register(PdfSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(PdfSource.name()).options(pushFilters=push, **options)
    return (reader.schema(schema) if schema else reader).load(path)


def save_uploads(uploads: DataFrame, folder: str, spread: bool = True) -> DataFrame:
    """document_id, status, path, length of uploads (document_id, file_name, content), whose files are then in folder.

    An upload with status 200 (`documents.admission`) is written as <document_id>_<safe name>; of others path and length are null.
    With `spread` a file lies in one of 256 folders below, by a hash of its name, as file systems get slow with very many files in one.
    A file appears whole, under its name, when it has been written, so a task that is tried again writes the same. Uploads with
    the same id and name are one file, that of one of them. A null id counts as the empty text. A name of over 200 bytes, more than
    file systems take, is its first 40 characters, a hash of all of it and its suffix.
    """
    name = F.concat(F.coalesce(F.col("document_id").cast("string"), F.lit("")), F.lit("_"), text.safe_file_name(F.col("file_name")))
    cut = F.concat(F.substring(name, 1, 40), F.lit("-"), F.substring(F.md5(name), 1, 8), F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,8})?\z", 0))
    name = F.when(F.octet_length(name) > 200, cut).otherwise(name)
    if spread:
        name = F.concat(F.substring(F.md5(name), 1, 2), F.lit("/"), name)
    rows = uploads.select(F.col("document_id").cast("string").alias("document_id"), name.alias("name"), documents.admission(F.col("content")).alias("status"), "content")
    for below in [f"/{k:02x}" for k in range(256)] if spread else [""]:
        FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1] + below, recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            paths, lengths = [], []
            for file, status, content in zip(batch.column("name").to_pylist(), batch.column("status").to_pylist(), batch.column("content"), strict=True):
                if status != 200:
                    paths.append(None)
                    lengths.append(None)
                    continue
                data = content.as_py()
                below, _, own = f"{root}/{file}".rpartition("/")
                with files.open_output_stream(f"{below}/.{own}-{attempt}", compression=None) as out:
                    out.write(data)
                files.move(f"{below}/.{own}-{attempt}", f"{below}/{own}")
                paths.append(f"{folder}/{file}")
                lengths.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("status"), pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["document_id", "status", "path", "length"])

    return documents.kept(rows.mapInArrow(save, "document_id string, status int, path string, length long"), "uploads")
