"""The five tables of analysed papers: checked, bucketed by document, and switched from version to version at once.

All tables are bucketed and sorted by the document's id in the same way, so joins of a document with what belongs to it
exchange nothing (while there are at least as many buckets as spark.sql.shuffle.partitions; with fewer Spark deals both sides anew). A version is a folder of whole tables; it counts once its number stands in the folder of versions, a file that only one
writer can make: readers see all five tables of one version or of the next, and a job that dies leaves the last one.
Deleting documents makes a version without them and without all that refers to them.

Rules are checked over all rows: ids that are null or repeat, nulls in required columns, a document with two analyses, rows whose
document isn't there. Null document ids break the rule on nulls, not that on references.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.documents import shared_folder

@dataclass(frozen=True)
class Table:
    columns: str
    document: str  # the column with the document's id, by which the table is bucketed
    required: tuple[str, ...]
    unique: tuple[str, ...] = ()


# The tables' names and columns, and the default name of a model.
TABLES = {
    "documents": Table(
        "id string, filename string, file_path string, file_size_bytes long, page_count int, title string, authors string, doi string, publication_year int, abstract string, raw_text string, created_at timestamp, updated_at timestamp",
        "id", ("id", "filename", "file_path", "file_size_bytes", "page_count"),
    ),
    "document_sections": Table(
        "id long, document_id string, section_name string, heading_text string, page_number int, start_char_idx int, end_char_idx int, content string, created_at timestamp",
        "document_id", ("id", "document_id", "section_name", "content"),
    ),
    "document_chunks": Table(
        "id long, document_id string, chunk_index int, section_name string, page_number int, chunk_text string, token_count int, embedding_model string, created_at timestamp",
        "document_id", ("id", "document_id", "chunk_index", "chunk_text"),
    ),
    "document_analyses": Table(
        "id long, document_id string, executive_summary string, research_objective string, methodology string, key_findings string, key_insight string, simple_explanation string, limitations string, keywords string, main_points string, future_research string, model_versions string, processing_time_sec double, created_at timestamp",
        "document_id", ("id", "document_id", "executive_summary"), ("document_id",),
    ),
    "qa_messages": Table(
        "id long, document_id string, question string, answer string, confidence_score double, source_section string, source_page int, context_snippet string, created_at timestamp",
        "document_id", ("id", "document_id", "question", "answer"),
    ),
}
DEFAULTS = {"created_at": F.current_timestamp, "updated_at": F.current_timestamp, "embedding_model": lambda: F.lit("all-MiniLM-L6-v2")}
COMPRESSION = "zstd"
VIOLATIONS = "table_name string, rule string, column_name string, key string, n long"


def conform(rows: DataFrame, name: str) -> DataFrame:
    """rows with the columns of the table, in their order and types; those that rows lack have their default, or are null."""
    have = {c.lower(): c for c in rows.columns}

    def column(f: T.StructField) -> Column:
        if f.name in have:
            return F.col("`" + have[f.name].replace("`", "``") + "`")
        return DEFAULTS[f.name]() if f.name in DEFAULTS else F.lit(None)

    return rows.select(*[column(f).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(TABLES[name].columns)])


def violations(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, rule (null, primary, unique, foreign), column_name, key, n of what breaks a rule in frames (by name, conformed).

    key is the id of a row with a null, the value that repeats, or the document that isn't there; n counts the rows.
    """
    found = []

    def add(rows: DataFrame, name: str, rule: str, column: str, key: Column) -> None:
        told = [F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name")]
        found.append(rows.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(*told, "key", "n"))

    known = frames["documents"].select(F.col("id").alias("_known")).where("_known is not null").distinct()
    for name, rows in frames.items():
        table = TABLES[name]
        nulls = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in table.required]))
        each = rows.select("id", F.explode(nulls).alias("column_name")).groupBy("column_name", F.col("id").cast("string").alias("key")).agg(F.count("*").alias("n"))
        found.append(each.select(F.lit(name).alias("table_name"), F.lit("null").alias("rule"), "column_name", "key", "n"))
        for rule, columns in (("primary", ("id",)), ("unique", table.unique)):
            for c in columns:
                add(rows.where(F.col(c).isNotNull()), name, rule, c, F.col(c))
                found[-1] = found[-1].where("n > 1")
        if name != "documents":
            orphans = rows.where(F.col(table.document).isNotNull()).join(known, F.col(table.document) == F.col("_known"), "left_anti")
            add(orphans, name, "foreign", table.document, F.col(table.document))
    return reduce(DataFrame.unionByName, found)


def dealt(rows: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """rows, written to the shared folder in buckets as the tables are, so that tables made of them, row by row, aren't exchanged once more."""
    folder = shared_folder(rows.sparkSession, label)
    name = f"quire_{hashlib.md5(folder.encode()).hexdigest()[:12]}_{label}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).options(path=folder, compression=COMPRESSION).saveAsTable(name)
    return rows.sparkSession.table(name)


class Database:
    """The tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._mark = hashlib.md5(self.root.encode()).hexdigest()[:12]

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        files, place = self._fs(f"{self.root}/versions")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(place)) if files.exists(place) else []

    def _named(self, version: int, name: str) -> str:
        return f"quire_{self._mark}_{version}_{name}"

    def save(self, frames: dict[str, DataFrame], check: bool = True) -> int:
        """Write the next version; tables that frames lack are empty. check: raise ValueError if a rule is broken."""
        empty = lambda name: self.spark.createDataFrame([], TABLES[name].columns)
        whole = {name: conform(frames[name], name) if name in frames else empty(name) for name in TABLES}
        version = max(self.versions(), default=0) + 1
        folder = f"{self.root}/v{version}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        for name, rows in whole.items():
            key = TABLES[name].document
            # Dealt as the buckets are, so that a bucket is one file; Spark leaves rows where they are if they lie in these buckets.
            placed = rows.repartition(self.buckets, key)
            placed.write.bucketBy(self.buckets, key).sortBy(key).options(path=f"{folder}/{name}", compression=COMPRESSION).saveAsTable(f"{self._named(version, name)}_new")
        written = {name: self.spark.table(f"{self._named(version, name)}_new") for name in TABLES}
        broken = violations(written).limit(3).collect() if check else []
        for name in TABLES:  # the files stay; the tables are known by the version's own names from now on
            self.spark.sql(f"DROP TABLE {self._named(version, name)}_new")
        if broken:
            raise ValueError(f"rules are broken, as by {[tuple(r) for r in broken]}")
        files, place = self._fs(f"{self.root}/versions/{version:09d}")
        out = files.create(place, False)  # fails if another writer was there first
        out.write(bytearray(folder.encode()))
        out.close()
        return version

    def _folder(self, version: int) -> str:
        files, place = self._fs(f"{self.root}/versions/{version:09d}")
        stream = files.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the last one by default, with their buckets."""
        if version is None:
            version = max(self.versions(), default=0)
            if not version:
                return {name: self.spark.createDataFrame([], t.columns) for name, t in TABLES.items()}
        folder = self._folder(version)
        for name, t in TABLES.items():
            by = f"CLUSTERED BY ({t.document}) SORTED BY ({t.document}) INTO {self.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._named(version, name)} ({t.columns}) USING parquet {by} LOCATION '{folder}/{name}'")
        return {name: self.spark.table(self._named(version, name)) for name in TABLES}

    def without(self, documents: DataFrame, column: str = "id") -> dict[str, DataFrame]:
        """The tables without these documents and all that refers to them; only their ids are exchanged."""
        gone = documents.select(F.col(column).cast("string").alias("_gone")).distinct()
        return {name: rows.join(gone, F.col(TABLES[name].document) == F.col("_gone"), "left_anti") for name, rows in self.tables().items()}

    def delete(self, documents: DataFrame, column: str = "id") -> int:
        """The version without these documents; ids that aren't there, and nulls, change nothing."""
        return self.save(self.without(documents, column), check=False)
