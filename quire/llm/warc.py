"""WARC archives, index first: a table of file, offset, length, URL and digest for each record; selected records are then
read by sorted byte ranges, neighbours in one read.

Each record is a gzip member of its own in an archive of bounded size. A response holds an HTTP head and the payload; a
revisit of an equal payload holds the head only, with the payload's length and digest, and refers to the response. Of
records with equal payloads of at least `least_bytes`, that with the largest page_id is the response; smaller payloads
always are responses.

A null html is an empty payload, a null url leaves the header out, line ends in a url are escaped. Rows that repeat the
response's page_id and payload are responses too. A null page_id is never the response of a payload that another page
has. Other columns are not read. Archives are named by task attempt and the index, a table that Spark commits, names
the archives that count, so what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.shared import thrifty, written

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, compressed; digest is bare base32."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if revisit:
        head |= {"WARC-Refers-To": _record_id(refers_to, digest), "WARC-Profile": _REVISIT, "X-Refers-To-Page": refers_to}
    if page_id is not None:
        head["X-Page"] = page_id
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a compressed record."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return headers, http, payload


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 128 << 20, date: str = "1970-01-01T00:00:00Z", broadcast_marks: int = 500_000) -> DataFrame:
    """Write pages (page_id, url, html) as archives under folder, which all executors see; returns their index.

    Up to `broadcast_marks` revisits (an id, a digest and an id each) are broadcast.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    # Only ids and digests meet by digest. The pages themselves stay where they are while the marks of revisits can be
    # broadcast; else they meet by page_id, which no hot payload makes uneven.
    same = pages.where(F.octet_length("html") >= least_bytes).select("page_id", "sha1")
    keeper = same.groupBy("sha1").agg(F.max("page_id").alias("refers_to"))
    revisits = same.distinct().join(keeper, "sha1").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = written(revisits.select(F.col("page_id").alias("r_page"), F.col("sha1").alias("r_sha1"), "refers_to"), "revisits")
    if revisits.count() <= broadcast_marks:
        revisits = F.broadcast(revisits)
    decided = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha1") == F.col("r_sha1")), "left").select("page_id", "url", "html", "sha1", "refers_to")

    names = [c.split()[0] for c in INDEX.split(", ")]

    @thrifty
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, out, at, name = TaskContext.get(), 0, None, 0, ""
        files, root = FileSystem.from_uri(folder)
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, n, at = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz", n + 1, 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    body, digest = html.encode("utf-8", "surrogatepass"), base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = record(page_id, url, body, digest, refers_to, refers_to is not None, date)
                    out.write(member)
                    rows.append((page_id, url, digest, len(body), "response" if refers_to is None else "revisit", refers_to, name, at, len(member)))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    spark = pages.sparkSession
    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1], recursive=True)
    decided.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(selected: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """The records of the selected rows of an index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit).

    The ranges are dealt to tasks in order, about `task_bytes` of archives to each. Reads of the same archive that lie within
    `gap` bytes become one, up to `most` bytes. A response whose payload
    doesn't have its digest or length fails the task.
    """
    kind = T.StructType.fromDDL("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")

    @thrifty
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder)
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            ranges: list[list] = []
            for archive, offset, length in places:
                last = ranges[-1] if ranges else None
                if last and last[0] == archive and 0 <= offset - last[2] <= gap and offset + length - last[1] <= most:
                    last[2] = offset + length
                    last[3].append((offset, length))
                else:
                    ranges.append([archive, offset, offset + length, [(offset, length)]])
            for archive, start, end, members in ranges:
                with files.open_input_file(f"{root}/{archive}") as f:
                    data = f.read_at(end - start, start)
                rows = []
                for offset, length in members:
                    headers, http, payload = parsed(data[offset - start : offset - start + length])
                    size, digest = int(http.rpartition(b"Content-Length: ")[2]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{archive} at {offset}: the payload isn't what its header says")
                    page, refers = (int(headers[k]) if k in headers else None for k in ("X-Page", "X-Refers-To-Page"))
                    rows.append((page, headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], refers, None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=kind.names)

    # Their number follows the bytes in the archives, of which the index rows that are exchanged say nothing to Spark.
    parts = math.ceil((selected.agg(F.sum("length")).first()[0] or 1) / task_bytes)
    ranges = selected.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(read, kind)
