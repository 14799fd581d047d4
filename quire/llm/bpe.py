"""BPE encoding and decoding through a table of distinct words.

Texts are split into the tokenizer's words in Spark tasks. A task numbers the distinct words of each chunk of documents
that it reads, the most frequent first, and keeps a document as the numbers of its words, in order: that is the
position by which tokens are joined back. Chunks are written as a table bucketed by chunk, so they are neither made
twice nor shuffled. Their words, a row for each chunk and word, are dealt out by a hash of the word and sorted:
each distinct word is encoded exactly once, and its ids are joined to its place in every chunk that holds it. These go
back to their chunks, where the ids of a document are those of its words, one after the other.

Decoding joins each id of a document to its piece. It is a lookup join by a dense key, not one that Spark plans: each
worker reads the table of pieces (one for each id, so its size is fixed) from the tokenizer's file, and the task that has
put a chunk's ids together takes the pieces by id. Rows of single ids for a planned join would exceed the input on disk.

Chunks are bounded by `chunk_words` and `chunk_distinct` (a longer document is a chunk alone). A word occurs once in a
chunk, so neither a frequent word nor a hot source makes a task uneven.

A null or empty text has no ids and decodes to the empty text. A special token's string inside a text becomes that
token, as the tokenizers library does by default, and decodes to its string; nothing is truncated or padded. Ids that
the vocabulary lacks decode to nothing. Repeated rows, and rows with the same doc_id, each get a row. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words
from quire.llm.shared import give_back, scratch, thrifty

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_OUT_WORDS = 1 << 17  # words of the documents that a task hands on at once


def _packed(numbers: np.ndarray) -> bytes:
    """uint32 numbers, byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _split_chunks(docs: DataFrame, path: str, parts: int, chunk_words: int, chunk_distinct: int) -> DataFrame:
    """A row for each chunk: doc_ids, lengths (words of each document), codes (its words' numbers), words (a sorted JSON
    list for each of the parts that words are dealt to by their hash), numbers (of the words of these lists, in order)."""
    doc_ids = T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType))
    kind = T.StructType([T.StructField("chunk", T.LongType()), doc_ids, *T.StructType.fromDDL("lengths array<int>, codes binary, numbers binary, words array<string>").fields])

    @thrifty
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, first_chunk = words.ByteLevelWords(path), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        number: dict[str, int] = {}
        serial, total = count(first_chunk), 0

        def chunk() -> pa.RecordBatch:
            flat = np.concatenate([*codes, np.empty(0, np.uint32)])
            codes.clear()
            # Frequent words get small numbers, which take less room.
            place = np.empty(len(number), np.uint32)
            place[np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")] = np.arange(len(number))
            dealt: list[list[str]] = [[] for _ in range(parts)]
            for w in sorted(number):
                dealt[crc32(w.encode()) % parts].append(w)
            order = np.fromiter((number[w] for own in dealt for w in own), np.int64, len(number))
            listed = pa.array([json.dumps(own, ensure_ascii=False, separators=(",", ":")) for own in dealt], pa.string())
            doc_ids = pa.concat_arrays(ids)
            blobs = [pa.array([_packed(x)], pa.binary()) for x in (place[flat], place[order])]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (doc_ids, pa.array(lengths, pa.int32()), listed)]
            for x in (ids, lengths, number):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([next(serial)]), lists[0], lists[1], *blobs, lists[2]], names=kind.names)

        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = splitter.split(text)
                codes.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.uint32, len(own)))
                lengths.append(len(own))
                total += len(own)
                if total >= chunk_words or len(number) >= chunk_distinct:
                    ids.append(batch.column("doc_id").slice(first, i + 1 - first))
                    yield chunk()
                    first, total = i + 1, 0
            if first < batch.num_rows:
                ids.append(batch.column("doc_id").slice(first))
        if lengths:
            yield chunk()

    return docs.select("doc_id", "text").mapInArrow(split, kind)


def _id_type(path: str) -> str:
    """How an id is kept inside the binary column of a word's ids."""
    return "<u2" if len(pieces(path)) <= 1 << 16 else "<u4"


def _encode_distinct(lists: DataFrame, path: str, parts: int) -> DataFrame:
    """of_chunk, part, place, tokens of each word of lists (chunk, part, words).

    All lists of a part, and so all rows of a word, meet in one partition, and a word's are sorted next to each other:
    the table of distinct words is the first row of each such run. Only that is encoded, and its ids are joined to all
    rows of the run.
    """
    kind = _id_type(path)

    @thrifty
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, last, last_tokens = words.ByteLevelWords(path), None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word")
            new = np.ones(len(word), bool)
            new[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            new[0] = word[0].as_py() != last
            tokens = [np.array(x, kind).tobytes() for x in splitter.encode(word.filter(pa.array(new)).to_pylist())]
            table = pa.array([last_tokens, *tokens], pa.binary())
            out = table.take(pa.array(np.cumsum(new)))
            last, last_tokens = word[-1].as_py(), out[-1].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("chunk", "part", "place")] + [out], names=["of_chunk", "part", "place", "tokens"])

    listed = F.from_json("words", T.ArrayType(T.StringType()))
    placed = lists.repartitionById(parts, "part").select("chunk", "part", F.posexplode_outer(listed).alias("place", "word")).where("place is not null")
    return placed.sortWithinPartitions("word").mapInArrow(encode, "of_chunk long, part int, place int, tokens binary")


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows as a table in the shared folder, in buckets by key."""
    spark, name = rows.sparkSession, f"quire_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).option("path", scratch(spark, "bpe-chunks")).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved with its buckets; the name isn't needed any more, and the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def encode(docs: DataFrame, path: str, chunk_words: int = 6_000_000, chunk_distinct: int = 400_000, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of every row of docs; decoded: and text, what the ids decode to."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = _bucketed(_split_chunks(docs, path, parts, chunk_words, chunk_distinct), "chunk", parts)
    tokens = _encode_distinct(chunks.select("chunk", F.posexplode("words").alias("part", "words")), path, parts)
    id_type = _id_type(path)

    def assemble(chunk: pa.Table, encoded: pa.Table) -> pa.Table:
        """The ids of each word of the chunk, and by the positions of words those of each document."""
        listed = np.lexsort((encoded.column("place").to_numpy(), encoded.column("part").to_numpy()))
        order = np.empty(len(listed), np.int64)
        order[_unpacked(chunk.column("numbers")[0].as_py())] = listed
        own = pa.concat_arrays([*encoded.column("tokens").chunks, pa.array([], pa.binary())]).take(pa.array(order))
        ends = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, own.offset * 4).astype(np.int64) // np.dtype(id_type).itemsize if len(own) else np.zeros(1, np.int64)
        flat = np.frombuffer(own.buffers()[2], id_type, ends[-1]) if ends[-1] else np.empty(0, id_type)
        codes, doc_ids = _unpacked(chunk.column("codes")[0].as_py()), chunk.column("doc_ids").combine_chunks().flatten()
        edges = np.concatenate([[0], np.cumsum(chunk.column("lengths").combine_chunks().flatten().to_numpy().astype(np.int64))])
        out, first = [], 0
        while first < len(doc_ids):
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + _OUT_WORDS, "right")) - 1)
            word = codes[edges[first] : edges[last]]
            sizes = ends[word + 1] - ends[word]
            place = np.concatenate([[0], np.cumsum(sizes)])
            ids = flat[np.arange(place[-1]) + np.repeat(ends[word] - place[:-1], sizes)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(place[edges[first : last + 1] - edges[first]], pa.int32()), pa.array(ids))
            texts = {"text": _texts(lists, pieces(path))} if decoded else {}
            out.append(pa.RecordBatch.from_pydict({"doc_id": doc_ids.slice(first, last - first), "ids": lists} | texts))
            first = last
        give_back()
        return pa.Table.from_batches(out)

    kind = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("text", T.StringType())] * decoded])
    return chunks.select("chunk", "doc_ids", "lengths", "codes", "numbers").groupBy("chunk").cogroup(tokens.groupBy("of_chunk")).applyInArrow(assemble, kind)


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in pieces: itself where it prints, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The bytes of each id, at its place; empty where the vocabulary has none."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    vocab = d["model"]["vocab"] | {x["content"]: x["id"] for x in d.get("added_tokens") or []}
    alphabet, out = _byte_alphabet(), [b""] * (max(vocab.values()) + 2)
    for piece, i in vocab.items():
        out[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    return pa.array(out, pa.binary())


def _texts(lists: pa.ListArray, table: pa.Array, block: int = 1 << 10) -> pa.Array:
    """Each list of ids as the text of its pieces, bytes that aren't UTF-8 replaced; a null list gives the empty text."""
    out = []
    for part in (lists.slice(a, block) for a in range(0, len(lists), block)):
        ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.where((ids >= 0) & (ids < len(table)), ids, len(table) - 1)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy())])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(ids))), b"")
        try:
            out.append(joined.cast(pa.string()))
        except pa.ArrowInvalid:
            out.append(pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def decoder(path: str) -> Callable[[Column], Column]:
    """A column function from ids to text: each id joined to its piece, by a lookup in the worker's table of pieces."""

    @F.arrow_udf(T.StringType())
    @thrifty
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield _texts(part, pieces(path))

    return decode


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: what the ids of every row of docs decode to, in the task that has joined them."""
    return encode(docs, path, decoded=True)
