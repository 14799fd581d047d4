"""Documents put together from pages that arrive as a stream, in any order and any number of batches.

The pages of a document are kept as state until all have come; then the document is emitted, once. One that still lacks
pages when the stream has gone on for `patience` after its last page is emitted as it is, with `complete` false. Time is that
of the pages' arrival, a column, so the same files give the same rows whenever they are read; pages that arrived earlier than the latest
by more than `patience` are too late. Pages that come for a document that has been emitted are left out while its mark is kept, for another
`patience`. A page number that comes again counts once,
the first time it comes; a page without a number, a document or a time is left out. The rows are those that
`documents.documents_of` makes of all pages at once.

A document's state is its pages, as it is one row in the end. Documents are dealt by a hash into GROUPS groups, and what is held of a group
is one state: a call of Python for each document and batch costs far more than the document's pages. A query that fails starts again from its checkpoint with the state as it was, and a
sink that appends by key (`store.append`) takes each document once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.sources import documents, store

#: A checkpoint is of one number of groups. At 100 million documents some 50,000 share one.
GROUPS = 1 << 11
_STATE = "held string"
_FOUND = "doc_id long, held string, complete boolean"
_READ = ["doc_id", "page_number", "raw_text", "char_count", "of_pages", "at"]
_PAGES = "map<string, struct<raw_text: string, char_count: int>>"


def assembled(pages: DataFrame, patience_seconds: int = 600) -> DataFrame:
    """doc_id, total_pages, full_text, is_scanned, warning, complete from a stream of pages (doc_id, page_number, raw_text, char_count, of_pages, arrived).

    of_pages: how many pages the document has.
    """

    def gather(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # By document: its pages (None: it has been emitted), their number as far as it is known, and how long it is held.
        docs, done = json.loads(state.get[0]) if state.exists else {}, []
        watermark, latest = state.getCurrentWatermarkMs(), {}
        for part in () if state.hasTimedOut else parts:
            for doc, number, text, count, of, at in zip(*(part[c].tolist() for c in _READ), strict=True):
                doc = str(doc)
                latest[doc] = max(latest.get(doc, watermark), at)
                held = docs.setdefault(doc, {"pages": {}, "total": 0})
                if held["pages"] is not None:
                    held["pages"].setdefault(str(number), {"raw_text": text, "char_count": None if pd.isna(count) else int(count)})
                    held["total"] = max(held["total"], 0 if pd.isna(of) else int(of))
        for doc, at in latest.items():
            held = docs[doc]
            # The watermark lies `patience` behind the latest page of all.
            held["until"] = at + 1
            if held["pages"] is not None and 0 < held["total"] <= len(held["pages"]):
                done.append((int(doc), json.dumps(held["pages"], ensure_ascii=False), True))
                held["pages"] = None
        for doc in [d for d, held in docs.items() if held["until"] < watermark]:
            pages_held = docs.pop(doc)["pages"]
            if pages_held is not None:
                done.append((int(doc), json.dumps(pages_held, ensure_ascii=False), False))
        if done:
            yield pd.DataFrame(done, columns=["doc_id", "held", "complete"])
        if not docs:
            state.remove()
            return
        state.update((json.dumps(docs, ensure_ascii=False),))
        state.setTimeoutTimestamp(min(held["until"] for held in docs.values()))

    rows = pages.where("doc_id is not null and page_number is not null and arrived is not null").withWatermark("arrived", f"{patience_seconds} seconds")
    rows = rows.select("doc_id", "page_number", "raw_text", "char_count", "of_pages", F.unix_millis("arrived").alias("at"), "arrived", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).alias("group"))
    found = rows.groupBy("group").applyInPandasWithState(gather, _FOUND, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    listed = F.array_sort(F.transform(F.map_entries(F.from_json("held", _PAGES)), lambda e: F.struct(e["key"].cast("int").alias("page_number"), e["value"]["raw_text"].alias("raw_text"), e["value"]["char_count"].alias("char_count"))))
    out = found.withColumn("listed", listed)
    counts = F.array_compact("listed.char_count")
    average = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n) / F.nullif(F.size(counts), F.lit(0))
    whole = out.select("doc_id", F.size("listed").cast("long").alias("total_pages"), F.array_join("listed.raw_text", "\n").alias("full_text"), average.alias("average"), "complete")
    return documents.with_warning(whole, "complete")


def start(pages: DataFrame, out: str, checkpoint: str, available_only: bool = True, patience_seconds: int = 600) -> StreamingQuery:
    """Put the documents of a stream of pages together and append each once to the keyed table at out."""
    writer = assembled(pages, patience_seconds).writeStream.foreachBatch(lambda batch, number: store.append(batch, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_only else writer.trigger(processingTime="1 second")).start()
