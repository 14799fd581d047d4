"""Papers made from the plain table of documents: each gets the lines of a paper around its whole text.

The expressions are plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STARTS = [1, 421, 841, 1261, 1681, 1981, 2281]


def _part(k: int) -> str:
    if k + 1 == len(_STARTS):
        return f"substr(tx, {_STARTS[k]})"
    return f"substr(tx, {_STARTS[k]}, {_STARTS[k + 1] - _STARTS[k]})"


LINES = [
    "concat('Study ', doc_id, ' of Structured Text Variants')",
    "'Ann Lee, Bo Chan and Cy Diaz'",
    "CASE doc_id % 3 WHEN 0 THEN concat('https://doi.org/10.1234/abc.', doc_id, ').') WHEN 1 THEN concat('doi: 10.1234/abc.', doc_id) ELSE 'Technical note' END",
    "CASE WHEN doc_id % 4 = 0 THEN '© 2017 Example Press' ELSE concat('Published ', 1990 + doc_id % 35) END",
    "''", "'Abstract'", "''",
    "CASE WHEN doc_id % 2 = 0 THEN concat('In this paper, we propose a graph neural model for long document retrieval number ', doc_id, '.') ELSE 'A short note.' END",
    _part(0), "''",
    "CASE WHEN doc_id % 5 = 0 THEN '1. Introduction' ELSE 'Introduction' END",
    _part(1), "''", "'12'", "''", "''", "''",
    "'Methodology'",
    "concat('We use the Corpus', doc_id % 7, ' Large dataset and a trans-')",
    "'former ﬁne tuning procedure with “strong” baselines.'",
    _part(2), "''",
    "CASE WHEN doc_id % 6 = 0 THEN 'Experiments' ELSE 'Results' END",
    "CASE WHEN doc_id % 2 = 0 THEN 'Our results show that the model improves recall by nine points on every split.' ELSE 'Numbers follow.' END",
    _part(3), "''",
    "'Discussion'",
    "'One limitation of our approach is that it requires large memory budgets. Our model cannot handle scanned pages without text layers.'",
    "concat('Page ', doc_id % 9, ' of 9')",
    _part(4), "''",
    "'Conclusion'",
    "CASE WHEN doc_id % 3 = 0 THEN 'Future work could explore larger multilingual collections and faster retrieval. It remains an open problem to scale graph inference.' ELSE 'We close here.' END",
    _part(5), "''",
    "CASE WHEN doc_id % 8 = 0 THEN 'Results' ELSE 'Acknowledgments' END",
    _part(6), "''",
    "'References'", "'[1] Someone et al. 2017.'",
]


def papers(docs: DataFrame) -> DataFrame:
    """doc_id, full_text."""
    rows = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("tx"))
    return rows.select("doc_id", F.concat_ws("\n", *map(F.expr, LINES)).alias("full_text"))


#: The same, over a view `documents` in another engine.
PAPERS_SQL = f"SELECT doc_id, concat_ws(chr(10), {', '.join(LINES)}) AS full_text FROM (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS tx FROM documents)"

#: A note without headings, from tx.
NOTE = "concat('A plain note number ', doc_id, chr(10), 'Abstract - ', substr(tx, 1, 600), chr(10), chr(10), substr(tx, 601))"

#: What a file's own metadata may say; some have none.
EMBEDDED = {
    "pdf_title": "CASE doc_id % 4 WHEN 0 THEN concat(' Embedded title ', doc_id, ' ') WHEN 1 THEN 'abc' WHEN 2 THEN '' END",
    "pdf_author": "CASE doc_id % 3 WHEN 0 THEN 'Ann Lee and Bo Chan; Cy Diaz' WHEN 1 THEN ' ' END",
    "pdf_subject": "CASE WHEN doc_id % 2 = 0 THEN concat('graphs, , retrieval ,corpus ', doc_id % 5) END",
}

#: A UUID made from an id, and the fields of a request for a paper.
KEY = "concat(substr(md5(cast({0} as varchar(20))), 1, 8), '-', substr(md5(cast({0} as varchar(20))), 9, 4), '-', substr(md5(cast({0} as varchar(20))), 13, 4), '-', substr(md5(cast({0} as varchar(20))), 17, 4), '-', substr(md5(cast({0} as varchar(20))), 21, 12))"
REQUEST_ID = f"CASE conv_id % 5 WHEN 0 THEN 'not-a-key' WHEN 1 THEN {KEY.format('(0 - 1 - conv_id)')} WHEN 2 THEN upper({KEY.format('conv_id')}) ELSE {KEY.format('conv_id')} END"
REQUEST_QUESTION = "CASE (conv_id + turn) % 7 WHEN 0 THEN 'hi' WHEN 1 THEN '    ' WHEN 2 THEN NULL ELSE text END"

#: A body of JSON from a turn: broken, of other types, nested, with extra fields.
_SAID = "concat(chr(34), replace(replace(translate(text, concat(chr(9), chr(10), chr(13)), '   '), chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(34))"
_BOTH = f"""concat('{{"document_id": "', {KEY.format('(CASE WHEN conv_id % 5 = 1 THEN 0 - 1 - conv_id ELSE conv_id END)')}, '", "question": ', {_SAID}"""
BODY = f"""CASE (conv_id + turn) % 11 WHEN 0 THEN concat('{{"question": ', text) WHEN 1 THEN {_BOTH}, ', "options": {{"language": "de", "top": 3}}}}') WHEN 2 THEN {_BOTH}, ', "zeta": 1, "alpha": [1, null]}}')
    WHEN 3 THEN concat('{{"document_id": "', conv_id, '", "question": 12345}}') WHEN 4 THEN concat('[', {_SAID}, ']') WHEN 5 THEN concat('{{"document_id": null, "question": ', {_SAID}, '}}')
    WHEN 6 THEN 'null' WHEN 7 THEN concat('{{"question": ', {_SAID}, ', "options": "fast"}}') WHEN 8 THEN concat('{{"document_id": "no key", "question": ', {_SAID}, '}}') ELSE {_BOTH}, '}}') END"""

#: A file made of a row of pages: its path, whether the reader finds it, and its content.
FILE = "concat('/in/', page_id, CASE WHEN page_id % 7 = 6 THEN '.txt' ELSE '.PDF' END)"
FILE_FOUND = "page_id % 11 <> 10"
FILE_CONTENT = "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN coalesce(html, '') ELSE concat('%PDF', coalesce(html, '')) END"


def file_texts(content: bytes) -> list[tuple[str, int]]:
    """A stand-in for a page extractor: a page ends at each </p>, and images are tags."""
    if content and not content.startswith(b"%PDF"):
        raise ValueError("no header")
    return [(x, x.count("<img")) for x in content[4:].decode().split("</p>")] if content else []


#: Files of papers, as they are uploaded: names, what makes some of them faulty, and whether the first page has an image.
PDF_NAME = "concat('paper ', doc_id, CASE WHEN doc_id % 17 = 3 THEN '.txt' WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.pdf' END)"
PDF_FAULT = "CASE doc_id % 13 WHEN 5 THEN 'empty' WHEN 7 THEN 'broken' WHEN 9 THEN 'no pages' END"
PDF_IMAGES = "CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END"
PAGE_SIZE = 1500


def _literal(text: str) -> bytes:
    """A string of a PDF: in Latin-1 where that has all its characters, else in UTF-16."""
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        plain = None
    if plain is None or plain.startswith(b"\xfe\xff"):
        return b"<FEFF" + text.encode("utf-16-be", "replace").hex().encode() + b">"
    for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\n", b"\\n")):
        plain = plain.replace(a, b)
    return b"(" + plain + b")"


def _shown(text: str) -> bytes:
    """A page's contents: lines where Latin-1 has all characters, else boxes that ActualText spells out."""
    if any(ord(c) > 255 for c in text):
        return b"/Span <</ActualText " + _literal(text) + b">> BDC BT /F1 9 Tf 60 760 Td (?) Tj ET EMC"
    return b"BT /F1 9 Tf 60 760 Td " + b" T* ".join(_literal(line) + b" Tj" for line in text.split("\n")) + b" ET"


def pdf_of(pages: list[str], info: dict[str, str | None], images: int = 0) -> bytes:
    """A PDF with these pages, whose first one shows an image if images."""
    said = b" ".join(b"/" + k.encode() + b" " + _literal(v) for k, v in info.items() if v is not None)
    kids = b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages)))
    objects = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Count %d /Kids [%s]>>" % (len(pages), kids), b"<<" + said + b">>", b"<</Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8 /Length 1>>\nstream\n0\nendstream"]
    for k, text in enumerate(pages):
        resources = b"<</XObject <</I 4 0 R>>>>" if images and not k else b"<<>>"
        packed = zlib.compress(_shown(text), 1)
        objects.append(b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources %s /Contents %d 0 R>>" % (resources, 6 + 2 * k))
        objects.append(b"<</Length %d /Filter /FlateDecode>>\nstream\n%s\nendstream" % (len(packed), packed))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for number, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d /Root 1 0 R /Info 3 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


@F.arrow_udf(T.BinaryType())
def _files(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for part in parts:
        rows = zip(*(c.to_pylist() for c in part), strict=True)
        yield pa.array([pdf_of(pages, {"Title": t, "Author": a, "Subject": s}, n) for pages, t, a, s, n in rows], pa.binary())


def uploads(docs: DataFrame) -> DataFrame:
    """document_id, file_name, content: papers (doc_id, full_text) as files of pages; some are empty, broken or without pages."""
    cut = f"transform(sequence(1, cast(ceil(greatest(length(full_text), 1) / {PAGE_SIZE}.0) as int)), p -> substr(full_text, {PAGE_SIZE} * (p - 1) + 1, {PAGE_SIZE}))"
    rows = docs.withColumns({c: F.expr(x) for c, x in EMBEDDED.items()} | {"fault": F.expr(PDF_FAULT)})
    rows = rows.withColumn("pages", F.when(F.col("fault") == "no pages", F.expr("cast(array() as array<string>)")).otherwise(F.expr(cut)))
    content = _files(F.col("pages"), F.col("pdf_title"), F.col("pdf_author"), F.col("pdf_subject"), F.expr(PDF_IMAGES))
    rows = rows.select("doc_id", "fault", content.alias("content"))
    content = F.when(F.col("fault") == "empty", F.lit(b"")).when(F.col("fault") == "broken", F.substring("content", 1, 9)).otherwise(F.col("content"))
    return rows.select(F.expr(KEY.format("doc_id")).alias("document_id"), F.expr(PDF_NAME).alias("file_name"), content.alias("content"))
