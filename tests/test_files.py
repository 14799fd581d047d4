"""PDFs as files: the reader, the data source, uploads; and JSON as VARIANT."""

import json
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans import fixtures
from quire.sources import documents, files, pdf, variants

TEXTS = ["One line", "two\nlines (with) [brackets] \\ and é", "", "\n\nstarts late", "deep ﬁne “quotes” 語 and\nmore 🎈 ((", "tab\tand\rreturn", "ends\n"]


def test_pages_round_trip():
    data = fixtures.pdf_of(TEXTS, {"Title": "A (b) \\c", "Author": None, "Subject": "語"}, 1)
    assert list(pdf.pages(data)) == [(t, int(not k)) for k, t in enumerate(TEXTS)]
    assert pdf.told(data) == (len(TEXTS), {"Title": "A (b) \\c", "Author": None, "Subject": "語"})
    assert list(pdf.pages(b"")) == [] and pdf.told(b"") == (0, dict.fromkeys(pdf.INFO))


def test_object_streams_and_operators():
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Kids[4 0 R 2 0 R]/Count 1>>", b"<</Type/Page/Contents[6 0 R 9 0 R]/Resources 5 0 R>>", b"<</XObject<</A 7 0 R/B 8 0 R>>>>"]
    numbers, at, places = (1, 2, 4, 5), 0, []
    for n, x in zip(numbers, inner, strict=True):
        places += [n, at]
        at += len(x) + 1
    head = " ".join(map(str, places)).encode() + b" "
    packed = zlib.compress(head + b" ".join(inner))
    show = b"BT (a\\)\\050\\\nb) Tj [(c)-20<64 65 6>] TJ T* (d) ' 1 0 (e) \" ET BT (f (g) h) Tj ET"
    data = b"%%PDF-1.5\n3 0 obj<</Type/ObjStm/N 4/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n" % (len(head), len(packed), packed)
    data += b"6 0 obj<<>>stream\n%s\nendstream endobj 7 0 obj<</Subtype/Image>>endobj 8 0 obj<</Subtype/Form>>endobj 10 0 obj<</Type/XRef/Root 1 0 R>>stream\n\nendstream endobj" % show
    assert list(pdf.pages(data)) == [("a)(bcde`\n\nd\ne\nf (g) h", 1)]


@pytest.mark.parametrize("data, why", [(b"text", "header"), (b"%PDF-1.4", "no catalogue"), (b"%PDF trailer <</Root 1 0 R /Encrypt 2 0 R>>", "encrypted"), (b"%PDF 1 0 obj <</Pages 2 0 R>> endobj 2 0 obj <</Type /Page /Contents 3 0 R>> endobj 3 0 obj <</Filter /LZWDecode>> stream\nx\nendstream endobj trailer <</Root 1 0 R>>", "LZWDecode")])
def test_faulty_files(data, why):
    with pytest.raises(ValueError, match=why):
        list(pdf.pages(data))


def folder_of(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(fixtures.pdf_of(["first page of a", "x"], {"Title": "T"}))
    (tmp_path / "sub" / "b.PDF").write_bytes(b"plain")
    (tmp_path / "sub" / "empty.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(fixtures.pdf_of(["x"], {}))
    (tmp_path / ".hidden.pdf").write_bytes(b"x")
    (tmp_path / "sub" / "_temporary.pdf").write_bytes(b"x")
    return f"file://{tmp_path}"


def test_source(spark, tmp_path):
    root = folder_of(tmp_path)
    rows = {(r.path[len(root) :], r.page_number): r for r in files.pdfs(spark, root).collect()}
    assert set(rows) == {("/a.pdf", 1), ("/a.pdf", 2), ("/sub/b.PDF", None), ("/sub/empty.pdf", None)}
    a, b = rows["/a.pdf", 1], rows["/sub/b.PDF", None]
    assert (a.raw_text, a.char_count, a.image_count, a.has_text, a.n_pages, a.pdf_title, a.pdf_author, a.error, a.length) == ("first page of a", 15, 0, True, 2, "T", None, None, (tmp_path / "a.pdf").stat().st_size)
    assert not rows["/a.pdf", 2].has_text and (b.n_pages, b.error) == (None, "Cannot open PDF 'b.PDF': no PDF header")
    assert rows["/sub/empty.pdf", None].error == "PDF 'empty.pdf' contains no pages."
    texts = files.pdfs(spark, root, "path string, error string", suffix="").where("path like '%c.txt'").collect()
    assert [r.error for r in texts] == ["File is not a PDF: c.txt"]
    assert files.pdfs(spark, f"{root}/a.pdf", "n_pages int").collect() == [(2,)]
    with pytest.raises(Exception, match="no column wrong"):
        files.pdfs(spark, root, "wrong string").collect()
    with pytest.raises(Exception, match="nowhere"):
        files.pdfs(spark, f"{root}/nowhere").collect()
    (tmp_path / "none").mkdir()
    assert files.pdfs(spark, f"{root}/none").count() == 0


def test_only_asked_columns_are_made(spark, tmp_path):
    root = folder_of(tmp_path)
    # An extractor that isn't there isn't looked for where no column of pages is asked for.
    assert {r.n_pages for r in files.pdfs(spark, root, "path string, n_pages int", extract="no.such:module").collect()} == {2, 0, None}
    assert {r.length > 0 for r in files.pdfs(spark, root, "length long", extract="no.such:module").collect()} == {True, False}
    with pytest.raises(Exception, match="no.such|No module"):
        files.pdfs(spark, root, "raw_text string", extract="no.such:module").collect()


def test_tasks_by_bytes_and_conditions(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k:02}.pdf").write_bytes(fixtures.pdf_of([f"page {k}"] * (k + 1), {}))
    root = f"file://{tmp_path}"
    size = sum(p.stat().st_size for p in tmp_path.iterdir()) + 12 * 4096
    assert files.pdfs(spark, root, partitionBytes=size // 4).rdd.getNumPartitions() in (4, 5, 6)
    key = "spark.sql.python.filterPushdown.enabled"
    try:
        spark.conf.set(key, "true")
        few = files.pdfs(spark, root, partitionBytes=1).where(F.col("path").endswith("03.pdf") | F.col("path").endswith("04.pdf"))
        one = files.pdfs(spark, root, partitionBytes=1).where(F.col("path").endswith("03.pdf"))
        some = files.pdfs(spark, root, "path string, length long", partitionBytes=1).where((F.col("length") > 0) & F.col("path").isin(f"{root}/05.pdf", f"{root}/06.pdf") & F.col("path").contains("6"))
        assert one.rdd.getNumPartitions() == 1 and one.count() == 4 and some.rdd.getNumPartitions() == 1 and some.count() == 1
        assert few.rdd.getNumPartitions() == 12 and few.count() == 9  # a choice of two isn't handed on
        assert files.pdfs(spark, root).where("page_number = 2 and raw_text = 'page 7'").count() == 1
    finally:
        spark.conf.unset(key)
    assert files.pdfs(spark, root, partitionBytes=1).where(F.col("path").endswith("03.pdf")).count() == 4


def test_uploads(spark, tmp_path):
    body = fixtures.pdf_of(["a page of text"], {})
    rows = [("k1", "../my paper.pdf", body), ("k1", "../my paper.pdf", body), ("k2", "x" * 300 + ".PDF", body), ("k3", "é" * 150 + ".pdf", body), ("k4", None, body), (None, "n.pdf", body), ("k5", "empty.pdf", b""), ("k6", "null.pdf", None), ("k7", "text.pdf", b"text")]
    folder = f"file://{tmp_path}/in"
    uploads = spark.createDataFrame(rows, "document_id string, file_name string, content binary").withColumn("path", F.lit("clash"))
    for _ in range(2):
        saved = files.save_uploads(uploads, folder).collect()
    assert sorted(r.status for r in saved) == [200] * 6 + [400, 400, 422] and all((r.path is None) == (r.status != 200) for r in saved)
    names = sorted(p.name for p in (tmp_path / "in").rglob("*") if p.is_file())
    assert len(names) == 5 and {"k1__my_paper.pdf", "k4_uploaded_file", "_n.pdf"} < set(names)
    assert all(len(n.encode()) <= 210 for n in names) and {r.path.rsplit("/", 1)[1] for r in saved if r.path} == set(names)
    assert files.save_uploads(uploads.limit(0), folder).count() == 0
    flat = files.save_uploads(uploads.limit(1), f"{folder}-flat", spread=False).first()
    assert flat.path == f"{folder}-flat/k1__my_paper.pdf" and (tmp_path / "in-flat" / "k1__my_paper.pdf").read_bytes() == body
    assert {r.raw_text for r in files.pdfs(spark, folder, "raw_text string").collect()} == {"a page of text"}


def test_requests_as_variants(spark):
    key = "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    both = {"document_id": key.upper(), "question": "what?"}
    bodies = [
        (None, 422, "no JSON"), ("", 422, "no JSON"), ("{", 422, "no JSON"), ('{"a": 1, "a": 2}', 422, "no JSON"), ("null", 422, "no object"), ("[]", 422, "no object"), ('"x"', 422, "no object"),
        ("{}", 422, "document_id: missing"), (json.dumps({"document_id": [1], "question": "what?"}), 422, "document_id: array"), (json.dumps({"document_id": key}), 422, "question: missing"),
        (json.dumps({"document_id": key, "question": None}), 422, "question: void"), (json.dumps({"document_id": key, "question": True}), 422, "question: boolean"),
        (json.dumps(both), 200, None), (json.dumps(both | {"z.z": 1, "a": {"b": []}, "options": {"language": "de"}}), 200, None), (json.dumps(both | {"options": {"language": 7}}), 200, None),
        (json.dumps(both | {"question": "ab"}), 422, None), (json.dumps(both | {"question": "    "}), 400, None), (json.dumps(both | {"document_id": "nope"}), 400, None), (json.dumps(both | {"document_id": "b" + key[1:]}), 404, None),
    ]
    rows = spark.createDataFrame([(k, b, "kept") for k, (b, _, _) in enumerate(bodies)], "k int, `the body` string, `a.b` string")
    out = variants.requests(rows, spark.createDataFrame([(key,), (key,)], "document_id string"), "the body")
    got = {r.k: r for r in out.collect()}
    assert out.columns == ["k", "the body", "a.b", "document_id", "question", "status", "problem", "language", "extra"] and len(got) == len(bodies)
    assert [(got[k].status, got[k].problem) for k in range(len(bodies))] == [x[1:] for x in bodies]
    assert (got[13].language, got[13].extra, got[13].document_id) == ("de", ["a", "z.z"], key) and got[14].language is None and got[3].extra == []


def test_results_are_read_back(spark):
    kind = T.StructType.fromDDL("title string, n int, score double, authors array<string>, directions array<struct<topic: string, inferred: boolean>>")
    rows = spark.createDataFrame([(1, "a", 3, 0.5, ["x", None], [("t", True), (None, False)]), (2, None, None, None, None, []), (None, 'q"\n', -1, -0.25, [], None)], T.StructType([T.StructField("doc_id", T.LongType()), *kind.fields]))
    back = variants.read_back(documents.as_json(rows), kind)
    assert back.schema.names == rows.schema.names and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    odd = spark.createDataFrame([("{broken",), (None,), ("[1]",), ('{"title": {"a": 1}, "n": "x"}',)], "json string")
    assert [r.n for r in variants.read_back(odd, kind).collect()] == [None] * 4


def test_a_heading_cut_by_a_page_is_read_whole(spark, tmp_path):
    """Papers whose references heading may lie across two pages: what their files give is what their whole texts give."""
    from quire.plans import registry

    rows = [(12 * k, "x" * (720 + k)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {r.title: (r.doi, r.year) for r in registry.embedded_metadata(spark, f"file://{tmp_path}").collect()}
    got = {r.title: (r.doi, r.year) for r in registry.pdf_documents(spark, f"file://{tmp_path}").collect()}
    assert len(got) > 30 and got == {k: want[k] for k in got}
