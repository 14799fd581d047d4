"""Golden rows of the document operators, invariants, and every query against its SQL."""

import json
import math
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import clusters, cues, phrases, postings, ranking, retrieval, sections
from quire.plans import analyze, registry
from quire.sources import documents, store

TABLES = "documents embeddings pages labels conversations".split()


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [(None, ""), ("  \n ", ""), ("a b", "ab"), ("a\n\n\n12\n\n\nb", "a\n\nb"), ("meth-\nod", "method"), ("a-\nb-\nc", "ab-\nc"), ("x\n\n\n\n\ny", "x\n\ny"), ("é ﬁne “q” —", "é fine \"q\" -"), ("keep\nPage 3 of 9\nthis", "keep\n\nthis"), ("a\n© 2017 Press\nb", "a\n\nb")],
)
def test_cleaning(spark, dirty, clean):
    assert one(spark, text.clean_text, dirty) == clean
    again = "abc" if clean == "ab-\nc" else clean  # hyphens that share a letter are joined one at a time
    assert one(spark, text.clean_text, clean) == again


def test_small_text_functions(spark):
    assert one(spark, text.without_references, "body\nReferences\n[1] x") == "body"
    assert one(spark, text.without_references, "References\n[1] x") == "References\n[1] x"
    assert one(spark, lambda t: text.truncated(t, 9), "several words here") == "several..."
    assert one(spark, text.safe_file_name, "../a bé.pdf") == "_a_bé.pdf"
    assert one(spark, text.safe_file_name, "..") == "uploaded_file"
    assert one(spark, text.document_key, "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11") == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    assert one(spark, text.document_key, "nope") is None
    assert one(spark, text.content_words, "The Quick, brown fox don't of it") == "quick brown fox dont"
    assert one(spark, text.sentences, "Short. This one is long enough! And so is this? no") == ["This one is long enough!", "And so is this?"]


PAPER = "A title\nAbstract\nWe speak.\nResults\nGood.\nDiscussion\n\nResults\nMore.\n2 Methodology\nResults and Discussion\nConclusion\nDone."


def test_sections(spark):
    row = sections.with_sections(spark.createDataFrame([(1, PAPER), (2, "no heading here."), (3, "")], "doc_id long, clean_text string")).orderBy("doc_id").collect()
    got = [(s.ord, s.name, s.text, s.start_line, s.end_line) for s in row[0].sections]
    assert got == [(0, "abstract", "We speak.", 1, 2), (1, "results", "Good.", 3, 4), (2, "discussion", "", 5, 6), (3, "results_3", "More.\n2 Methodology\nResults and Discussion", 7, 10), (4, "conclusion", "Done.", 11, 12)]
    assert row[0].preamble == "A title" and row[1].sections == row[2].sections == []
    slots = analyze.with_slots(sections.with_sections(spark.createDataFrame([(1, PAPER)], "doc_id long, clean_text string"))).first()
    assert (slots.s_results, slots.s_discussion, slots.s_introduction) == ("Good.", "", "") and slots.combined == "We speak.\n\nGood.\n\nDone."


def test_abstract_without_headings(spark):
    assert one(spark, sections.abstract_without_headings, "Title\nAbstract: what it is about\n\nmore") == "what it is about"
    assert one(spark, sections.abstract_without_headings, "nothing") is None


def test_metadata(spark):
    t = "SHOUTED TITLE LINE\nA first good line\nThe longest of the good lines\nThe longest of the good linez\nsee 10.1234/abc.). in 2017"
    assert one(spark, sections.title, t) == "The longest of the good lines"
    assert one(spark, sections.title, "x") == "Unknown Title"
    assert one(spark, sections.doi, t) == "10.1234/abc" and one(spark, sections.year, t) == "2017"
    assert one(spark, sections.authors, "Ann Lee, Bo Chan and Cy Diaz; X") == ["Ann Lee", "Bo Chan", "Cy Diaz"]


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1, 1), (4, 1), (5, 1), (6, 2), (8, 2), (9, 3), (11, 3)])
def test_windows(spark, n, count):
    got = spark.range(1).select(sections.windows(F.expr(f"transform(slice(sequence(1, 20), 1, {n}), x -> cast(x as string))")).alias("w")).first().w
    assert len(got) == count and {x for w in got for x in w} == {str(k + 1) for k in range(n)}


def test_ranking_edges(spark):
    rows = spark.createDataFrame([(1, 0, "A single sentence."), *[(2, k, "The very same words here.") for k in range(6)]], "doc_id long, pos int, sent string")
    single = ranking.scored(rows, ["doc_id"]).where("doc_id = 1").first()
    assert (single.tfidf, single.similarity, single.position, single.score) == (1, 1, 1, 1)
    best = sorted(r.pos for r in ranking.top_sentences(rows, ["doc_id"], 2).where("doc_id = 2").collect())
    assert best == [0, 5]  # head and tail


def test_cues(spark):
    assert one(spark, cues.objective, "In this work, we propose a method that reads very many documents at once. Then more.") == "a method that reads very many documents at once."
    assert len(one(spark, cues.findings, "Our results show that the model improves recall by nine points on every split.")) >= 1
    assert one(spark, cues.limitations, "One limitation of our approach is that it requires large memory budgets.") == ["One limitation of our approach is that it requires large memory budgets."]
    assert one(spark, cues.datasets, "We evaluate on the Corpus7 Large dataset") == "Corpus7 Large"


def test_future_work(spark):
    said = " ".join(f"Future work should study the interesting topic number {k} in depth." for k in range(7)) + " It remains an open problem to scale graph inference."
    rows = spark.createDataFrame([(1, said, ["x"], ["topic"]), (2, "", [], []), (3, "", ["One limitation is that it needs very large memory."], ["k"])], "doc_id long, t string, limits array<string>, words array<string>")
    got = {r.doc_id: r.directions for r in cues.with_directions(rows, F.col("t"), "limits", "words").collect()}
    assert len(got[1]) == 6 and got[1][5].evidence.startswith("remains an open problem")
    assert got[1][0].topic == "Extending topic approaches" and got[1][0].question.startswith("Could researchers study")
    assert len(got[2]) == len(got[3]) == 3 and all(d.is_inferred for d in got[2]) and not got[3][0].is_inferred


def test_answers(spark):
    rows = spark.createDataFrame([("", "some context here."), ("what?", ""), ("Which animals sleep all day?", "Cats sleep all day long. Cats sleep all day too. Dogs bark at night."), ("zebra", "Cats sleep all day long.")], "question string, context string")
    got = [r.result for r in retrieval.answers(rows).collect()]
    assert [g.found_in_paper for g in got] == [False, False, True, False]
    assert got[2].answer == "Cats sleep all day long." and (got[2].start, got[2].end) == (0, 24) and got[2].score == round(3 / 4.1, 4)


def test_hashed_vectors(spark):
    a, b = (one(spark, retrieval.hashed_vector, t) for t in ("one two two", "two One two"))
    assert len(a) == 64 and a == b and sum(a) == 3
    assert sum(one(spark, retrieval.hashed_vector, "")) == 0


def test_context_budget(spark):
    rows = spark.createDataFrame([(q, k, "x" * n) for q, sizes in ((1, [2500, 2500, 2500]), (2, [5000, 2000, 500])) for k, n in enumerate(sizes)], "query_id long, rank int, text string")
    assert {r.query_id: r.n_chunks for r in retrieval.contexts(rows).collect()} == {1: 2, 2: 1}


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.PDF").write_bytes(b"plain")
    (tmp_path / "c.txt").write_bytes(b"%PDF")
    files = documents.read_files(spark, f"file://{tmp_path}")
    assert sorted(r.s for r in files.select(documents.admission(F.col("content")).alias("s")).collect()) == [200, 422]
    assert spark.range(1).select(documents.admission(F.lit(b"")).alias("s")).first().s == 400  # Spark's reader leaves empty files out
    pages = documents.read_pages(files, lambda b: [(b.decode(), 0), ("second page of text", 1)])
    out = documents.documents_of(pages).collect()
    assert len(out) == 2 and all(r.total_pages == 2 and r.is_scanned for r in out)


def test_files_without_pages(spark):
    def extract(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(content.decode(), 2)] if content else []

    files = spark.createDataFrame([("/x/a.PDF", b"some longer text"), ("/x/b.pdf", b"bad"), ("/x/c.pdf", b""), ("/x/d.pdf", None), ("/x/e.doc", b"text"), (None, b"text")], "path string, content binary")
    pages = documents.read_pages(files, extract)
    got = {r.doc_id: r for r in pages.collect()}
    assert tuple(got["/x/a.PDF"])[1:] == (1, "some longer text", 16, 2, True, None)
    told = ["Cannot open PDF 'b.pdf': broken", "PDF 'c.pdf' contains no pages.", "PDF 'd.pdf' contains no pages.", "File is not a PDF: e.doc"]
    assert got[None].error == "File is not a PDF: " and got[None].page_number is None
    assert [got[f"/x/{n}"].error for n in ("b.pdf", "c.pdf", "d.pdf", "e.doc")] == told
    assert [r.doc_id for r in documents.documents_of(pages).collect()] == ["/x/a.PDF"]
    asked = spark.createDataFrame([("/x/a.PDF",), ("/x/z.pdf",), ("/x/z.pdf",), (None,)], "path string")
    assert [(r.doc_id, r.page_number, r.error) for r in documents.missing_files(asked, files).collect()] == [("/x/z.pdf", None, "PDF file not found: /x/z.pdf")]
    assert documents.missing_files(asked, files).schema == pages.schema
    assert documents.read_pages(files.limit(0), extract).count() == 0


def test_json_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, None, ["a"]), (None, "b", None)], "doc_id long, title string, authors array<string>")
    assert [r.json for r in documents.as_json(rows).collect()] == ['{"title":null,"authors":["a"]}', '{"title":"b","authors":null}']


def test_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "doc_id long, t string")
    for _ in range(2):
        store.append(rows, f"file://{tmp_path}/t")
    assert sorted(str(r.doc_id) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == ["1", "None"]


def test_scanned_papers_are_told(spark):
    rows = [(1, k, "x" * n, n) for k, n in enumerate((80, 79, 79), 1)] + [(2, 1, "x" * 100, 100)]
    out = {r.doc_id: r for r in documents.documents_of(spark.createDataFrame(rows, "doc_id long, page_number int, raw_text string, char_count int")).collect()}
    assert out[1].warning == "This PDF appears to be scanned or image-based (avg 79 chars/page). Text extraction quality may be poor. OCR is not available."
    assert out[1].is_scanned and not out[2].is_scanned and out[2].warning is None


def test_requests(spark):
    key = "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    bodies = [("no json", 422), ("{}", 422), (f'{{"document_id": "{key.upper()}", "question": "what?"}}', 200), (f'{{"document_id": "{key}", "question": "ab"}}', 422), (f'{{"document_id": "{key}", "question": "    "}}', 400), ('{"document_id": "nope", "question": "what?"}', 400), (f'{{"document_id": "b{key[1:]}", "question": "what?"}}', 404), (None, 422)]
    rows = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(bodies)], "k int, body string")
    known = spark.createDataFrame([(key,), (key,)], "document_id string")
    got = {r.k: r for r in documents.requests(rows, known).collect()}
    assert [got[k].status for k in range(len(bodies))] == [s for _, s in bodies]
    assert got[2].document_id == key and got[5].document_id is None
    dotted = documents.requests(rows.withColumnRenamed("body", "a.b").withColumn("c d", F.lit(1)), known, "a.b")
    assert dotted.columns == ["k", "a.b", "c d", "document_id", "question", "status"] and dotted.count() == len(bodies)
    assert spark.range(2).select(text.new_document_key().alias("k")).where(text.document_key(F.col("k")).isNotNull()).distinct().count() == 2


def test_embedded_metadata_wins(spark):
    rows = [(1, "A likely title line\nmore", " Given title ", "Ann Lee and Bo Chan", "a, ,b "), (2, "A likely title line\nmore", "abc", None, None)]
    got = sections.with_embedded(spark.createDataFrame(rows, "doc_id long, clean_text string, pdf_title string, pdf_author string, pdf_subject string")).orderBy("doc_id").collect()
    assert (got[0].title, got[0].authors, got[0].keywords) == ("Given title", ["Ann Lee", "Bo Chan"], ["a", "b"])
    assert (got[1].title, got[1].authors, got[1].keywords) == ("A likely title line", [], [])


def test_answers_come_from_the_nearest_chunks(spark):
    chunked = spark.createDataFrame([(1, 0, "results", "The graph model improves recall on every split."), (1, 1, "", "Bananas are yellow and apples are green."), (2, 0, "x", "zzz")], "doc_id long, chunk_id int, section_name string, text string")
    pages = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "so: The graph model improves recall on every split. more"), (2, 2, "The graph model improves recall on every split.")], "doc_id long, page_number int, text string")
    docs = spark.createDataFrame([(1, "whole"), (2, "whole"), (3, "The graph model improves recall here too."), (4, "")], "doc_id long, clean_text string")
    asked = spark.createDataFrame([(k, k, "Which graph model improves recall?") for k in (1, 2, 3, 4)], "query_id long, doc_id long, question string")
    got = {r.doc_id: r for r in retrieval.paper_answers(asked, docs, chunked, pages).collect()}
    assert got[1].result.answer == "The graph model improves recall on every split." and got[1].sources[0].section == "results" and got[1].sources[0].pages == [2]
    assert got[2].result.answer.startswith("I could not find relevant content") and not got[2].result.found_in_paper
    assert got[3].result.found_in_paper and got[3].sources is None
    assert not got[4].result.found_in_paper


def test_query_similarity(spark):
    rows = [(1, 0, "graphs recall models"), (1, 1, "bananas apples"), (1, 2, "graphs again"), (2, 0, "alone graphs")]
    got = ranking.query_similarity(spark.createDataFrame(rows, "doc_id long, pos int, sent string"), spark.createDataFrame([(1, "graphs models"), (1, "recall"), (2, "none")], "doc_id long, sent string"), ["doc_id"])
    near = {(r.doc_id, r.pos): r.similarity for r in got.collect()}
    assert near[2, 0] == 1.0 and near[1, 1] == 0.0 and near[1, 0] > near[1, 2] > 0


def test_chunks_take_linear_time(spark):
    """Twice the sentences in a section take less than three times as long."""
    import time

    def seconds(n):
        long = " ".join(f"Sentence number {k} says something of its own." for k in range(n))
        docs = spark.createDataFrame([(1, long)], "doc_id long, clean_text string").withColumn("sections", F.expr("cast(array() as array<struct<ord: int, name: string, heading: string, text: string, start_line: int, end_line: int>>)"))
        began = time.time()
        assert sections.chunks(docs).count() == 1 + math.ceil((n - 5) / 3)
        sections.chunks(docs).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(100)
    assert seconds(12_800) < 3 * seconds(6_400) + 1


@pytest.mark.parametrize("block", [3, 20_000])
def test_blocks_of_queries_do_not_matter(spark, block):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = [(k, rng.normal(size=8 if k % 5 else 4).round(1).tolist()) for k in range(300)] + [(k, [1.0] * 8) for k in range(300, 320)] + [(400, [0.0] * 8), (401, None)]
    queries = [(k, v) for k, v in vectors if k % 13 == 0] + [(500, [1.0] * 8)]
    got = retrieval.cosine_top(spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(vectors, "id long, embedding array<double>").repartition(4), 5, block)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((-r.score, -r.id))
    for name, q in queries:
        near = [(-round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9), -k) for k, v in vectors if v and any(v) and q and any(q) and len(v) == len(q)]
        assert sorted(found.get(name, [])) == sorted(x for x in near if -x[0] > 0.1)[:5], name


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, t string")
    for _ in range(2):
        store.append(rows, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2


def norm(v):
    return ("nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    found = duck.execute(registry.ORACLE_SQL[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == sorted(df.columns)
    want = sorted(tuple(map(norm, r)) for r in found.fetchall())
    assert want and sorted(tuple(map(norm, r)) for r in df.select([f"`{c}`" for c in order]).collect()) == want


def test_analysis(spark, data):
    rows = registry.analysis(spark, data).collect()
    assert len(rows) == 200 and all(len(json.loads(r.directions)) >= 3 and r.summary and r.objective and r.keywords and r.domain for r in rows)


def test_analysis_of_odd_ids(spark, data):
    """Rows that share an id, or have none, get a row each: that which the same text gets alone; a null text is empty."""
    whole = registry._papers(spark, data).orderBy("doc_id").limit(2).collect()
    texts = [r.full_text for r in whole]
    odd = [(7, texts[0], 1), (7, texts[1], 2), (7, texts[0], 3), (None, texts[0], 4), (None, texts[1], 5), (8, None, 6), (9, "", 7)]
    got = [r.asDict() for r in analyze.analyse(spark.createDataFrame(odd, "doc_id long, full_text string, `a.b` int")).collect()]
    want = {r.doc_id: r.asDict() for r in analyze.analyse(spark.createDataFrame([(0, texts[0]), (1, texts[1])], "doc_id long, full_text string")).collect()}
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "7", "8", "9", "None", "None"]
    bare = lambda r: {k: v for k, v in r.items() if k != "doc_id"}
    for k, times in ((0, 3), (1, 2)):
        assert sum(bare(r) == bare(want[k]) for r in got) == times
    assert analyze.analyse(spark.createDataFrame([], "doc_id long, full_text string")).count() == 0


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_key_phrases(spark, data):
    """The fold over the scored phrases against a plain loop; the scores are held against SQL."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 20").select("doc_id", F.col("text").alias("clean_text")).cache()
    listed = {}
    for r in phrases.phrase_scores(docs).collect():
        listed.setdefault(r.doc_id, []).append((round(r.score, 12), r.phrase))
    want = set()
    for doc_id, found in listed.items():
        kept = []
        for score, phrase in sorted(found):
            if len(kept) < 20 and all(1 - edits(p, phrase) / max(len(p), len(phrase)) <= 0.7 for _, p in kept):
                kept.append((score, phrase))
        want |= {(doc_id, k, p) for k, (_, p) in enumerate(kept[:15], 1)}
    got = {(r.doc_id, r.rank, r.phrase) for r in phrases.key_phrases(docs).collect()}
    assert got == want and len(want) > 200


def test_phrases_of_odd_texts(spark):
    rows = [(1, None), (2, " "), (3, "12 34, 5."), (4, "of the of"), (5, "Deep learning, deep learning of graphs. Deep learning 7 wins"), (5, "Deep nets"), (5, "Deep nets"), (None, "Lone word")]
    got = phrases.phrase_scores(spark.createDataFrame(rows, "doc_id long, clean_text string")).collect()
    assert {r.doc_id for r in got} == {5, None} and all(r.score > 0 for r in got)
    told = {r.phrase for r in got if r.doc_id == 5}
    assert sum(r.phrase == "deep nets" for r in got) == 1 and {"deep", "deep learning", "learning of graphs", "deep nets"} <= told
    assert not any("7" in p or p.startswith("of") or p.endswith(" of") for p in told) and "learning deep" not in told


def test_ranking_exchanges_nothing(spark):
    """Terms as rows of their own took many times the texts' bytes in exchanges and sorts."""
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("Graphs help models. Models need graphs often. Nothing else is said here.").alias("full_text"))
    slots = documents.kept(analyze.with_slots(analyze.prepared(docs)), "slots")
    lists = ranking.sentence_lists(docs, ["doc_id"], "full_text")
    asked = lists.withColumn("asked", F.slice("rows", 1, 1)["sent"])
    for rows in (ranking.scored_lists(lists, ["doc_id"]), ranking.top_lists(lists, ["doc_id"], 2), ranking.similar_lists(asked, ["doc_id"]), analyze.ranked_slots(slots), cues.keywords(docs, "full_text"), analyze.analyse(docs)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() > 0


def test_normal_texts_stay_in_the_jvm(spark):
    """Characters of text.NORMAL are in NFC whatever stands beside them; only texts with others are handed to Python."""
    import re
    import unicodedata

    plain, second = re.compile(f"[{text.NORMAL}]"), set()
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    safe = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if plain.match(c)]
    assert not [c for c in safe if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) or c in second]
    texts = ["plain ﬁne “text” é", "é and 가", "Å", "", None, "語 グ が"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r.k: r.n for r in rows.select("k", text.nfc(F.col("t")).alias("n")).collect()}
    assert got == {k: t if t is None else unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}


def test_words_of_phrases_are_not_exchanged(spark):
    """The texts are dealt once; a row for each word took many times their bytes in sorts."""
    docs = spark.createDataFrame([(1, "Deep learning of graphs. Deep nets of graphs win."), (2, "")], "doc_id long, clean_text string")
    rows = phrases.phrase_scores(docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    assert {r.phrase for r in rows.collect()} >= {"deep", "learning of graphs", "nets of graphs"}


def test_telling_normal_texts_is_cheap(spark):
    """Each character is held against few ranges, so that NFC takes less than the rest of the cleaning; the ranges are those of NORMAL."""
    one, other = re.compile(f"[^{text.NORMAL}]"), re.compile(text.NOT_NORMAL)
    assert all(bool(one.match(c)) == bool(other.match(c)) for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]))
    line = "The “strong” baselines are ﬁne, and größer still.\n"
    rows = spark.createDataFrame([(line * 4000,)] * 8, "t string").repartition(2).cache()
    rows.count()

    def seconds(normalise):
        took = []
        for _ in range(3):
            began = time.time()
            rows.select(text.clean_text(F.col("t"), normalise)).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    assert seconds(True) < 1.5 * seconds(False) + 0.3
