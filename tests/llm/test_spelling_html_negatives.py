"""Spelling variants, HTML extraction and hard negatives against plain Python."""

import html
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import TEXTS, documents
from pyspark.sql import functions as F

from quire.llm import hard_negatives, html_text, queries, spelling

# -- spelling variants --


def brute_counts(rows, least_count=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= least_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, times=5):
    form, count = {}, {}
    for w in n:
        close = [x for x in n if abs(len(x) - len(w)) < 2 and x != w and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        count[w], form[w] = len(close), best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_random_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(600)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "x" * 3000, "x" * 3001, "y" * 3000}
    n = {w: rng.choice([1, 2, 10, 60, 400]) for w in words}
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)))
    assert got == brute_variants(n)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_light_edges_are_few(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(9)) for _ in range(3000)})
    df = spark.createDataFrame(list(enumerate(words)), "wid long, word string")
    most = max(spelling.light_edges(df).groupBy("wid").count().collect(), key=lambda r: r["count"])["count"]
    assert most <= math.log2(len(words)) + 1


def test_word_counts(spark, data):
    texts = [*TEXTS, "Straße straße STRASSE " * 3, "one-edit ÀÉÎÕÜà×÷ÿ " * 6, "letters letter lettersletters " * 4]
    got = {r.word: r.n for r in spelling.word_counts(documents(spark, texts)).collect()}
    assert got == brute_counts(list(enumerate(texts)))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op11_spelling_variants"](spark, data)) == brute_variants(brute_counts(docs))
    twice = spark.createDataFrame([(None, "repeated rows"), (1, "repeated rows"), (1, "repeated rows")] * 2, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(twice).collect()} == brute_counts([(r.doc_id, r.text) for r in twice.collect()])


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.word_counts(empty)).collect() == []
    assert rows_of(spelling.group_variants(spark.createDataFrame([("single", 7)], "word string, n long"))) == [("single", None, "single", 7, 0, None)]


# -- HTML --


def plain_article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())


def test_whole_pages(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = queries.QUERIES["op12_html_text"](spark, data).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


def test_best_run_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.choice([-3.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        sums = {(i, j): sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        first, last = html_text.best_run(x)
        assert sum(x[first:last]) == max([0.0, *sums.values()])


WEIGHTS = html_text._weights({})


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("  \n", ""),
        ("<p></p><!-- nothing", ""),
        ("plain &amp;amp; text < 5", "plain &amp; text < 5"),
        ("<p>a<b>b</b>c &#233;&nbsp;<i>x</i>\n y<p>z<br>w", "abc é x y z w"),
        ("<p>one<script>var x = '<p>two</p>';</script> three</p><style>p{}", "one three"),
        ("<p title='a > b'>quoted</p><p title=\"open>cut</p>", "quoted cut"),
        ("<p>" + "word " * 200_000 + "</p>", "word " * 199_999 + "word"),
        ("<nav><a href=/>Home</a></nav><footer>imprint</footer>", ""),
        ("<body><div class='cookie-notice'>We set cookies</div><div id=content><h1>Head</h1><p>First part.</p><div class=ad>Buy</div><p>Second <a href=/>linked</a> part.</p></div>"
         "<div class='post-comments'><p>I disagree with all of it</p></div><div id=footer>Imprint</div></body>", "Head First part. Second linked part."),
        ("<body><header><h1>Site</h1></header><article><header><h1>Own head</h1></header><p>Text.</p><aside><p>Aside</p></aside><form>Your mail</form><section class=comments><p>Nice</p></section></article></body>", "Own head Text."),
        ("<body><form id=all><main><p>A page in a form.</p></main></form></body>", "A page in a form."),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p><noscript>no</noscript>", "yes"),
        ("<ul class=menu><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul><p>Only this.</p><ul><li><a href=/3>Three</a></li></ul>", "Only this."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page, WEIGHTS) == text


def test_pages_with_odd_rows(spark):
    rows = [(1, None, None, "a"), (1, "u", "<p>text here</p>", "b"), (1, "u", "<p>text here</p>", "b"), (None, "", "", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("clash"))
    got = html_text.extract(df, html_text.fit(df)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "", "", 0), (1, "", "", 0), (1, "u", "text here", 9), (1, "u", "text here", 9)]
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).collect() == []


def test_deep_and_unclosed_pages_are_linear():
    for page in ("<div>" * 100_000 + "x", "<p>" * 100_000 + "<b>" * 1000, "<a href=\"x>" * 20_000, "</div>" * 100_000, "<" * 200_000, "<div class='a" * 20_000, "<!--" * 50_000):
        html_text.main_text(page, WEIGHTS)


# -- hard negatives --


def brute_negatives(rows, scale=256):
    """rows (vec_id, label, vector)."""
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for i, lab, q in ok:
        if i is None or i % 100:
            continue
        others = [(sum(a * b for a, b in zip(q, c, strict=True)), j, own) for j, own, c in ok if len(c) == len(q) and j != i]
        same = sorted(((s, j) for s, j, own in others if own == lab), key=lambda x: (-x[0], last(x[1])))[:5]
        for p, pid in same:
            fit = sorted(((s, j) for s, j, own in others if own != lab and 30 * p <= 100 * s <= 90 * p), key=lambda x: (-x[0], last(x[1])))[:10]
            out += [(i, pid, k, j, p, s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").withColumns({"q": F.lit("clash"), "range": F.lit(1), "norm": F.lit(None)})
    got = hard_negatives.mine(df.repartition(4), F.col("vec_id") % 100 == 0, hard_negatives.Settings(**settings))
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"range_rows": 90, "bucket": 16, "anchor_rows": 4, "growth": 2}])
def test_negatives(spark, settings):
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), [rng.gauss(0.3, 1) * rng.choice([0.2, 1, 3]) for _ in range(6)]) for i in range(900)]
    rows += [(2000 + i, 1, [0.5] * 6) for i in range(40)]  # one vector, very often
    got = mined(spark, rows, **settings)
    assert got == brute_negatives(rows) and len(got) > 300


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [0.5, 1.0]), (2, 2, [0.5, 1.0]), (None, 2, [0.5, 0.9]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]), (7, 1, [inf, 1.0]),
            (100, 1, [1.0]), (101, 1, [2.0]), (102, 2, [0.9]), (200, 2, [0.0, 0.0]), (300, 3, []), (301, 3, []), (302, 1, []), (400, 1, [1e6, 1e6]), (401, 1, [1e6, 1e6]), (402, 2, [3e5, 1e6])]
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and {r[0] for r in got} >= {0, 100, 300, 400}
    assert mined(spark, rows[:1]) == [] and mined(spark, [(1, 1, [1.0])]) == []
    assert hard_negatives.mine(spark.createDataFrame([], "vec_id long, label long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_huge_components_are_clipped(spark):
    rows = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 1.0]), (2, 2, [1.0, 1.0])]
    assert mined(spark, rows) == []


def test_short_vectors_are_passed_over(monkeypatch, spark):
    """Long vectors fill the windows at once; the many short ones behind them are never scored, and the rows are those of all."""
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(1500)]
    rows = [(i, i % 3, [x * (8 if i < 400 else 0.05) for x in v]) for i, v in enumerate(vectors)]
    assert mined(spark, rows, range_rows=200, bucket=50, growth=2) == brute_negatives(rows)

    block = hard_negatives._Block(1, True)
    windows = [[{"wid": 0, "lower": -5, "upper": 1 << 62, "least": 40}]]
    block.add(pa.RecordBatch.from_pydict({"q": [[3.0, 4.0]], "norm": [5.0], "own": [1], "label": ["a"], "id": [7], "windows": windows}), [0])
    block.ready()
    block.search(np.array([[3.0, 4.0], [6.0, 8.0]]), 10.0, np.array([2, 3]), ["a", "a"])
    assert block.found().to_pylist() == [{"aid": 7, "wid": 0, "id": 3, "score": 50}]
    monkeypatch.setattr(hard_negatives, "_scores", None)
    block.search(np.array([[9.0, 0.0]]), 9.0, np.array([4]), ["a"])  # 5 * 9 is less than the 50 that it has
