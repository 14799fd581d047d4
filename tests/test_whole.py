"""Texts are cleaned, cut and weighed in their tasks: the same as by Spark's patterns and plain loops, without interpreted lambdas."""

import math
import random
import unicodedata
from collections import Counter
from itertools import pairwise

from pyspark.sql import functions as F

from quire.functions import fixed, text
from quire.operators import cues, phrases, postings, ranking
from quire.plans import analyze, registry
from quire.sources import tables

BITS = ["a", "b-\n", "é", "-\n", "\n", "\n\n", " ", "  ", "\t", "12", "3", "Page 3 of 9", "pAGE\n3 of\n 9", "doi: 10.1234", "© 2017", "©\n 2017 z", "All rights reserved", "all rıghts reſerved", "page", "x" * 40, "y" * 85,
        "​", "\x07", "\x1c", "\r", " ", "ﬁ", "“", "—", "­", "_", "References", "\nreferences\n", "\n Works\n cited \n", "reſerences", "!", ". ", "It's a b'c_d e.g. the NBSP word", "Ω"]


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def odd_texts(n=600):
    rng = random.Random(1)
    return [unicodedata.normalize("NFC", "".join(rng.choices(BITS, k=rng.randint(1, 25)))) for _ in range(n)]


def test_cleaning_in_tasks_is_that_of_the_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in odd_texts()], "t string")
    t = F.col("t")
    plain = F.array_join(F.filter(F.regexp_extract_all(F.lower(t), F.lit(f"{text.WORD}{{2,}}"), F.lit(0)), lambda w: ~w.isin(fixed.STOP_WORDS)), " ")
    got = rows.select("t", text.clean_text(t, False).alias("clean"), text.clean_text(t, False, True).alias("short"), text.without_references(t).alias("before"), text.sentences(t).alias("sents"), ranking.term_words(t).alias("content"), plain.alias("plain"))
    for r in got.collect():
        assert (text.cleaned(r.t), text.cleaned(r.t, True), text.before_references(r.t)) == (r.clean, r.short, r.before)
        assert (text.sentence_list(r.t), " ".join(text.content_terms(r.t)), " ".join(text.plain_terms(r.t))) == (r.sents, r.content, r.plain)


def loop_weights(sents, vocabulary):
    if len(sents) < 2:
        return [{} for _ in sents]
    counted = [Counter([*s, *(f"{a} {b}" for a, b in pairwise(s))]) for s in sents]
    df, total = Counter(t for c in counted for t in c), sum(counted, Counter())
    kept = set(sorted(total, key=lambda t: (-total[t], t))[:vocabulary])
    raw = [{t: n * (math.log((1 + len(sents)) / (1 + df[t])) + 1) for t, n in c.items() if t in kept} for c in counted]
    return [{t: x / math.sqrt(sum(y * y for y in r.values())) for t, x in r.items()} for r in raw]


def test_weights_are_those_of_a_loop():
    rng = random.Random(2)
    lists = [[rng.choices("a b ab ba c é zz".split(), k=rng.randint(0, 6)) for _ in range(rng.randint(0, 7))] for _ in range(200)]
    for sents in lists:
        for vocabulary in (5, 5000):
            own = ranking.term_weights(sents, vocabulary)
            got = [{} for _ in sents]
            for k, t, w in zip(own.sent.tolist(), own.names(own.term), own.w.tolist(), strict=True):
                got[k][t] = round(w, 9)
            assert got == [{t: round(w, 9) for t, w in r.items()} for r in loop_weights(sents, vocabulary)]


def test_terms_are_found_without_interpreted_lambdas(spark):
    docs = spark.createDataFrame([(1, "Graphs help models. Models need graphs often. Nothing else is said here.")], "doc_id long, full_text string")
    cleaned = text.with_clean_text(docs)
    for rows in (cleaned, cues.keywords(cleaned)):
        assert "lambdafunction" not in plan(rows) and "regexp" not in plan(rows) and rows.count()
    ranked = plan(analyze._with_best(docs, F.array(F.struct(F.lit("all").alias("slot"), F.col("full_text").alias("t"), F.lit(2).alias("most"))), "best"))
    assert "regexp_extract_all" not in ranked and "split" not in ranked


def test_insights_read_whole_sections(spark):
    """A finding behind the first 3,000 characters of its section, and a summary from behind the first 8,000 of all."""
    filler = " ".join(f"Plain filler of number {k} stands here for a while." for k in range(250))
    paper = f"A title of some length\n\nMethodology\n{filler}\n\nResults\n{filler} Our results show that graphs improve the recall of long documents.\n\nDiscussion\nNothing more."
    docs = spark.createDataFrame([(1, paper)], "doc_id long, full_text string")
    found = [analyze.analyse(docs, whole=w, points=False).first() for w in (True, False)]
    assert any("improve the recall" in f for f in found[0].findings) and not any("improve the recall" in f for f in found[1].findings)
    assert "Our results show" in found[0].why_it_matters


def test_phrases_read_whole_texts(spark):
    """Words behind the first 8,000 characters make phrases; distances are those of the whole table."""
    filler = " ".join(f"Plain filler{k} stands here." for k in range(400))
    docs = spark.createDataFrame([(1, f"{filler} Spectral Sparsifiers shrink Graphs.")], "doc_id long, clean_text string")
    scores = phrases.phrase_scores(docs)
    assert "spectral sparsifiers" in {r.phrase for r in scores.collect()}
    assert any("sparsifiers" in r.phrase for r in phrases.key_phrases(docs).collect())
    assert "Window" not in plan(phrases.key_phrases(docs)) and plan(phrases.key_phrases(docs)).count("Exchange") == 1
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abcé ", k=rng.randint(0, 9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert phrases.edits(a, b) == row[-1]


def test_tables_of_papers_are_not_exchanged_again(spark, data):
    """Papers lie in the buckets of the tables, with one of their texts; what is made of them, row by row, stays where it is."""
    for name, rows in registry._five_tables(spark, data, False).items():
        if name != "qa_messages":
            assert "Exchange" not in plan(rows.repartition(registry.BUCKETS, tables.TABLES[name].document))


def test_postings_are_the_same_without_a_table_of_terms(spark, monkeypatch):
    """Blocks are made where their rows lie, exchanging no cells; beyond LOOKUP terms by a join: the same cells."""
    rows = spark.createDataFrame([(k, f"common word{k % 7} and other{k} things {'more ' * (k % 3)}") for k in range(300)] + [(300, None), (301, "the")], "row long, text string").repartition(3)
    found = []
    for most in (10**6, 0):
        monkeypatch.setattr(postings, "LOOKUP", most)
        index = postings.build(rows, ["row"])
        cells = index.postings.select("block", F.inline("cells")).selectExpr("block * 64 + place AS id", "term", "round(raw, 9) AS raw")
        found.append(sorted(tuple(r) for r in cells.join(index.names, "id").select("row", "term", "raw").collect()))
    assert found[0] == found[1] and len(found[0]) > 900


def test_pages_are_cut_before_they_are_rows(spark, data):
    """A row for each page with the whole text in it takes the square of a text's length."""
    explode = [x for x in plan(registry._pages(spark, data)).split("\n") if "Generate" in x]
    assert len(explode) == 1 and "full_text" not in explode[0].split("posexplode")[1].split("[")[1]
