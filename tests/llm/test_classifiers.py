"""Language ID and toxicity: held-out accuracy, defined results for odd rows, and no peeking."""

import math
import random
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from quire.llm import language_id, queries, toxicity
from quire.llm.shared import sampled

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def languages(docs):
    return language_id.fit(docs)


@pytest.fixture(scope="module")
def toxic(spark, docs):
    return toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_languages(spark, docs):
    got = queries.op2_language_id(spark, SF).join(docs.where("lang is not null and length(text) > 40").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_have_a_language(spark, languages):
    got = {r.doc_id: r for r in language_id.predict_documents(brute.documents(spark, brute.TEXTS), languages).collect()}
    assert len(got) == len(brute.TEXTS)
    for i, t in enumerate(brute.TEXTS):
        blank = not any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == blank
        assert got[i].rejected or not blank
        assert got[i].score == 0 or not blank


MASK = (1 << 64) - 1


def grams_of(text, orders, bits):
    """Hashed n-grams of a text, in plain Python."""
    text, out = f" {(text or '').lower()} ", []
    for n in orders:
        for at in range(len(text) - n + 1):
            h = n
            for c in text[at : at + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & MASK
            h ^= h >> 31
            out.append((h * 0xD6E8FEB86659FD93 & MASK) >> (64 - bits))
    return out


def test_scores_are_cosines_to_the_nearest_centroid(spark, languages):
    texts = [t for t in brute.TEXTS if t and len(t) < 30_000] + [random_words(k, 50) for k in range(5)]
    got = {r.doc_id: r for r in language_id.predict_documents(brute.documents(spark, texts), languages).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t):
            continue
        tf = Counter(grams_of(t, languages.settings.orders, languages.settings.bits))
        x = {f: math.log(1 + n) * float(languages.idf[f]) for f, n in tf.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        near = [sum(v * float(c[f]) for f, v in x.items()) / length for c in languages.centroids]
        assert got[i].lang_pred == languages.languages[near.index(max(near))]
        assert abs(got[i].score - max(near)) < 1e-3


def test_idf_counts_the_rows_that_hold_a_gram(spark):
    texts = ["ab", "abab", "b", "", "ab c"]
    docs = brute.documents(spark, texts, langs=["en"] * 5)
    s = language_id.Settings()
    idf = language_id._idf(docs, s)
    held = [set(grams_of(t, s.orders, s.bits)) for t in texts]
    for f in set().union(*held):
        assert abs(idf[f] - (math.log(6 / (1 + sum(f in h for h in held))) + 1)) < 1e-5


def test_ratios_and_scores_by_brute_force(spark):
    rnd = random.Random(5)
    texts = [f"{rnd.choice(['you fool', 'dear friend', 'vile words'])} {rnd.choice(['today', 'again', 'it rains'])} {k % 7}" for k in range(200)]
    rows = [(k, t, int("fool" in t or "vile" in t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    s = toxicity.Settings()
    taught = [(set(grams_of(t, s.orders, s.bits)), y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5]
    n = [sum(y == k for _, y in taught) for k in (1, 0)]
    r, toxic, other = toxicity.log_count_ratios(toxicity.training_rows(docs, labels, s), s)
    assert [toxic, other] == n
    for f in set().union(*(h for h, _ in taught)):
        p, q = (sum(f in h for h, y in taught if y == k) for k in (1, 0))
        want = math.log((p + s.alpha) / (n[0] + 2 * s.alpha)) - math.log((q + s.alpha) / (n[1] + 2 * s.alpha))
        assert abs(r[f] - (want if p + q >= s.least_documents and abs(want) >= s.least_ratio else 0)) < 1e-4
    model = toxicity.fit(docs, labels)
    for row in toxicity.score_documents(docs, model).collect():
        margin = model.intercept + sum(float(model.weights[f]) for f in set(grams_of(texts[row.doc_id], s.orders, s.bits)))
        assert abs(row.score - 1 / (1 + math.exp(-margin))) < 1e-4
        assert row.predicted == rows[row.doc_id][2]


def test_samples_stay_bounded(spark):
    """The share of rows that is drawn may be far below one in a million."""
    rows = spark.range(300_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"))
    many = rows.where("false")
    for name, most in (("few", 5), ("more", 500)):
        n = sampled(rows, "lang", most, 10).count()
        assert most / 4 <= n <= 3 * most, (name, n)
    assert sampled(many, "lang", 5, 10).count() == 0
    assert sampled(rows.limit(20), "lang", 500, 10).count() == 20


def test_language_ignores_labels_of_held_out_rows(docs, languages):
    odd = docs.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    again = language_id.fit(odd)
    assert again.languages == languages.languages and (again.centroids == languages.centroids).all()


def test_no_training_rows(spark):
    none = brute.documents(spark, ["abc", None], langs=[None, None])
    got = language_id.predict_documents(none, language_id.fit(none)).collect()
    assert {(r.lang_pred, r.rejected) for r in got} == {("und", True)}
    assert language_id.predict_documents(none.limit(0), language_id.fit(none.limit(0))).count() == 0


def test_clean_documents_stay(docs, languages):
    kept = language_id.keep_known(docs, languages)
    assert kept.columns == docs.columns
    prose = docs.where("length(text) > 100")
    assert kept.where("length(text) > 100").count() >= 0.99 * prose.count()


def random_words(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(2, 10))) for _ in range(n))


def test_junk_in_letters_goes(spark, docs, languages):
    """Also when a few junk rows are labelled as a language."""
    rnd = random.Random(0)
    junk = [random_words(i, 400) for i in range(40)] + ["".join(chr(rnd.randint(32, 126)) for _ in range(2000)) for _ in range(40)]
    junk = brute.documents(spark, junk, extra=False)
    labelled = spark.createDataFrame([(-i, random_words(-i, 400), "en") for i in range(1, 5)], "doc_id long, text string, lang string")
    for model in (languages, language_id.fit(docs.select("doc_id", "text", "lang").unionByName(labelled))):
        assert language_id.keep_known(junk, model).count() == 0
        prose = docs.where("length(text) > 100")
        assert language_id.keep_known(prose, model).count() >= 0.99 * prose.count()


def test_held_out_toxicity(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = queries.op9_toxicity(spark, SF).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    yes, no = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    assert yes and no
    area = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / len(yes) / len(no)
    assert area > 0.9, area
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_odd_texts_have_a_score(spark, toxic):
    got = {r.doc_id: r for r in toxicity.score_documents(brute.documents(spark, brute.TEXTS), toxic).collect()}
    assert len(got) == len(brute.TEXTS)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[0].score == got[1].score


def test_toxicity_ignores_labels_of_held_out_rows(spark, docs, toxic):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned)
    assert abs(again.weights - toxic.weights).max() < 1e-4


def test_one_class_or_none(spark, docs):
    some = docs.limit(50)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(some, toxicity.fit(some, empty)).where("score > 0.01").count() == 0
    one = some.select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    assert toxicity.keep_clean(some, toxicity.fit(some, one)).count() == some.count()
    assert toxicity.score_documents(some.limit(0), toxicity.fit(some.limit(0), one)).count() == 0


def test_labels_joined_by_a_shuffle_give_the_same(spark, docs, toxic):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    again = toxicity.fit(docs, labels.union(labels), toxicity.Settings(broadcast_labels=1))
    assert abs(again.weights - toxic.weights).max() < 1e-4


def test_a_repeated_id_does_not_swell_the_samples(spark, monkeypatch):
    """One doc_id, that of the smallest hash, holds half of the rows; one row is there 200 times."""
    known = spark.range(3000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("h")).where(~language_id.held_out())
    hot = known.orderBy("h").first().doc_id
    ids = [r.doc_id for r in known.where(F.col("doc_id") != hot).limit(600).collect()]
    rows = [(i, f"text number {i} of its own") for i in ids] + [(hot, f"another text {i}") for i in range(600)] + [(hot, "a copy")] * 200
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    clusters, regression = language_id._clusters, toxicity._regression

    def few_clustered(x, k, rounds):
        assert 50 < len(x) < 200, f"{len(x)} rows are clustered"
        return clusters(x, k, rounds)

    def few_regressed(row, feature, x, y, ridge, steps):
        assert 100 < len(y) < 400, f"{len(y)} rows are regressed"
        return regression(row, feature, x, y, ridge, steps)

    monkeypatch.setattr(language_id, "_clusters", few_clustered)
    monkeypatch.setattr(toxicity, "_regression", few_regressed)
    assert set(language_id.fit(docs, language_id.Settings(fit_rows=100)).languages) == {"en"}
    labels = spark.createDataFrame([(i, int(i == hot or k % 2)) for k, i in enumerate([hot, *ids])], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, toxicity.Settings(fit_rows=100)).weights.shape
