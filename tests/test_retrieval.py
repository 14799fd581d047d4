"""Anchors of pages, sparse postings, clusters, the keyed store: against plain loops, and by their plans and times."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.operators import clusters, postings, retrieval, sections
from quire.sources import store

# -- pages of chunks --


def pages_by_loop(chunked, pages):
    return {(d, c): sorted(n for p, n, text in pages if p == d and needle in text) if (needle := t[:60].strip(" \n\t")) else [] for d, c, t in chunked}


def test_pages_of_odd_chunks(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "a", "extraordinarily"]
    long = " ".join(rng.choice(words) for _ in range(4000))
    kana = "".join(rng.choice("あいうえお") for _ in range(3000))
    pages = [(1, k, long[1500 * k : 1500 * k + 1500]) for k in range(20)] + [(2, k, kana[500 * k : 500 * k + 500]) for k in range(6)] + [(3, 1, "tiny"), (3, 2, ""), (4, 1, "same line " * 30), (4, 2, "same line " * 30), (5, 1, None)]
    starts = [rng.randrange(len(long) - 200) for _ in range(150)]
    chunked = [(1, k, long[s : s + 200]) for k, s in enumerate(starts)] + [(2, k, kana[97 * k : 97 * k + 150]) for k in range(25)]
    chunked += [(3, 0, "tiny"), (3, 1, "in"), (3, 2, ""), (3, 3, "two words"), (4, 0, "same line " * 9), (4, 1, "same line " * 9), (4, 2, "line same"), (5, 0, "x y z w"), (6, 0, "no such document here"), (1, 900, "alpha\nbeta"), (1, 901, "lpha beta gamm"), (1, 902, "ta")]
    df = spark.createDataFrame(chunked, "doc_id long, chunk_id int, text string").withColumn("anchor", F.lit("clash"))
    got = sections.chunk_pages(df, spark.createDataFrame(pages, "doc_id long, page_number int, text string"))
    assert got.columns == [*df.columns, "page_numbers"]
    want = pages_by_loop(chunked, [p for p in pages if p[2] is not None])
    assert {(r.doc_id, r.chunk_id): r.page_numbers for r in got.collect()} == want
    assert sum(map(len, want.values())) > 100
    assert sections.chunk_pages(df.limit(0), spark.createDataFrame(pages, "doc_id long, page_number int, text string")).count() == 0


def test_ordinary_documents_exchange_no_anchors(spark, monkeypatch):
    """Chunks are held against their document's pages in a row; by anchors, where that is too much, the pages found are the same."""
    rng = random.Random(8)
    rows = [(d, k, " ".join(rng.choice("abcde") * rng.randrange(1, 9) for _ in range(40))) for d in range(4) for k in range(20 * d + 1)]
    chunked = spark.createDataFrame([*rows, (None, 0, "no document"), (9, 0, None)], "doc_id long, chunk_id int, text string")
    of = [(d, k // 3, t) for d, k, t in rows]
    pages = spark.createDataFrame([*of, *of[:5], (1, None, rows[0][2])], "doc_id long, page_number int, text string")
    got = sections.chunk_pages(chunked, pages)
    assert "Generate" not in got._jdf.queryExecution().toString()
    want = sorted((r.doc_id or -1, r.chunk_id, r.page_numbers) for r in got.collect())
    assert sum(len(w[2]) for w in want) > len(rows)
    for at, most in (("SEARCHED", 100_000), ("SEARCHED", -1), ("WHOLE", 9000)):
        with monkeypatch.context() as m:
            m.setattr(sections, at, most)
            got = sections.chunk_pages(chunked, pages)
        assert "Generate" in got._jdf.queryExecution().toString()
        assert sorted((r.doc_id or -1, r.chunk_id, r.page_numbers) for r in got.collect()) == want


def test_pages_take_linear_time(spark):
    """Twice the chunks and pages of one document take less than two and a half times as long."""

    def seconds(n):
        rng = random.Random(2)
        chunked = [(1, k, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for k in range(n)]
        pages = [(1, k, " ".join(t for _, _, t in chunked[3 * k : 3 * k + 3])) for k in range(n // 3)]
        a = spark.createDataFrame(chunked, "doc_id long, chunk_id int, text string").repartition(8).cache()
        b = spark.createDataFrame(pages, "doc_id long, page_number int, text string").repartition(8).cache()
        a.count(), b.count()
        began = time.time()
        assert sections.chunk_pages(a, b).where("size(page_numbers) = 1").count() >= n - 2
        return time.time() - began

    seconds(200)
    assert seconds(8000) < 2.5 * seconds(4000) + 0.5


# -- sparse postings --


def plain_terms(text):
    words = [w.translate(str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) for w in (text or "").lower().split()]
    return Counter(w for w in words if len(w) > 2 and w not in fixed.STOP_WORDS)


def exhaustive(rows, queries, most):
    tf = {k: plain_terms(t) for k, t in rows}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        raw = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    vectors, out = {k: unit(c) for k, c in tf.items() if c}, []
    for q, text in queries:
        own = unit(plain_terms(text))
        near = sorted((-round(sum(w * v.get(t, 0) for t, w in own.items()), 9), k) for k, v in vectors.items())
        out += [(q, k, rank, -s) for rank, (s, k) in enumerate([x for x in near if -x[0] > 0.1][:most], 1)]
    return sorted(out)


def test_sparse_top_is_the_exhaustive_one(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(3000)]
    # Neighbours share a topic; a few words are in nearly all rows.
    rows = [(k, " ".join(["common"] * rng.randint(0, 2) + ["usual"] + [rng.choice(words[40 * (k // 25) : 40 * (k // 25) + 60]) for _ in range(20)])) for k in range(1800)]
    rows += [(1800, None), (1801, ""), (1802, "the of"), (1803, rows[5][1]), (1804, rows[5][1]), (1805, "lonely " * 3000)]
    queries = [(k, " ".join(rng.sample(rows[k * 17][1].split(), 6) + ["common"])) for k in range(60)] + [(90, "common usual"), (91, ""), (92, None), (93, "unknown"), (94, rows[5][1]), (95, "lonely")]
    index = postings.build(spark.createDataFrame(rows, "row long, text string").repartition(4), ["row"])
    best, scored = postings.search(spark.createDataFrame(queries, "query_id long, text string"), index)
    got = sorted((r.query_id, r.row, r.rank, r.score) for r in best.collect())
    want = exhaustive(rows, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))
    blocks = index.tops.select("block").distinct().count()
    share = scored.where("query_id < 60").count() / (60 * blocks)
    print(f"{blocks} blocks, {share:.3f} of them scored")
    assert blocks > 25 and share < 0.35  # of the words in nearly all rows every block has one


def test_sparse_search_exchanges_no_postings(spark):
    """Queries meet blocks in the tasks that read them, however common their terms; queries taken in several blocks find the same rows."""
    rows = spark.createDataFrame([(k // 2, f"common words everywhere {'abcdefg'[k % 7] * 4} {'uvwxyz'[k % 5] * 3}") for k in range(600)], "row long, text string")
    index = postings.build(rows, ["row"])
    asked = spark.createDataFrame([(k, f"common words {'abcdefg'[k % 7] * 4}") for k in range(40)] + [(None, "common words")], "query_id long, text string")
    shared = spark.sparkContext.broadcast(postings._by_term(postings._asked(asked, index).toArrow()))
    shared.kind = asked.schema["query_id"].dataType
    assert "Exchange" not in postings._against(index, shared, 5)._jdf.queryExecution().executedPlan().toString()
    found = [sorted(tuple(r) for r in postings.search(asked, index, query_rows=n)[0].collect()) for n in (100, 7)]
    assert found[0] == found[1] and len(found[0]) == 200 and len({r[:2] for r in found[0]}) == 200


def test_sparse_top_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, "some words here")], "row long, text string")
    asked = rows.withColumnRenamed("row", "query_id")
    assert postings.search(asked, postings.build(rows.limit(0), ["row"]))[0].count() == 0
    assert postings.search(asked.limit(0), postings.build(rows, ["row"]))[0].count() == 0


# -- clusters --


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_clusters_give_the_same_rows(spark, spread, monkeypatch):
    monkeypatch.setattr(clusters, "PART_ROWS", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = [(k, (centres[k % 20] + rng.normal(scale=spread, size=16)).round(4).tolist()) for k in range(1500)] + [(2000 + k, centres[0].tolist()) for k in range(300)]
    x += [(3000, [0.0] * 16), (3001, None), (3002, [1.0, None]), (3003, [1.0, 2.0]), (3004, [2.0, 4.0]), (3005, [float("nan")] * 16), (3006, [])]
    vectors = spark.createDataFrame(x, "id long, embedding array<double>").repartition(4)
    queries = vectors.where("id % 40 = 3 or id in (2000, 3003)").withColumnRenamed("id", "query_id")
    best, compared = clusters.nearest(queries, vectors)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    assert rows(best) == rows(retrieval.cosine_top(queries, vectors))
    share = compared / (queries.count() * len(x))
    print(f"spread {spread}: {share:.3f} of the pairs compared")
    assert share < (0.3 if spread == 0.05 else 1.01)
    assert clusters.nearest(queries.limit(0), vectors)[0].count() == 0 and clusters.nearest(queries, vectors.limit(0))[0].count() == 0


def test_one_block_of_queries_is_broadcast_at_a_time(spark, monkeypatch):
    live, most = [], []
    original, destroy = type(spark.sparkContext).broadcast, None

    def broadcast(self, value):
        b = original(self, value)
        live.append(b)
        most.append(len(live))
        gone = b.destroy
        b.destroy = lambda *a: (live.remove(b), gone(*a))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    vectors = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(200)], "id long, embedding array<double>")
    retrieval.cosine_top(vectors.withColumnRenamed("id", "query_id"), vectors, query_rows=20)
    assert len(most) == 10 and max(most) == 1 and not live


def test_chunk_scores_are_those_of_vectors(spark):
    rng = random.Random(5)
    texts = ["", "one", "One one two", *[" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(80))) for _ in range(40)]]
    chunked = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, chunk_id int, text string")
    questions = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts[:9])], "query_id long, doc_id long, question string")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.retrieved(questions, chunked, 100).collect()}
    v = {r.chunk_id: np.array(r.v) for r in chunked.select("chunk_id", retrieval.hashed_vector(F.col("text")).alias("v")).collect()}
    assert all(x.sum() == len(re.findall(r"\w+", texts[k])) for k, x in v.items())
    want = {(q, c): v[q] @ v[c] / max(np.linalg.norm(v[q]) * np.linalg.norm(v[c]), 1e-10) for q in range(9) for c in v}
    assert all(abs(got.get(k, 0) - s) < 1e-8 for k, s in want.items() if s > 0.1) and set(got) == {k for k, s in want.items() if round(s, 9) > 0.1}


# -- the keyed store --


def test_appends_read_what_they_touch(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("old").alias("t"))
    store.append(rows, path)
    few = spark.createDataFrame([(3, "new"), (1000, "new"), (1000, "newer")], "doc_id long, t string")
    plan = store.lacking(store.first_rows(few, "doc_id", ["t"]).withColumn(store.BUCKET, store.bucket_of("doc_id")), path, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*key_bucket#\d+ (IN|=)", plan) and "GreaterThanOrEqual(doc_id,3)" in plan and re.search(r"ReadSchema: struct<doc_id:bigint>", plan)
    before = set(tmp_path.rglob("*.parquet"))
    for _ in range(2):
        store.append(few, path, order=["t"])
    assert len(set(tmp_path.rglob("*.parquet")) - before) == 1  # a file for the one key that is new; the second time none
    got = {r.doc_id: r.t for r in spark.read.parquet(path).collect()}
    assert len(got) == 501 and got[3] == "old" and got[1000] == "new"
    one = store.get(spark, path, rows.schema, "doc_id", [1000, None])
    assert [tuple(r) for r in one.collect()] == [(1000, "new")] and "PartitionFilters: [key_bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_appends_make_their_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def passed(parts):
        for part in parts:
            made.add(len(part))
            yield part

    for k, want in ((0, 100), (50, 200), (300, 300)):
        store.append(spark.range(k, k + 100).select(F.col("id").alias("doc_id")).mapInPandas(passed, "doc_id long"), f"file://{tmp_path}/t")
        assert made.value == want
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 250


def test_store_of_odd_keys(spark, tmp_path):
    path, kind = f"file://{tmp_path}/t", "k string, v int, `a.b` string"
    schema = spark.createDataFrame([], kind).schema
    assert store.read(spark, path, schema).count() == 0 and store.find(spark.createDataFrame([("x",)], "k string"), path, schema, "k").count() == 0
    rows = spark.createDataFrame([(None, 2, "x"), (None, 1, "y"), ("", 1, None), ("é/=", 1, None), ("é/=", 1, None)], kind)
    for _ in range(2):
        store.append(rows, path, "k", ["v"])
    store.append(rows.limit(0), path, "k")
    got = store.find(rows.select("k"), path, schema, "k")
    assert got.columns == ["k", "v", "a.b"] and sorted((str(r.k), r.v) for r in got.collect()) == [("", 1), ("None", 1), ("é/=", 1)]
    assert store.get(spark, path, schema, "k", [None]).first()["a.b"] == "y" and store.get(spark, path, schema, "k", ["none"]).count() == 0
