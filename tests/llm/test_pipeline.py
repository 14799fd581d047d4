"""The stages of the pipeline, each held against what its operator says of single rows."""

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from quire.llm import decontamination, language_id, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        out[name] = (docs, docs := spark.read.parquet(f"file://{folder}/{name}"))
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert after.columns == before.columns or name == "bpe"


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.score_documents(before, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in after.collect()} == kept and 0 < len(kept) < before.count()


def test_languages(stages):
    before, after = stages["language_id"]
    kept = {r.doc_id for r in language_id.predict_documents(before, language_id.fit(before)).where("not rejected").collect()}
    assert {r.doc_id for r in after.collect()} == kept


def test_near_copies_go(stages):
    before, after = stages["simhash_dedup"]
    rows = before.select("doc_id", "text").collect()
    fps = [brute.fingerprint(r.text) for r in rows]
    root = brute.union([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], len(fps))
    first = {}
    for r, k in zip(rows, root, strict=True):
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())


def test_benchmark_passages_go(spark, stages):
    before, after = stages["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = decontamination.find_spans(before, bench).where("n_hit > 0").collect()
    left = {r.doc_id: r.text for r in after.collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert hit
    gone = {r.doc_id for r in hit if r.n_hit == r.n_words}
    assert set(left) == set(texts) - gone
    hits = {r.doc_id for r in hit}
    assert all(left[i] == texts[i] for i in left if i not in hits)
    assert all(len(brute.words(left[r.doc_id])) <= r.n_words - r.n_hit for r in hit if r.doc_id in left)


def test_ids(stages):
    before, after = stages["bpe"]
    rows = before.select("doc_id", "text").collect()
    _, ids = brute.library_ids([r.text for r in rows])
    got = {r.doc_id: r for r in after.collect()}
    assert {i: list(r.ids) for i, r in got.items()} == {r.doc_id: x for r, x in zip(rows, ids, strict=True)}
    assert all(got[r.doc_id].text == (r.text or "") for r in rows)


def test_run_is_the_stages(spark, stages):
    _, last = stages["bpe"]
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in last.collect())


def test_odd_documents_pass_through(spark):
    docs = brute.documents(spark, [*brute.TEXTS, *brute.TEXTS])
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert name == "bpe" or out.columns == docs.columns
        assert out.count() <= docs.count()
        assert f(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).where(F.col("ids").isNull()).count() == 0
