"""Token counts and BPE against the libraries, over whole texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from quire.llm import bpe, queries, token_counts, words


def test_counts_are_the_librarys(spark):
    _, ids = brute.library_ids(brute.TEXTS)
    got = {r.doc_id: r for r in token_counts.count_tokens(brute.documents(spark, brute.TEXTS), brute.BYTE_BPE).collect()}
    assert len(got) == len(brute.TEXTS)
    for i, (t, own) in enumerate(zip(brute.TEXTS, ids, strict=True)):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(own), len(own) > 512), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    texts = [t for t in brute.TEXTS if len(t or "") < 10_000]
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(p.encode(t or "")) for t in texts]
    else:
        want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(brute.documents(spark, texts), path).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_cache_takes_misses_only(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = brute.documents(spark, ["a b", "a b", "c", None])
    first = sorted(token_counts.count_tokens(docs, brute.BYTE_BPE, cache).collect())
    rows = spark.read.parquet(cache)
    assert rows.count() == 3  # distinct texts
    # A wrong count shows that the cache is what answers.
    rows.withColumn("n_tokens", F.lit(1000).cast("long")).write.partitionBy("tokenizer_digest").parquet(f"file://{tmp_path}/other")
    more = brute.documents(spark, ["a b", "new text", None])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, brute.BYTE_BPE, f"file://{tmp_path}/other").collect()}
    assert got[0] == got[2] == 1000 and got[1] == 2
    assert spark.read.parquet(f"file://{tmp_path}/other").count() == 4
    assert first == sorted(token_counts.count_tokens(docs, brute.BYTE_BPE, cache).collect())


@pytest.mark.parametrize("most", [0, 2, 200_000])
def test_warm_cache_moves_no_text(spark, tmp_path, monkeypatch, most):
    cache, docs = f"file://{tmp_path}/cache", brute.documents(spark, brute.TEXTS)
    first = sorted(token_counts.count_tokens(docs, brute.BYTE_BPE, cache, broadcast_misses=most).collect())
    encoded = []
    monkeypatch.setattr(token_counts, "_append", lambda rows, cache: encoded.append(rows))
    again = token_counts.count_tokens(docs, brute.BYTE_BPE, cache, broadcast_misses=most)
    assert len(encoded) == 1  # the empty table; no text is read again
    assert first == sorted(again.collect())
    assert "text" not in again._jdf.queryExecution().executedPlan().toString()


def test_partly_warm_cache_moves_what_it_lacks(spark, tmp_path, monkeypatch):
    cache, texts = f"file://{tmp_path}/cache", [f"text number {i} of many" for i in range(400)]
    docs = brute.documents(spark, texts + texts[:50])
    token_counts.count_tokens(docs.where("doc_id >= 30 and doc_id < 400"), brute.BYTE_BPE, cache)
    seen, original = [], token_counts.perhaps_missing
    monkeypatch.setattr(token_counts, "perhaps_missing", lambda texts, misses: seen.append(original(texts, misses)) or seen[-1])
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, brute.BYTE_BPE, cache, broadcast_misses=5).collect())
    assert got == sorted(tuple(r) for r in token_counts.count_tokens(docs, brute.BYTE_BPE).collect())
    passed = seen[0].groupBy("content_digest").count().collect()
    assert len(passed) == 30 and sum(r["count"] for r in passed) == 60
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning(content_digest" not in plan


def test_empty_tables(spark):
    none = brute.documents(spark, ["x"]).limit(0)
    assert token_counts.count_tokens(none, brute.BYTE_BPE).count() == 0
    assert bpe.encode_and_decode(none, brute.BYTE_BPE).count() == 0


def test_words_are_the_librarys(data):
    import pyarrow.parquet as pq

    w = words.byte_level(brute.BYTE_BPE)
    for text in [*pq.read_table(f"{data}/documents.parquet").column("text").to_pylist(), *brute.TEXTS]:
        split = w.split(text)
        assert "".join(split) == (text or "")
        assert [i for x in w.encode(split) for i in x] == brute.library_ids([text])[1][0]


def test_bpe_round_trip(spark):
    texts = [*brute.TEXTS, *brute.TEXTS[:4]]
    t, ids = brute.library_ids(texts)
    got = {r.doc_id: r for r in bpe.encode_and_decode(brute.documents(spark, texts), brute.BYTE_BPE).collect()}
    assert len(got) == len(texts)
    for i, own in enumerate(ids):
        assert got[i].ids == own
        assert got[i].text == t.decode(own, skip_special_tokens=False) == (texts[i] or "")


def test_bpe_chunks_do_not_matter(spark):
    docs = brute.documents(spark, brute.TEXTS).repartition(3)
    small = bpe.encode(docs, brute.BYTE_BPE, chunk_words=7, chunk_distinct=3)
    assert sorted(small.collect()) == sorted(bpe.encode(docs, brute.BYTE_BPE).collect())


def test_ids_that_are_not_utf8_or_unknown(spark):
    t = Tokenizer.from_file(brute.BYTE_BPE)
    lists = [[222, 65], [50256], [], [0, 1, 2], [447], [159, 246, 34]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)] + [(99, None), (100, [999_999, 0])], "k int, ids array<int>")
    got = {r.k: r.text for r in rows.select("k", bpe.decoder(brute.BYTE_BPE)(F.col("ids")).alias("text")).collect()}
    for k, x in enumerate(lists):
        assert got[k] == t.decode(x, skip_special_tokens=False)
    assert got[100] == "!"


def test_queries(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    t, ids = brute.library_ids([r.text for r in docs])
    counts = {r.doc_id: r for r in queries.op1_token_counts(spark, data).collect()}
    coded = {r.doc_id: r for r in queries.op7_bpe(spark, data).collect()}
    assert len(counts) == len(coded) == len(docs)
    for r, own in zip(docs, ids, strict=True):
        assert counts[r.doc_id].n_tokens == coded[r.doc_id].n_tokens == len(own)
        assert coded[r.doc_id].ids_sha256 == brute.sha(",".join(map(str, own)))
        assert coded[r.doc_id].decoded_sha256 == brute.sha(t.decode(own, skip_special_tokens=False))
