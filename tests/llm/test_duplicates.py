"""SimHash and embedding near-dedup against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from quire.llm import components, embed_dedup, queries, simhash


def by_brute_force(ids, fps):
    n = len(fps)
    root = brute.union([(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], n)
    smallest = {}
    for i, r in enumerate(root):
        smallest[r] = min(smallest.get(r, ids[i]), ids[i])
    return [smallest[r] for r in root]


def test_edge_texts(spark):
    texts = [*brute.TEXTS, *brute.TEXTS[:5]]
    want = [brute.fingerprint(t) for t in texts]
    roots = by_brute_force(list(range(len(texts))), want)
    got = {r.doc_id: r for r in simhash.find_groups(brute.documents(spark, texts)).collect()}
    assert [(got[i].fingerprint, got[i].component_id) for i in range(len(texts))] == [(f"{f:016x}", r) for f, r in zip(want, roots, strict=True)]


def test_links_are_all_found(spark):
    """Fingerprints around a few centres, among them chains, at distances from 0 to 5."""
    rnd = random.Random(1)
    fps = []
    for _ in range(40):
        f = rnd.getrandbits(64)
        for _ in range(12):
            fps.append(f)
            for _ in range(rnd.randrange(6)):
                f ^= 1 << rnd.randrange(64)
    want = by_brute_force(list(range(len(fps))), fps)
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    grouped = simhash._grouped(rows)
    got = {r.doc_id: r.component_id for r in rows.join(grouped, "fp").collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_hot_keys_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_GROUP", 7)
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ rnd.getrandbits(12) for _ in range(300)})
    want = by_brute_force(list(range(len(fps))), fps)
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in rows.join(simhash._grouped(rows), "fp").collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_one_of_each_group_stays(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base, base + " tail", "other text of its own here", None, ""]
    docs = brute.documents(spark, texts)
    groups = {r.doc_id: r.component_id for r in simhash.find_groups(docs).collect()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))
    # The same doc_id twice, and null ids.
    again = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(again).collect()) == [("1", "a b c d"), ("None", "q r s t")]
    for most in (0, 1_000_000):  # marks joined by a shuffle, and broadcast
        got = simhash.keep_one(again.union(again).withColumn("a.b", F.lit(1)), most)
        assert got.columns == ["doc_id", "text", "a.b"]
        assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", "a b c d"), ("None", "q r s t")]
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.find_groups(docs.limit(0)).count() == 0


def test_simhash_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute.fingerprint(r.text) for r in docs]
    want = by_brute_force([r.doc_id for r in docs], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_dedup(spark, data).collect()}
    assert got == {r.doc_id: (f"{f:016x}", w) for r, f, w in zip(docs, fps, want, strict=True)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(3)
    n = 200
    order = list(range(n))
    rnd.shuffle(order)
    pairs = {"chain": list(zip(order, order[1:], strict=False)), "star": [(order[0], x) for x in order[1:]], "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(120)], "none": []}[shape]
    want = brute.union(pairs, n)
    got = {r.v: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: r for i, r in enumerate(want) if r != i}


def exact_groups(ids, vectors, threshold=0.95):
    n = len(vectors)
    x = np.zeros((n, max((len(v) for v in vectors if v), default=1)))
    good = []
    for i, v in enumerate(vectors):
        ok = bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        good.append(ok)
        if ok:
            x[i, : len(v)] = v
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = x @ x.T >= threshold
    pairs = [(i, j) for i in range(n) for j in range(i) if good[i] and good[j] and len(vectors[i]) == len(vectors[j]) and near[i, j]]
    root, links = brute.union(pairs, n), np.zeros(n, int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    return {ids[i]: (int(links[i]), ids[root[i]]) for i in range(n)}, len(pairs)


def test_odd_vectors(spark):
    vectors = [[1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [1.0, 0.0, 0.0], None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [0.0, 1.0], [0.0, 2.0], [2.0, 0.0, 0.0], [-1.0, 0.0, 0.0]]
    rows = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, cid string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.find_groups(rows).collect()}
    assert got == exact_groups(list(range(len(vectors))), vectors)[0]
    assert embed_dedup.find_groups(rows.limit(0)).count() == 0


def test_embedding_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    want, pairs = exact_groups([r.vec_id for r in rows], [list(r.embedding) for r in rows])
    got = {r.vec_id: r for r in queries.op6_embed_dedup(spark, sf).collect()}
    assert len(got) == len(want)
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * pairs
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.95 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def links_by_brute_force(x, threshold=0.95):
    return np.concatenate([(x[a : a + 1000] @ x.T >= threshold).sum(axis=1) - 1 for a in range(0, len(x), 1000)])


@pytest.mark.parametrize(("n", "size", "common"), [(1500, 64, 0.0), (8000, 64, 0.0), (1500, 384, 0.0), (1500, 64, 0.6), (1500, 64, 0.85), (1200, 384, 0.85)])
def test_recall_of_planted_pairs(spark, monkeypatch, n, size, common):
    """Pairs at cosines from 0.93 to 0.99 among vectors whose mean cosine is `common`: n above 0.95 and n / 2 below."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.sqrt(common) * unit(rng.normal(size=(1, size))) + np.sqrt(1 - common) * unit(rng.normal(size=(3 * n // 2, size))))
    cosine = np.concatenate([rng.uniform(0.9505, 0.99, n), rng.uniform(0.93, 0.9495, n // 2)])[:, None]
    aside = rng.normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    x = np.vstack([x, cosine * x + np.sqrt(1 - cosine**2) * aside])
    used, original = [], embed_dedup.indexed

    def watched(*a):
        permutations, pivots = original(*a)
        used.append((embed_dedup.list_pairs(permutations), pivots[size]))
        return permutations, pivots

    monkeypatch.setattr(embed_dedup, "indexed", watched)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = {r.vec_id: r.n_links for r in embed_dedup.find_groups(rows).collect()}
    want = links_by_brute_force(x)
    recall, share = sum(links.values()) / want.sum(), used[0][0] / (len(x) * (len(x) - 1) / 2)
    print(f"{len(used[0][1].points)} pivots, {used[0][1].nearest} nearest, {want.sum() // 2} pairs, recall {recall:.4f}, compared {share:.4f}")
    assert len(used[0][1].points) > 100 and want.sum() // 2 >= n and share < 0.05
    assert all(links[i] <= k for i, k in enumerate(want.tolist()))
    assert recall >= 0.9, recall


def test_shared_pivots_are_counted():
    near = np.array([[1, 2, 3, 4], [2, 1, 4, 3], [4, 3, 2, 1], [1, 7, 8, 9], [1, 7, 5, 6]], np.int32)
    i, j = np.array([0, 0, 0, 3]), np.array([1, 2, 3, 4])
    count, first = embed_dedup._shared(near, i, j)
    assert count.tolist() == [4, 4, 1, 2] and embed_dedup._counts(near)[i, j].tolist() == [4, 4, 1, 2]
    assert first[0] == embed_dedup._list_of(1, 2, 0) and first[3] == embed_dedup._list_of(1, 7, 0)


def test_a_larger_count_only_takes_links_away(spark):
    """Vectors around one centre share all their pivots, in lists of over 32 rows and under."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(300, 16)), rng.normal(size=(1, 16)) + rng.normal(scale=0.01, size=(60, 16))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, _ = exact_groups(list(range(len(x))), x.tolist())
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.find_groups(rows, embed_dedup.Settings(least_shared=3, recall=0.99)).collect()}
    assert all(got[i][0] <= n for i, (n, _) in want.items()) and sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_blocks_count_each_pair_once(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    vectors = [(centre + rng.normal(scale=0.05, size=16)).tolist() for _ in range(150)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding"))
    want, _ = exact_groups(list(range(150)), vectors)
    s = embed_dedup.Settings(block=9)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.find_groups(rows, s).collect()}
    assert got == want
