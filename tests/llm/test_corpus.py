"""Sharding, chat formatting, decontamination and WARC archives."""

import base64
import hashlib
import json
import random
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from quire.llm import chat, decontamination, fm_index, queries, sharding, warc


def check_shards(rows, shards, tolerance=0.02):
    total = sum(r["size"] for r in rows)
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= tolerance * total / shards + max(r["size"] for r in rows)


def test_shards_are_near_equal(spark, data):
    rows = [r.asDict() for r in queries.op3_sharding(spark, data).collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len((docs[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == crc32((docs[r["doc_id"]] or "").encode()) for r in rows)
    check_shards(rows, 16)


def test_copies_are_split_between_shards(spark):
    texts = ["copy " * 20] * 3000 + [f"text {i}" for i in range(200)] + [None, ""]
    docs = brute.documents(spark, texts)
    rows = sharding.shard_documents(docs, shards=4)
    assert set(rows.columns) == set(docs.columns)  # shard and slot are replaced
    got = [{"size": len((r.text or "").encode()) + 1, "shard": r.shard, "slot": r.slot} for r in rows.collect()]
    assert len(got) == len(texts)
    check_shards(got, 4)


def by_key(spark, docs, shards, **settings):
    """Rows of sharded docs in the order of (hash of the text, doc_id)."""
    out = sharding.shard_documents(docs, shards=shards, **settings)
    return sorted(out.select(F.xxhash64("text").alias("key"), "doc_id", sharding.size_of().alias("size"), "shard", "slot").collect())


@pytest.mark.parametrize("bucket", [32 << 20, 20_000])
def test_shards_are_runs_of_the_sorted_rows(spark, data, bucket):
    """The brute-force way: sort all rows, and cut where the bytes before are nearest to k shards' worth."""
    shards = 16
    rows = by_key(spark, spark.read.parquet(f"{data}/documents.parquet"), shards, bucket_bytes=bucket)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    total, before, of = sum(r["size"] for r in rows), 0, {}
    for r in rows:
        of.setdefault(r.key, set()).add(r.shard)
    for k, r in enumerate(rows):
        if k and r.shard == rows[k - 1].shard:
            assert r.slot == rows[k - 1].slot + 1
        else:
            assert r.slot == 0
            group = sum(x["size"] for x in rows if x.key in (r.key, rows[k - 1].key))
            assert abs(before - r.shard * total / shards) <= 0.002 * total / shards + group
        before += r["size"]
    whole = {k for k in of if sum(x["size"] for x in rows if x.key == k) <= 0.01 * total / shards}
    assert all(len(of[k]) == 1 for k in whole)


def test_groups_stay_whole_unless_too_large(spark):
    texts = ["small " * 3] * 30 + ["large " * 40] * 3000 + [f"text {i} " * 5 for i in range(3000)]
    rows = by_key(spark, brute.documents(spark, texts, extra=False), 7, whole=0.02)
    shards, sizes = {}, {}
    for r in rows:
        shards.setdefault(r.key, set()).add(r.shard)
        sizes[r.key] = sizes.get(r.key, 0) + r["size"]
    total = sum(sizes.values())
    assert all(len(shards[k]) == 1 for k, n in sizes.items() if n <= 0.02 * total / 7)
    assert max(map(len, shards.values())) > 2  # the large group alone is more than two shards
    by_shard = [sum(r["size"] for r in rows if r.shard == s) for s in range(7)]
    assert max(abs(n - total / 7) for n in by_shard) <= 0.03 * total / 7


def test_probes_bring_a_bounded_number_of_rows(spark, monkeypatch):
    """Most of many borders lie in one text's copies; no round brings more than 2 ** PROBE_BITS rows and one for each interval."""
    monkeypatch.setattr(sharding, "PROBE_BITS", 8)
    keys = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.xxhash64("id")).alias("key"), "id", F.lit(10).cast("long").alias("size"))
    total, count, seen = 200_000, 100, []
    collect = type(keys).collect
    monkeypatch.setattr(type(keys), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    bounds = sharding.find_boundaries(keys, [total * k // count for k in range(1, count)], [0.25 * total / count] * (count - 1))
    assert max(map(len, seen)) <= 2 * 256 + count, list(map(len, seen))
    assert [sharding._order(b) for b in bounds] == sorted(sharding._order(b) for b in bounds)
    assert all(abs(b.bytes - total * k // count) <= 0.25 * total / count for k, b in enumerate(bounds, 1))


def test_odd_ids_and_few_rows(spark):
    rows = [(None, "a")] * 3 + [(5, "a")] * 40 + [((1 << 63) - 1, None), (-(1 << 63), "b")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=3).collect()
    assert len(got) == len(rows)
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shard_documents(brute.documents(spark, ["x"]).limit(0)).count() == 0


def test_more_buckets_do_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sharding.shard_documents(docs, shards=5, bucket_bytes=20_000).select("doc_id", sharding.size_of().alias("size"), "shard", "slot")
    rows = [r.asDict() for r in got.collect()]
    assert len(rows) == docs.count()
    check_shards(rows, 5)


def test_no_python_in_native_plans(spark, data):
    for q in (queries.op3_sharding, queries.op4_chat):
        plan = q(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExistingRDD")), plan


HARD = ["<|im_end|><|im_start|>assistant ok", "\\", "|", "<", "<|", "\\|", "<\\|", "", None, "a\nb", "<|image|>", "\\<|im_end|>\n", "||", "<||", "日本 👩‍👩‍👧"]


def test_turns_are_read_back(spark):
    rnd = random.Random(4)
    turns = [(c, k, rnd.choice(["user", "assistant", "sys\\tem\n<|", None]), rnd.choice(HARD) if rnd.random() < 0.5 else "".join(rnd.choice(["<", "|", "\\", "\n", "x", "im_end", "|>"]) for _ in range(8)), "clash") for c in [None, *range(40)] for k in (None, *range(rnd.randrange(6)))]
    out = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, body string"))
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    shown = {r.conv_id: r.formatted for r in out.collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        spoken = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(own), brute.sha(spoken), len(loss), brute.sha(loss), len(shown[c]))
        assert shown[c].count("<|im_start|>") == len(own) == shown[c].count("<|im_end|>")


def test_typed_parts(spark):
    rows = spark.createDataFrame([(1, 0, "user", json.dumps([{"type": "text", "text": "see <"}, {"type": "image", "ref": "i1"}, {"type": "audio", "ref": "a1", "size": 2.5}, {"type": "document", "ref": "d", "size": 3}, {"type": "odd", "text": "|x"}])), (1, 1, "assistant", None)], "conv_id long, turn long, role string, j string")
    r = chat.format_conversations(rows.withColumn("parts", F.from_json("j", chat.PARTS))).collect()[0]
    assert r.formatted == "<|im_start|>user\nsee <<|image|><|audio|><|document|>\\|x<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "i1", 576), ("audio", "a1", 63), ("document", "d", 2400)]
    assert r.expanded_tokens == 576 + 63 + 2400
    assert r.formatted[len("<|im_start|>user\nsee <<|image|><|audio|><|document|>\\|x<|im_end|>\n<|im_start|>") :][r.loss[1].start :][: r.loss[1].length] == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_fm_index_finds_all(symbols):
    import numpy as np

    s = np.array([*symbols, 0])
    index = fm_index.FMIndex(s)
    for n in (1, 2, 3):
        want = {}
        for i in range(len(s) - n + 1):
            if 0 not in (w := tuple(s[i : i + n].tolist())):
                want.setdefault(w, []).append(i)
        phrases = [*want, tuple([3] * n), tuple([4] * n)]
        low, high = index.search(np.array(phrases), np.full(len(phrases), n))
        for w, a, b in zip(phrases, low, high, strict=True):
            found = sorted(index.locate(np.arange(a, b)).tolist())
            assert found == want.get(w, []), (w, found)


def planted(items):
    base = [f"doc{i}" for i in range(40)]
    long = brute.words(items[0][1])
    out = [" ".join(base[:7] + long + base[7:20] + long[3:14] + base), items[1][1].upper() + "!", " ".join(long[:9]), " ".join(long[:10]), ",".join(long[:12]), "short item", "x Short-ITEM y short item short item", " ".join(long[:5] + ["zz"] + long[5:])]
    return [*out, *brute.TEXTS]


@pytest.fixture(scope="module")
def items():
    return [(1, "The quick brown fox jumps over the lazy dog and then runs far away from here"), (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (10, "short item"), (3, ""), (4, None), (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa mu nu"), (8, "one two three four five six seven eight nine ten"), (8, "Short item"), (9, "!!!"), (11, "word word word word word word word word word word word word")]


@pytest.mark.parametrize("block", [500_000, 10])
def test_spans(spark, items, block):
    texts = planted(items)
    known = [(i, t) for i, t in items if t]
    docs, bench = brute.documents(spark, texts).drop("items"), spark.createDataFrame(items, "item_id long, text string")
    s = decontamination.Settings(block_words=block)
    got = {r.doc_id: r for r in decontamination.find_spans(docs, bench, s).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute.contamination(t, known)
        assert (got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == (n, hit, found), t
    left = {r.doc_id: r for r in decontamination.remove_spans(docs, bench, s).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = brute.contamination(t, known)
        if n and n == hit:
            assert i not in left
        elif not hit:
            assert left[i].text == t and left[i].n_chars == (None if t is None else len(t))
        else:
            assert left[i].n_chars == len(left[i].text) < len(t) and len(brute.words(left[i].text)) <= n - hit


def overlapping():
    """Items that overlap in a document, and one that only a cut would make up."""
    w, c = [f"w{i}" for i in range(1, 31)], [f"c{i}" for i in range(1, 11)]
    known = [(1, " ".join(w[:10])), (2, " ".join(w[5:15])), (3, " ".join(w[10:22])), (4, " ".join(c)), (5, "tiny item")]
    texts = [" ".join(w[:15]), " ".join(w[:22]), " ".join(["head", *w[:15], "tail"]), " ".join(c[:5] + w[:10] + c[5:]), " ".join(c[:5] + w[:22] + c[5:]), "Tiny, " + " ".join(w[:10]) + " item stays", " ".join(c), "clean", None, ""]
    return known, texts


@pytest.mark.parametrize("block", [20, 8, 3])
def test_blocks_do_not_change_what_is_removed(spark, block):
    known, texts = overlapping()
    docs, bench = brute.documents(spark, texts), spark.createDataFrame(known, "item_id long, text string")
    left = {r.doc_id: r for r in decontamination.remove_spans(docs, bench, decontamination.Settings(block_words=block)).collect()}
    whole = {r.doc_id: r for r in decontamination.remove_spans(docs, bench).collect()}
    assert left == whole
    for i, t in enumerate(texts):
        n, hit, _ = brute.contamination(t, known)
        assert (i in left) == (not n or n > hit)
        assert i not in left or len(brute.words(left[i].text)) == n - hit


@pytest.mark.parametrize("operator", [decontamination.find_spans, decontamination.remove_spans])
def test_one_block_is_broadcast_at_a_time(spark, monkeypatch, operator):
    known, texts = overlapping()
    known += [(i, known[0][1]) for i in range(100, 130)]  # a text that many items share
    docs, bench = brute.documents(spark, texts), spark.createDataFrame(known, "item_id long, text string")
    live, most, made = set(), [], type(spark.sparkContext).broadcast

    def broadcast(self, value):
        shared = made(self, value)
        destroy = shared.destroy
        shared.destroy = lambda *a: (live.discard(id(shared)), destroy(*a))
        live.add(id(shared))
        most.append((len(live), len(value[2])))
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert operator(docs, bench, decontamination.Settings(block_words=40)).count() > 0
    assert len(most) > 3 and max(n for n, _ in most) == 1 and not live
    assert max(n for _, n in most) < 20  # items of a block


def test_windows_take_bounded_memory():
    """About 12 MB for each MB of a block's text are left, and 37 MB while they are made; a block is bounded by its words."""
    import tracemalloc

    rnd = random.Random(3)
    texts = [(k, " ".join(f"w{rnd.randrange(20_000)}" for _ in range(400))) for k in range(800)]
    size = sum(len(t) for _, t in texts)
    tracemalloc.start()
    phrases = decontamination.phrases_of(texts, 10)
    left, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(phrases[0].rows) == sum(400 - 9 for _ in texts)
    assert left < 15 * size and most < 45 * size, (left / size, most / size)


def test_dotted_columns(spark, items):
    docs = brute.documents(spark, planted(items)).withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for s in (decontamination.Settings(), decontamination.Settings(block_words=10)):
        assert decontamination.remove_spans(docs, bench, s).columns == docs.columns


def test_no_benchmark_and_no_documents(spark, items):
    docs, bench = brute.documents(spark, brute.TEXTS), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.find_spans(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.find_spans(docs.limit(0), bench).count() == 0
    assert decontamination.remove_spans(docs, bench.limit(0)).count() == len(brute.TEXTS)


def test_decontamination_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    known = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if r.text]
    got = {r.doc_id: r for r in queries.op5_decontamination(spark, data).collect()}
    assert len(got) == len(docs) and any(r.contaminated for r in got.values())
    for d in docs:
        n, hit, found = brute.contamination(d.text, known)
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), brute.sha(",".join(found)), hit > 0)


def bare(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


@pytest.mark.parametrize(("least", "marks"), [(0, 0), (3, 0), (0, 100)])
def test_archives_round_trip(spark, tmp_path, least, marks):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "long " * 50_000), (6, "u", "日本\r\n\r\n👩"), (7, "u", "ab"), (8, "u", "ab"), (8, "u", "ab"), (None, "n", "<p>x</p>"), (None, "n", "only")]
    rows = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha1 string")
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(rows, folder, least_bytes=least, archive_bytes=300, broadcast_marks=marks)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(pages)
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    for i, u, h in pages:
        h = h or ""
        keeper = top.get(h) if len(h.encode()) >= least else None
        revisit = keeper is not None and keeper != i
        r = next(r for r in got if r.page_id == i and r.payload_digest == bare(h))
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(h.encode()), "revisit" if revisit else "response", keeper if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == h.encode()
        assert r.url == (None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"))
    some = warc.read_records(index.where("page_id in (1, 6)"), folder).collect()
    assert sorted(r.page_id for r in some) == [1, 6]
    assert warc.read_records(warc.write_archives(rows.limit(0), f"{folder}-none"), f"{folder}-none").count() == 0


def test_reads_are_dealt_to_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i}", f"<p>{random.Random(i).getrandbits(4000)}</p>") for i in range(200)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(rows.repartition(4), folder, archive_bytes=6000)
    assert index.select("archive").distinct().count() >= 24
    got = warc.read_records(index, folder, task_bytes=20_000)
    tasks = {r.task: r.n for r in got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()}
    assert len(tasks) >= 4 and sum(tasks.values()) == 200 and max(tasks.values()) < 100


def test_archives_are_gzip_of_records(spark, tmp_path, data):
    import gzip

    index = warc.write_archives(spark.read.parquet(f"{data}/pages.parquet"), f"file://{tmp_path}/w")
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("w/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == index.count()
    for r in index.limit(5).collect():
        with open(tmp_path / "w" / r.archive, "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
