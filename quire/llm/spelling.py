"""Spelling variants by errata-trie merging.

Words form a trie, kept as a table: a node is the hash of a prefix, an edge a node and the next character (none for the
end of a word). Of each node with several edges the heavy one leads to most words; a word has at most log2(words) light
edges on its way. At each of them its light subtree is merged into the rest with one character skipped or replaced, always the
smaller into the larger, so a word is merged at most log2(words) times:

- its character replaced by the heavy one: does it coincide with a terminal of the heavy subtree?
- its character replaced by a wildcard: which other light subtrees of the node have the same rest?
- its character skipped: does it coincide with a terminal below the node? Within a run of one character the last one
  is skipped, so that each pair is found at a single node;
- the heavy character skipped in a word of the heavy subtree, seen from the light word: does it coincide with the light word
  once the heavy character stands before its own?

Coinciding terminals, joined by the merged word, are the pairs at one edit, each found once; no word is spread over all
of its edits. The words with a common wildcard differ in that character alone, so a group has at most one word for each
character of the alphabet, and only its size and its two most frequent words are taken. Two prefixes with equal
hashes would share a heavy character, which finds the same pairs.

Counts are made in the JVM with sums before the exchange. Words of any length count whole; a null text has no words, a null doc_id counts as
the empty text. Rows that repeat a doc_id count on their own. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import _compressed
from quire.llm.shared import thrifty, written

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = ""  # the edge of a word that ends at a node
_ANY = "\u0000"  # stands for any one character; no word holds it


def misspelt(run: Column, doc_id: Column, every: int) -> Column:
    """run, without one of its code points where `every` divides the crc32 of doc_id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_chars: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n of the runs of letters in all texts of docs."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))
    rows = docs.select("doc_id", F.explode_outer(runs).alias("run")).where("run is not null")
    lowered = rows.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    words = lowered.where(F.length("run") >= least_chars).select(misspelt(F.col("run"), F.col("doc_id"), every).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _edges(words: DataFrame) -> DataFrame:
    """wid, place (characters before the edge), node (hash of those), next, of every edge on the way of words (wid, word)."""

    @thrifty
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, str]] = []
        for batch in batches:
            for wid, word in zip(batch.column("wid").to_pylist(), batch.column("word").to_pylist(), strict=True):
                h = xxhash.xxh64()
                for place, c in enumerate([*word, _END]):
                    held.append((wid, place, h.intdigest() - (1 << 63), c))
                    h.update(c.encode())
                    if len(held) == 65_536:
                        yield _batch(held)
                        held = []
        if held:
            yield _batch(held)

    return words.select("wid", "word").mapInArrow(walk, "wid long, place int, node long, next string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["wid", "place", "node", "next"])


def light_edges(words: DataFrame) -> DataFrame:
    """wid, place, next, heavy: the light edges on the way of words (wid, word), with the heavy edge of their node.

    A word that ends where longer words go on leaves by a light edge of its own.
    """
    edges = _edges(words).groupBy("node", "next").agg(F.count("*").alias("below"))
    # The end of a word is never heavy: longer words are looked for from there.
    order = F.struct(F.col("next") != _END, "below", "next")
    nodes = edges.groupBy("node").agg(F.max_by("next", order).alias("heavy"), F.count("*").alias("edges")).where("edges > 1")
    light = written(edges.join(nodes, "node").where("next <> heavy").select("node", "next", "heavy"), "light-edges")
    return _edges(words).join(light, ["node", "next"]).select("wid", "place", "next", "heavy")


def _near(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct<minus, form>): words with their near words, summed in parts."""
    light = written(light_edges(words).join(words, "wid"), "light")
    before, after = F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.length("word"))
    own, heavy = F.col("next"), F.col("heavy")
    replaced = F.when(own != _END, F.concat(before, heavy, after))
    skipped = F.when((own != _END) & (F.substring(after, 1, 1) != own), F.concat(before, after))
    inserted = F.concat(before, heavy, own, after)
    merged = light.select("word", "n", F.explode(F.filter(F.array(replaced, skipped, inserted), lambda x: x.isNotNull())).alias("other"))
    pairs = written(merged.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other"), "pairs")
    told = lambda n, w: F.struct((-n).alias("minus"), w.alias("form"))
    there = pairs.select("word", F.lit(1).cast("long").alias("k"), told(F.col("other_n"), F.col("other")).alias("best"))
    back = pairs.select(F.col("other").alias("word"), F.lit(1).cast("long").alias("k"), told(F.col("n"), F.col("word")).alias("best"))
    # Light subtrees of one node that coincide under the wildcard.
    wild = light.where(own != _END).select("word", "n", "place", F.concat(before, F.lit(_ANY), after).alias("merged"))
    group = Window.partitionBy("merged")
    ranked = wild.withColumns({"k": F.count("*").over(group) - 1, "rank": F.row_number().over(group.orderBy(F.desc("n"), "word"))}).where("k > 0")
    first = lambda r: F.max(F.when(F.col("rank") == r, told(F.col("n"), F.col("word")))).over(group)
    among = ranked.withColumns({"one": first(1), "two": first(2)}).select("word", "k", F.when(F.col("rank") == 1, F.col("two")).otherwise(F.col("one")).alias("best"))
    return there.unionByName(back).unionByName(among).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def group_variants(counts: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of counts (word, n), each word once.

    form: the near word of largest n, in code-point order on a tie, if that is at least `times` the word's own; root: the
    last of the forms that follow one another, the word itself if it has none.
    """
    words = written(counts.select("word", F.col("n").cast("long").alias("n"), F.monotonically_increasing_id().alias("wid")), "words")
    form = F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best.form"))
    rows = words.join(_near(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.minus")).alias("form_n"))
    rows = written(rows, "forms")
    roots = _compressed(rows.where("form is not null").select(F.col("word").alias("v"), F.col("form").alias("p")))
    return rows.join(roots.withColumnRenamed("v", "word"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
