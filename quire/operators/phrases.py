"""Key phrases by the statistics of their words in one document (Campos et al., 2020): casing, place, frequency, neighbours.

Texts are dealt by document once; words are cut and counted in the task that has their text, whole, as arrays of numbers, so neither words nor phrases
are exchanged or sorted. Each of several texts with one doc_id counts as a document of its own, equal rows count once; a null or blank text has no phrase.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import fixed, text

_DOC = ["doc_id", "_row"]
_BLOCK_END, _WORDS = re.compile(fixed.BLOCK_END.replace(r"\p{L}\p{N}_\s", rf"\w{text.SPACE}")), re.compile(r"\w+")
_NUMBER, _STOP, _WORD = range(3)
_STOP_WORDS = frozenset(fixed.STOP_WORDS)
_NONE = np.empty(0, np.int64)


@functools.lru_cache(1 << 16)
def _form(w: str) -> tuple[str, int, bool, bool]:
    """The term of a word, its kind (a number has no letter, a stop word may be any under three characters), whether it begins with a capital, and whether it is all capitals."""
    term = w.lower()
    kind = _NUMBER if not any(map(str.isalpha, w)) else _STOP if len(term) < 3 or term in _STOP_WORDS else _WORD
    return term, kind, unicodedata.category(w[0]) == "Lu", len(w) > 1 and w != term and w == w.upper()


class Phrases:
    """All runs of up to three words in a block of a text, each run once: its terms (less than 0: none) and its score; lower is better.

    Punctuation other than hyphens and apostrophes ends a block. A run begins and ends with a word; a stop word in the middle counts by how firmly it
    is bound to its neighbours; a number ends a run.
    """

    def __init__(self, t: str | None):
        self.terms, self.runs, self.score = [], np.empty((0, 3), np.int64), np.empty(0)
        words, sizes, sents, firsts = [], [], [], []
        for k, s in enumerate(text.sentence_list(t or "", 0)):
            for j, b in enumerate(_BLOCK_END.split(s)):
                found = _WORDS.findall(b)
                if found:
                    if not j:
                        firsts.append(len(words))
                    words += found
                    sizes.append(len(found))
                    sents.append(k)
        if not words:
            return
        forms = {w: k for k, w in enumerate(dict.fromkeys(words))}
        lower, kind, upper, acronym = zip(*map(_form, forms), strict=True)
        self.terms = [*dict.fromkeys(lower)]
        code, n = {x: k for k, x in enumerate(self.terms)}, len(self.terms)
        form = np.fromiter(map(forms.__getitem__, words), np.int64, len(words))
        upper, acronym = np.array(upper)[form], np.array(acronym)[form]
        upper[firsts] = False
        coded = np.fromiter(map(code.__getitem__, lower), np.int64, len(forms))
        term, kinds = coded[form], np.empty(n, np.int64)
        kinds[coded] = kind
        tf = np.bincount(term, minlength=n)
        if not (kinds == _WORD).any():
            return
        block, sent = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.array(sents), sizes)
        one = np.flatnonzero(block[1:] == block[:-1])
        pairs, follows = np.unique(term[one] * n + term[one + 1], return_counts=True)
        weight = self._weights(term, sent, tf, kinds, upper, acronym, pairs, one)
        kind = kinds[term]
        alone = np.flatnonzero(kinds == _WORD)
        two = np.unique((term[one] * n + term[one + 1])[(kind[one] == _WORD) & (kind[one + 1] == _WORD)])
        three = one[:-1][one[1:] == one[:-1] + 1] if len(one) else _NONE
        three = three[(kind[three] == _WORD) & (kind[three + 1] != _NUMBER) & (kind[three + 2] == _WORD)]
        three, thrice = np.unique((term[three] * n + term[three + 1]) * n + term[three + 2], return_counts=True)
        a, b, c = three // n // n, three // n % n, three % n
        many = lambda x, y: follows[np.searchsorted(pairs, x * n + y)]
        bound = (many(a, b) / tf[a]) * (many(b, c) / tf[b])
        bound_to = kinds[b] == _STOP
        score3 = weight[a] * np.where(bound_to, 2.0 - bound, weight[b]) * weight[c] / (thrice * (1.0 + weight[a] + np.where(bound_to, bound - 1.0, weight[b]) + weight[c]))
        x, y = two // n, two % n
        score2 = weight[x] * weight[y] / (many(x, y) * (1.0 + weight[x] + weight[y]))
        score1 = weight[alone] / (tf[alone] * (1.0 + weight[alone]))
        no = lambda k: np.full(k, -1)
        self.runs = np.concatenate([np.stack(r, axis=1) for r in ((alone, no(len(alone)), no(len(alone))), (x, y, no(len(x))), (a, b, c))])
        self.score = np.concatenate([score1, score2, score3])

    @staticmethod
    def _weights(term, sent, tf, kinds, upper, acronym, pairs, one) -> np.ndarray:
        """The weight of each term (lower is better)."""
        n, of = len(tf), tf[kinds == _WORD]
        share = lambda distinct, met: np.bincount(distinct, minlength=n) / np.maximum(np.bincount(met, minlength=n), 1)
        rel = 1.0 + (share(pairs % n, term[one + 1]) + share(pairs // n, term[one])) * tf / tf.max()
        places = sent[np.argsort(term, kind="stable")]
        start = np.cumsum(tf) - tf
        middle = (places[start + (tf - 1) // 2] + places[start + tf // 2]) / 2
        sents = int(sent[-1]) + 1
        in_sents = np.bincount(np.unique(term * sents + sent) // sents, minlength=n)
        case = np.maximum(np.bincount(term, upper, n), np.bincount(term, acronym, n)) / (1.0 + np.log(tf))
        return rel * np.log(np.log(3.0 + middle)) / (case + (tf / (of.mean() + of.std())) / rel + (in_sents / sents) / rel)

    def names(self, some=slice(None)) -> pa.Array:
        """The phrases of these runs."""
        terms, runs = pa.array(self.terms, pa.string()), self.runs[some]
        parts = [pc.take(terms, pa.array(r, mask=r < 0)) for r in runs.T]
        return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def _by_text(docs: DataFrame, column: str, found: Callable[[str | None], list[pa.Array]], columns: str) -> DataFrame:
    """doc_id, _row (a hash of the text) and what is found in each distinct text: lists of equal length."""
    text.small_batches(docs.sparkSession)
    # By number: a few MB of text become many words, so partitions sized by their bytes would be too few.
    dealt = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.xxhash64(column).alias("_row"), F.col(column).alias("_text")).repartition(dealt, *_DOC).dropDuplicates(_DOC)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                lists = [found(t.as_py()) for t in part.column("_text")]
                own = part.select(_DOC).take(pa.array(np.repeat(np.arange(len(part)), [len(x[0]) for x in lists])))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.concat_arrays(c) for c in zip(*lists, strict=True))], names=names)

    kind = T.StructType([docs.schema["doc_id"], T.StructField("_row", T.LongType()), *T._parse_datatype_string(columns)])
    names = kind.names
    return rows.mapInArrow(each, kind)


def phrase_scores(docs: DataFrame, column: str = "clean_text") -> DataFrame:
    """doc_id, _row, phrase, n, score: the Phrases of every text, whole."""

    def found(t: str | None) -> list[pa.Array]:
        own = Phrases(t)
        return [own.names(), pa.array((own.runs >= 0).sum(axis=1), pa.int32()), pa.array(own.score, pa.float64())]

    return _by_text(docs, column, found, "phrase string, n int, score double")


def edits(a: str, b: str) -> int:
    """The edit distance, a column of the table at a time as the bits of whole numbers (Myers, 1999; Hyyrö, 2003)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    every, last, n = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for c in b:
        here = at.get(c, 0)
        same = (((here & up) + up) ^ up) | here | down
        more, less = down | ~(same | up) & every, up & same
        n += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | ~(same | more) & every, more & same
    return n


def _marks(s: str) -> int:
    out = 0
    for c in s:
        out |= 1 << (ord(c) & 63)
    return out


def _unlike(listed: list[tuple[float, str]], most: int, alike: float) -> list[tuple[float, str]]:
    """The first ones, of which none is more than `alike` one before it."""
    kept: list[tuple[float, str, int, int]] = []
    for score, x in listed:
        n, marks = len(x), _marks(x)
        for _, d, size, own in kept:
            longer = max(n, size)
            # At least so many edits as lengths differ, and as there are characters that the other lacks.
            least = max(abs(n - size), (marks & ~own).bit_count(), (own & ~marks).bit_count())
            if 1.0 - least / longer > alike and 1.0 - edits(d, x) / longer > alike:
                break
        else:
            kept.append((score, x, n, marks))
            if len(kept) == most:
                break
    return [k[:2] for k in kept]


def best_phrases(t: str | None, most: int = 15, alike: float = 0.7, first: int = 100) -> list[tuple[float, str]]:
    """score, phrase: the best phrases of a text that are not alike, ties in order of the alphabet."""
    own, n = Phrases(t), first
    while True:
        # The lowest scores, and those that only rounding tells from them; more if too few of them stay.
        some = np.flatnonzero(own.score <= np.partition(own.score, n - 1)[n - 1] + 1e-11) if n < len(own.score) else np.arange(len(own.score))
        listed = sorted(zip((round(x, 12) for x in own.score[some].tolist()), own.names(some).to_pylist(), strict=True))
        if n < len(own.score):
            listed = [x for x in listed if x[0] <= listed[n - 1][0]]
        best = _unlike(listed, most, alike)
        if len(best) == most or n >= len(own.score):
            return best
        n *= 4


def key_phrases(docs: DataFrame, column: str = "clean_text", most: int = 15, alike: float = 0.7) -> DataFrame:
    """doc_id, rank, phrase, score: the best phrases, ties in order of the alphabet.

    A phrase goes if it is more than `alike` a better one that stays: 1 less the edit distance over the longer length.
    """

    def found(t: str | None) -> list[pa.Array]:
        best = best_phrases(t, most, alike)
        return [pa.array(range(1, len(best) + 1), pa.int32()), pa.array([p for _, p in best], pa.string()), pa.array([x for x, _ in best], pa.float64())]

    return _by_text(docs, column, found, "rank int, phrase string, score double").drop("_row")
