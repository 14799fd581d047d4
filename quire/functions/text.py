"""Cleaning, splitting and small checks of texts, as Column expressions, and as functions of a string for tasks."""

from __future__ import annotations

import ctypes
import gc
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import fixed

WORD = r"[\p{L}\p{N}_]"
SPACE = " \t\n\x0b\f\r"  # what \s is in Spark's patterns; Python's \w is WORD


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Have Spark hand Python at most so many bytes at once, so that a worker's memory doesn't follow the number and length of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).lower().removesuffix("b")) > most:
        spark.conf.set(key, str(most))


def give_back() -> None:
    """Return what this process's allocators hold unused: Spark keeps its Python workers from one task to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def some_rows(*columns: pa.Array, at_once: int = 64) -> Iterator[tuple]:
    """The rows of a batch's columns, of which only a few are Python's at a time."""
    for k in range(0, len(columns[0]), at_once):
        yield from zip(*(c.slice(k, at_once).to_pylist() for c in columns), strict=True)


#: Ranges of characters that NFC leaves alone and that never join what stands before them; every text of them alone is in NFC.
NORMAL = r"\x00-\u02FF\u0400-\u0482\u048A-\u0590\u2002-\u20CF\u2100-\u2125\u2190-\u2328\u232B-\u2ADB\u3000-\u3029\u3041-\u3098\u30A0-\u312F\u4E00-\u9FFF\uAC00-\uD7A3\uFB00-\uFB06\uFF00-\uFFEF"


#: A character outside all of these. Each range is asked by itself, so that a character is told by the first one that holds it; one class
#: of them all asks every range of every character.
NOT_NORMAL = "(?s)" + "".join(f"(?![{r}])" for r in re.findall(r"\\\S{1,5}?-\\u....", NORMAL)) + "."


@F.arrow_udf(T.StringType())
def _nfc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    try:
        for part in parts:
            yield pa.array((None if t is None else unicodedata.normalize("NFC", t) for (t,) in some_rows(part)), pa.string())
    finally:
        give_back()


def nfc(t: Column) -> Column:
    """Unicode NFC, for which Spark has no function; texts that plainly are in it aren't handed to Python."""
    return F.coalesce(_nfc(F.when(t.rlike(NOT_NORMAL), t)), t)


def strip(t: Column) -> Column:
    return F.btrim(t, F.lit(" \t\n\x0b\f\r"))


def plain_characters(t: Column) -> Column:
    """Ligatures, curly quotes and dashes written plainly; soft hyphens go."""
    for one, plain in itertools.zip_longest(fixed.QUOTES, fixed.PLAIN_QUOTES, fillvalue=""):
        t = F.replace(t, F.lit(one), F.lit(plain))
    for one, more in fixed.LIGATURES:
        t = F.replace(t, F.lit(one), F.lit(more))
    return t


def printable(t: Column) -> Column:
    return F.regexp_replace(t, r"[\p{C}\p{Z}&&[^ \n\t]]", "")


def join_hyphens(t: Column) -> Column:
    return F.regexp_replace(t, rf"({WORD})-\n({WORD})", "$1$2")


def drop_page_lines(t: Column) -> Column:
    """Running heads and feet become empty lines; lone page numbers go with the blank lines around them."""
    t = F.regexp_replace(t, f"(?imud){fixed.RUNNING_LINE}", "")
    return F.regexp_replace(t, f"(?md){fixed.PAGE_NUMBER_LINE}", "")


def tidy_lines(t: Column, aggressive: bool = False) -> Column:
    """Blanks as one space, none at the ends of lines, at most one empty line in a row. aggressive: no line of under three characters."""
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]{2,}|\t", " "), " \n ?|\n ", "\n")
    if aggressive:
        t = F.array_join(F.filter(F.split(F.trim(t), "\n"), lambda x: F.length(x) > 2), "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def clean_text(t: Column, normalise: bool = True, aggressive: bool = False) -> Column:
    """All of the cleaning, in its order; null or blank gives the empty text. normalise: NFC too, and all of it by `cleaned` in a Python stage, which takes far less than Spark's patterns."""
    if normalise:
        return _cleaner(False, aggressive)(t)
    return tidy_lines(drop_page_lines(join_hyphens(printable(plain_characters(F.coalesce(t, F.lit("")))))), aggressive)


# -- the same of a Python string, for tasks that hold the text anyway --

_PLAIN = [*itertools.zip_longest(fixed.QUOTES, fixed.PLAIN_QUOTES, fillvalue=""), *fixed.LIGATURES]
_RUNNING = re.compile(fixed.RUNNING_LINE.replace(r"\s", f"[{SPACE}]"), re.IGNORECASE | re.MULTILINE)
_RUNNING_WORDS = ("page", "doi:", "©", "all rights reserved")  # a running line has one of them
_ODD_CASE = re.compile("[ſıİ]")  # letters that are s or i where case doesn't count, but not in lower case
_PAGE_NUMBER = re.compile(fixed.PAGE_NUMBER_LINE.replace(r"\s", f"[{SPACE}]"), re.MULTILINE)
_BLANKS, _SPACES, _EMPTY_LINES = re.compile("[ \t]{2,}|\t"), re.compile(f"[{SPACE}]*"), re.compile("\n{3,}")
_REFERENCES = re.compile(fixed.REFERENCES_LINE, re.IGNORECASE | re.ASCII)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _joined_hyphens(t: str) -> str:
    out, done, free, at = [], 0, 0, t.find("-\n")  # free: where the last match ends, as a letter joins one hyphen only
    while at >= 0:
        if at > free and _is_word(t[at - 1]) and _is_word(t[at + 2 : at + 3]):
            out.append(t[done:at])
            done, free = at + 2, at + 3
        at = t.find("-\n", at + 2)
    return "".join([*out, t[done:]])


def _without_running_lines(t: str) -> str:
    if _ODD_CASE.search(t):
        return _RUNNING.sub("", t)
    low, starts = t.lower(), set()
    for word in _RUNNING_WORDS:
        at = low.find(word)
        while at >= 0:
            starts.add(low.rfind("\n", 0, at) + 1)
            end = low.find("\n", at)
            at = low.find(word, end) if end >= 0 else -1
    out, done = [], 0
    for start in sorted(starts):
        hit = _RUNNING.match(t, start) if start >= done else None
        if hit:
            out.append(t[done:start])
            done = hit.end()
    return "".join([*out, t[done:]])


def _without_page_numbers(t: str) -> str:
    out, done, at = [], 0, 0
    while True:
        hit = _PAGE_NUMBER.match(t, at)
        if hit:
            out.append(t[done:at])
            done = hit.end()
        # No line that begins among these blanks has another outcome.
        at = t.find("\n", hit.end() if hit else _SPACES.match(t, at).end()) + 1
        if not at:
            return "".join([*out, t[done:]])


def cleaned(t: str | None, aggressive: bool = False) -> str:
    t = t or ""
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
        for one, plain in _PLAIN:
            t = t.replace(one, plain)
    if not t.replace("\n", "").replace("\t", "").isprintable():
        t = "".join(c for c in t if c.isprintable() or c in "\n\t")
    t = _without_page_numbers(_without_running_lines(_joined_hyphens(t)))
    if "\t" in t or "  " in t:
        t = _BLANKS.sub(" ", t)
    t = t.replace(" \n", "\n").replace("\n ", "\n")
    if aggressive:
        t = "\n".join(x for x in t.strip(" ").split("\n") if len(x) > 2)
    return _EMPTY_LINES.sub("\n\n", t).strip(SPACE)


def before_references(t: str) -> str:
    hit = _REFERENCES.search(t)
    return t[: hit.start()].strip(SPACE) if hit else t


def _cleaner(cut: bool, aggressive: bool = False):
    @F.arrow_udf(T.StringType())
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found = (cleaned(t, aggressive) for (t,) in some_rows(part))
            yield pa.array(map(before_references, found) if cut else found, pa.string())

    return clean


_ENDS = re.compile(f"[{SPACE}](?<=[.!?][{SPACE}])[{SPACE}]*")
_PUNCTUATION, _UNSPACED, _TERMS, _WORDS = re.compile(r"[!-/:-@\[-^`{-~_]+"), re.compile(f"[^{SPACE}]+"), re.compile(r"\w{2,}"), re.compile(r"\w+")
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # what str.split takes for space besides SPACE
_STOP = frozenset(fixed.STOP_WORDS)
# For texts of ASCII alone, where translate is quick: punctuation goes, or whatever is no word character becomes a space.
_NO_PUNCTUATION = {k: None for k in range(33, 127) if not chr(k).isalnum()}
_WORDS_ONLY = {k: " " for k in range(128) if not _is_word(chr(k))}


def sentence_list(t: str, longer_than: int = 10) -> list[str]:
    """As `sentences`."""
    return [s for s in (x.strip(SPACE) for x in _ENDS.split(t)) if len(s) > longer_than]


def _unpunctuated(s: str) -> list[str]:
    s = s.lower()
    s = s.translate(_NO_PUNCTUATION) if s.isascii() else _PUNCTUATION.sub("", s)
    return _UNSPACED.findall(s) if _OTHER_SPACE.search(s) else s.split()


def content_terms(s: str) -> list[str]:
    """The terms, of two word characters or more, of the `content_words` of a sentence."""
    out = []
    for w in _unpunctuated(s):
        if len(w) > 2 and w not in _STOP:
            if w.isalnum():
                out.append(w)
            else:
                out += _TERMS.findall(w)
    return out


def all_words(s: str) -> list[str]:
    """The words of a text in lower case, as they come."""
    s = s.lower()
    return s.translate(_WORDS_ONLY).split() if s.isascii() else _WORDS.findall(s)


def plain_terms(s: str) -> list[str]:
    """The words of two characters or more of a sentence but stop words, punctuation standing between words."""
    s = s.lower()
    if s.isascii():
        return [w for w in s.translate(_WORDS_ONLY).split() if len(w) > 1 and w not in _STOP]
    return [w for w in _TERMS.findall(s) if w not in _STOP]


def without_references(t: Column) -> Column:
    """The text before the first references heading that stands between lines."""
    at = F.regexp_instr(t, F.lit(f"(?i){fixed.REFERENCES_LINE}"))
    return F.when(at > 0, strip(F.substring(t, F.lit(1), at - 1))).otherwise(t)


def one_spaced(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def truncated(t: Column, most: int) -> Column:
    """At most so many characters, the last partial word dropped, then three dots."""
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*\z", ""), F.lit("...")))


def safe_file_name(t: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_.\-]", "_"), r"^[.\-]+", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "uploaded_file").otherwise(name)


def with_clean_text(docs, column: str = "full_text", normalise: bool = True):
    """docs with `clean_text`, up to the references. The cleaned text is a column first, as three expressions read it."""
    if normalise:
        small_batches(docs.sparkSession)
        return docs.withColumn("clean_text", _cleaner(True)(F.col(column)))
    whole = docs.withColumn("_whole", clean_text(F.col(column), normalise))
    return whole.withColumn("clean_text", without_references(F.col("_whole"))).drop("_whole")


def new_document_key() -> Column:
    """A random UUID for each row; it differs from run to run, so write it before it is used twice."""
    return F.uuid()


def document_key(t: Column) -> Column:
    """A UUID in lower case; null for anything else."""
    t = F.lower(t)
    return F.when(t.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), t)


def sentences(t: Column, longer_than: int = 10) -> Column:
    """Parts that end in . ! or ?, stripped, longer than so many characters."""
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > longer_than)


def content_words(s: Column) -> Column:
    """Lower-cased words of over two characters without ASCII punctuation and stop words, joined by spaces."""
    plain = F.translate(F.lower(s), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(fixed.STOP_WORDS)), " ")


def word_set(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(f"{WORD}+"), F.lit(0)))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))
