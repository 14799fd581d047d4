"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import string

import public_tokenizers
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of an input.
CLASHING = ("key", "size", "id", "shard", "slot", "fp", "root", "n", "row", "spans", "items", "guess", "score", "bucket", "chunk", "word")

TEXTS = [
    None,
    "",
    " ",
    "\n\t ",
    "a",
    "A b",
    "one two three four five six seven eight nine ten",
    "One two,  three-four five\nsix seven eight nine TEN eleven",
    "one two three four five six seven eight nine ten",
    "<|endoftext|> and <|endoftext|><|endoftext|>x",
    "it's we'll I'd <|endoftext",
    "naïve Straße façade Ünïcödé 12345 ½²",
    "日本語のテキスト。한국어 텍스트 Привет мир",
    "emoji 👩‍👩‍👧‍👦 🏳️‍🌈 é ​ zero",
    " nbsp　wide  tab\tend ",
    "word " * 30_000,
    "x" * 50_000,
    " ".join(f"w{i % 977}" for i in range(20_000)),
    "!!! ??? ...",
    "½ ² ³",
    "①②",
    "Ⅷ 12 ٣",
    "ªº",
]


def documents(spark, texts, extra=True, langs=None):
    rows = [(i, t, (langs or ["en", "fr", None])[i % 3] if not langs else langs[i], None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    if extra:
        for c in CLASHING:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("clash"))
    return df


def library_ids(texts):
    t = Tokenizer.from_file(BYTE_BPE)
    t.no_truncation()
    t.no_padding()
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def lowered(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def union(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lowered(text))


def contamination(text, items, size=10):
    """n_words, hit words, ids of items."""
    w = words(text)
    hit, found = set(), set()
    where = {}
    for item, t in items:
        own = words(t)
        for k in range(max(1, len(own) - size + 1)) if own else ():
            where.setdefault(tuple(own[k : k + size]), set()).add(str(item))
    lengths = {len(k) for k in where}
    for n in lengths:
        for i in range(len(w) - n + 1):
            if own := where.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                found |= own
    return len(w), len(hit), sorted(found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
