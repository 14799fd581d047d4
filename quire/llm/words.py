"""Splitting text into the words of a byte-level BPE tokenizer, and its tokens for single words."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: The pattern that splits text before the merges, and characters whose class has been the same in
#: every Unicode version of the last years. Texts with other characters are split by the tokenizers library.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
UNUSUAL = regex.compile(r"[^\u0000-ɏ̀-ͷЀ-ԯऄ-हḀ-ἕ - ₠-₿←-⏿─-➿、-〩ぁ-ゖァ-ヺ一-龥가-힣！-～\U0001F300-\U0001F5FF\U0001F600-\U0001F640]")


def digest_of(path: str) -> str:
    """Names the tokenizer's version: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The whole texts' tokenizer; truncation and padding are off."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class ByteLevelWords:
    """Splits texts as a byte-level BPE tokenizer does; a text's tokens are those of its words, one after the other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        pre, added = d.get("pre_tokenizer") or {}, d.get("added_tokens") or []
        plain = d["model"].get("type") == "BPE" and not d["model"].get("dropout") and not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        self.tokenizer = tokenizer(path)
        self.special = {x["content"]: x["id"] for x in added}
        # Longer strings first, as the leftmost longest one counts.
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, text: str | None) -> list[str]:
        """The words, in order; joined they give the text. A special token's string is a word of its own."""
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out.extend([part] if part in self.special else self._ordinary(part))
        return out

    def _ordinary(self, text: str) -> list[str]:
        if text and not text.isascii() and UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return PATTERN.findall(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevelWords | None:
    """None: the file is of another kind."""
    try:
        return ByteLevelWords(path)
    except ValueError:
        return None
