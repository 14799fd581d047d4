"""Hashed character n-grams of whole texts, made with NumPy over blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BLOCK = 1 << 18  # characters handled at once; longer texts are cut into pieces that overlap by an n-gram less one
_MULTIPLIER, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def blocks(texts: Sequence[str | None], longest: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, row of each, characters left in the piece from each) of lower-cased texts.

    A text is framed by one space on either side, so that n-grams see its ends. Each n-gram of a text that is cut
    starts in one piece only.
    """
    rows: list[int] = []
    parts: list[str] = []
    starts: list[int] = []
    total = 0
    for row, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        for at in range(0, len(text), block):
            part = text[at : at + block + longest - 1]
            rows.append(row)
            parts.append(part)
            starts.append(min(block, len(part)))
            total += len(part)
            if total >= block:
                yield _block(rows, parts, starts)
                rows, parts, starts, total = [], [], [], 0
    if parts:
        yield _block(rows, parts, starts)


def _block(rows: list[int], parts: list[str], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    own = np.repeat(ends - lengths + np.array(starts), lengths) > np.arange(len(codes))
    return codes, np.repeat(np.array(rows, np.int64), lengths), np.where(own, left, 0)


def hashed(codes: np.ndarray, left: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each n-gram starts, and its hash of so many bits."""
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = len(codes) - n + 1
    h = np.full(width, n, np.uint64)
    for k in range(n):
        h *= _MULTIPLIER
        h += codes[k : k + width]
    h ^= h >> np.uint64(31)
    h *= _FINISH
    at = np.flatnonzero(left[:width] >= n)
    return at, (h[at] >> np.uint64(64 - bits)).astype(np.int64)
