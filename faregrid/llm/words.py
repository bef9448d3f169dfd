"""Words of whole texts, found and hashed in numpy on Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D. Texts are worked on a
megabyte or so at a time, so memory follows one long text at most, never a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        size = max(n + 1, CHUNK_BYTES + 1)
        made = []
        for base in (_BASE, np.uint64(inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of consecutive rows: byte spans, hashes and the words before each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # word index at which each row begins, plus the total
    sums: np.ndarray  # hashed bytes before each byte

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes from a to b; the upper bits are the good ones."""
        return (self.sums[b] - self.sums[a]) * _tables(len(self.data))[1][a]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only valid where the row has k more."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = self.hash[:n].copy()
        for j in range(1, k):
            out *= _STEP
            out += self.hash[j : j + n]
        return mixed(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offset of each row; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or one longer row."""
    row, rows = 0, len(at) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        to = min(to, row + 4096)
        yield row, to
        row = to


def words_of(data: np.ndarray, at: np.ndarray, lower: bool = False, letters: bool = False) -> Words:
    """Words of the rows that begin at ``at`` (one more entry than rows) in ``data``.

    With ``letters``, words are runs of ASCII letters and digits and of bytes above ASCII.
    """
    n = len(data)
    if lower:
        data = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
    inside = _LETTERS[data] if letters else ((data - np.uint8(9)) >= 5) & (data != 32)
    fresh = np.empty(n + 1, bool)
    fresh[:n] = ~inside
    fresh[n] = True
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    before = np.empty(n, bool)
    if n:
        before[0] = True
        before[1:] = fresh[: n - 1]
    start = np.flatnonzero(inside & (before | begins[:n]))
    end = np.flatnonzero(inside & (fresh[1:] | begins[1:])) + 1
    up, down = _tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * down[start])
    return Words(data, start, end, hashes, np.searchsorted(start, at), sums)


def scan(texts: pa.Array, lower: bool = False, letters: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Row range and words, piece by piece."""
    data, at = buffers(texts)
    for row, to in pieces(at):
        yield row, to, words_of(data[at[row] : at[to]], at[row : to + 1] - at[row], lower, letters)
