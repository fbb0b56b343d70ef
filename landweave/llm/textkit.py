"""Vectorised words and word hashes over Arrow string columns.

Everything here works on the UTF-8 bytes of many documents at once, a few megabytes at a time, so
that a task's memory does not depend on the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20

_rng = np.random.default_rng(20240229)
#: Random odd multipliers by position in a word (past 4096 bytes others are made of them) and random byte values, for two independent hashes.
_POW = _rng.integers(1, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
_GRAM = _rng.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Byte tables: 0 for a separator, else the byte that counts.
SPACE_WORDS = np.arange(256, dtype=np.uint8)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = 0
#: A NUL byte is part of a word too; it counts as byte 255, which UTF-8 never has.
SPACE_WORDS[0] = 255
LOWER_ALNUM = _lower.copy()
LOWER_ALNUM[[i for i in range(128) if not chr(i).isalnum()]] = 0


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK):
    """Yield (first row, bytes, offsets) for runs of rows of about ``most`` bytes; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a run of documents: byte spans, and ``first[i]:first[i + 1]`` for document i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE_WORDS):
        self.buf, self.table, n = buf, table, len(buf)
        self._as = table[buf]
        m = self._as != 0
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = m[:-1], m[1:]
            before[offsets[:-1][offsets[:-1] < n]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(m & ~before)
        self.ends = np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._m = m

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
        times = _POW[which][pos & 4095]
        if lens.max() > 4096:
            times = np.where(pos < 4096, times, _mix(times + (pos >> 12).astype(np.uint64)) | np.uint64(1))
        h = np.add.reduceat(_BYTE[which][self._as[self._m]] * times, at)
        return _mix(h + lens.astype(np.uint64))


def grams(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions are missing."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = h[:size] * _GRAM[which][0]
    for j in range(1, n):
        out += h[j : j + size] * _GRAM[which][j]
    return _mix(out)


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Positions from which n words lie in one document."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    at = np.cumsum(counts) - counts
    return np.repeat(first[:-1] - at, counts) + np.arange(int(counts.sum()))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
