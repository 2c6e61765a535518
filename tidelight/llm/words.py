"""Words of whole texts as numpy arrays, cut from Arrow buffers without a Python object per word.

A batch is worked through in slices of about ``SLICE`` bytes (one text at least), so memory follows
the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: White space of a word: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2^64
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


@dataclass
class Texts:
    """Some texts back to back. ``offsets`` has one entry more than there are texts."""

    raw: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefix(self, lower: bool = True) -> np.ndarray:
        """Running polynomial sums; ``span`` turns them into hashes of byte ranges."""
        data = LOWER[self.raw] if lower else self.raw
        up, _ = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
        return sums

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte past the end and text number of each word."""
        inside = ~SPACE[self.raw]
        n = len(inside)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | first[:n]))
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal ranges, equal hashes."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def slices(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """(number of the first row, texts) of an Arrow string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, Texts(raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def hashed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the bounds of the texts among them."""
    starts, ends, owner = texts.words()
    return span(texts.prefix(), starts, ends), np.searchsorted(owner, np.arange(len(texts) + 1))


def shingles(words: np.ndarray, bounds: np.ndarray, size: int, score: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct hashes of its runs of ``size`` words, and the sum of ``score`` over their words.

    A text of fewer words gives its whole sequence as one; a text without words gives none.
    """
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    score = np.zeros(len(words), np.int16) if score is None else score
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    sums = np.zeros(len(runs), np.int16)
    for k in range(size):
        runs += mix(words[k : k + len(runs)] * weights[k])
        sums += score[k : k + len(runs)]
    runs = mix(runs + np.uint64(size))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            found, first = np.unique(runs[a : b - size + 1], return_index=True)
            yield found, sums[a + first]
        elif b > a:
            yield mix(mix(words[a:b] * weights[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)), score[a:b].sum(keepdims=True, dtype=np.int16)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int16)
