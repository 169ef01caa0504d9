"""Words and word n-grams of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a run of bytes other than space and U+0009 to U+000D. Its hash depends on its bytes alone, so
texts of any length are worked on in slabs of about a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUE = _BYTE_VALUE[_LOWER]
SLAB = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < size:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of several texts: ``doc`` (index of the text), ``start``, ``end`` (bytes) and ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        gap = _SEPARATOR[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = ~gap
        begins[1:] &= gap[:-1] | edge[1:-1]
        ends = ~gap
        ends[:-1] &= gap[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)  # of text i, words first[i] to first[i + 1]
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + SLAB, side="right")))
            piece = data[at : self.end[j - 1]]
            up, down = _tables(max(SLAB, len(piece)) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((_LOWER_VALUE if lower else _BYTE_VALUE)[piece] * up[: len(piece)], out=sums[1:])
            s, e = self.start[i:j] - at, self.end[i:j] - at
            self.hash[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every n-gram that lies in one text."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            value += self.hash[k : total - n + 1 + k] * _STEP[k]
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        return at, mix(value[at])

    def whole(self, i: int) -> np.uint64:
        """Hash of all words of text ``i``, different from that of any n-gram of another length."""
        w = self.hash[self.first[i] : self.first[i + 1]]
        return mix((w * _STEP[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _STEP[63:] * np.uint64([len(w)]))[0]


def slabs(batch: pa.RecordBatch, text: str, most: int = SLAB) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about ``most`` bytes of text: (rows, bytes, offsets)."""
    data, offsets = text_buffer(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct n-grams; a text with fewer words has itself as its only one, an empty text none."""
    at, value = words.ngrams(n)
    cut = np.searchsorted(at, words.first)
    for i in range(len(words.first) - 1):
        count = words.first[i + 1] - words.first[i]
        if count >= n:
            yield np.unique(value[cut[i] : cut[i + 1]])
        else:
            yield np.array([words.whole(i)], np.uint64) if count else np.zeros(0, np.uint64)


def set_id(values: np.ndarray) -> int:
    """Signed 64-bit id of a set of hashes; 0 for the empty set."""
    if not len(values):
        return 0
    spread = mix(values ^ _STEP[62]).sum(dtype=np.uint64, keepdims=True) * _STEP[61] + _STEP[60] * np.uint64([len(values)])
    return int(spread.view(np.int64)[0])
