"""Vectorised text helpers for Arrow-batched operators.

Texts stay in their Arrow buffers: words, normalised words and their 64-bit
hashes come from whole-buffer numpy passes, without a Python string per word.
A word is a maximal run of bytes other than the six ASCII white-space bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCT = np.zeros(256, bool)
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def latin_lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals in lower case; lengths stay."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _RADIX, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW = _powers(1 << 12)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``limit`` text bytes; a null text is empty.

    Yields the sub-batch, its UTF-8 bytes and the row offsets into them.
    """
    text = batch.column(batch.schema.get_field_index(column))
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    if n == 0:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1 + text.offset)[text.offset :]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a run of texts: byte spans ``start``/``end``, and ``first[i]:first[i+1]`` for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
            before |= edge[:n]
            after |= edge[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def core(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans without leading and trailing ASCII punctuation; they may be empty."""
        s, e = self.start.copy(), self.end.copy()
        todo = np.arange(len(s))
        while len(todo := todo[(s[todo] < e[todo])]) and len(todo := todo[PUNCT[self.data[s[todo]]]]):
            s[todo] += 1
        todo = np.arange(len(s))
        while len(todo := todo[(s[todo] < e[todo])]) and len(todo := todo[PUNCT[self.data[e[todo] - 1]]]):
            e[todo] -= 1
        return s, e


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; 0 marks an empty one. Ascending disjoint spans."""
    global _POW
    size = end - start
    out = np.zeros(len(start), np.uint64)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    size, start = size[full], start[full]
    if (most := int(size.max())) > len(_POW):
        _POW = _powers(2 * most)
    cut = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(cut, size)
    byte = data[within + np.repeat(start, size)]
    with np.errstate(over="ignore"):
        value = _BYTE[LOWER[byte] if lower else byte] * _POW[within]
        out[full] = mix(np.add.reduceat(value, cut) + size.astype(np.uint64) * _RADIX)
    return out


_UNPOW = np.multiply.accumulate(np.full(len(_POW), pow(int(_RADIX), -1, 1 << 64), np.uint64)) * _RADIX


def word_hashes(words: Words, limit: int = 4 << 20) -> np.ndarray:
    """``span_hashes`` of all words, from running sums over the whole buffer; of one above ``limit`` bytes, from the spans."""
    global _POW, _UNPOW
    n = len(words.data)
    if n > limit:
        return span_hashes(words.data, words.start, words.end)
    with np.errstate(over="ignore"):
        if n > min(len(_POW), len(_UNPOW)):
            _POW = _powers(max(2 * n, len(_POW)))
            _UNPOW = np.multiply.accumulate(np.full(len(_POW), pow(int(_RADIX), -1, 1 << 64), np.uint64)) * _RADIX
        sums = np.zeros(n + 1, np.uint64)
        value = _BYTE[words.data]
        value *= _POW[:n]
        np.cumsum(value, out=sums[1:])
        # powers count from the buffer's start; the inverse one counts them from the word's
        return mix((sums[words.end] - sums[words.start]) * _UNPOW[words.start] + (words.end - words.start).astype(np.uint64) * _RADIX)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; a shorter text is one window, none if empty."""
    k = min(k, len(h))
    if k == 0:
        return h
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for i in range(k):
            acc = (acc * np.uint64(0x100000001B3)) + h[i : i + n]
        return mix(acc + np.uint64(k))


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the lower-case hashes of the first bytes of the spans longer than it, and which spans they are."""
    size, at = end - start, np.arange(len(start))
    acc = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(max(sizes)):
            keep = size[at] > i + 1 if i + 1 in sizes else size[at] > i
            at, acc = at[keep], acc[keep]
            acc = acc + _BYTE[LOWER[data[start[at] + i]]] * _POW[i]
            if i + 1 in sizes:
                yield mix(acc ^ np.uint64(0xABCD * (i + 1))), at
