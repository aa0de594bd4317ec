"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a byte trie. Each node carries a failure link and the number
of pieces that following it pops, so a word is counted in time linear in its
bytes and no piece is built. The trie's size is bounded by the vocabulary
file, so its arrays are broadcast; texts are read once and nothing shuffles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file (base64 piece, rank per line); read on the driver only."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """Longest-match counter over byte strings; every single byte must be a piece."""

    def __init__(self, pieces: list[bytes]):
        missing = set(range(256)) - {p[0] for p in pieces if len(p) == 1}
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single-byte pieces")
        child: dict[int, int] = {}
        piece = [False]
        self.piece_id = [-1]
        level: list[list[tuple[int, int, int]]] = []
        for rank, word in enumerate(pieces):
            node = 0
            for depth, byte in enumerate(word):
                key = node << 8 | byte
                if (found := child.get(key)) is None:
                    found = child[key] = len(piece)
                    piece.append(False)
                    self.piece_id.append(-1)
                    while len(level) <= depth:
                        level.append([])
                    level[depth].append((node, byte, found))
                node = found
            piece[node] = True
            self.piece_id[node] = rank
        fail, pops = [0] * len(piece), [0] * len(piece)
        for nodes in level:  # breadth first: a link always points to a shallower node
            for parent, byte, node in nodes:
                if piece[node]:
                    pops[node] = 1
                    continue
                at, popped = fail[parent], pops[parent]
                while (child.get(at << 8 | byte)) is None:
                    popped += pops[at]
                    at = fail[at]
                fail[node], pops[node] = child[at << 8 | byte], popped
        rest = list(pops)
        for nodes in level:
            for _, _, node in nodes:
                rest[node] = pops[node] + rest[fail[node]] if fail[node] else pops[node]
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.to = np.fromiter(child.values(), np.int32, len(child))[order]
        self._hashed()
        self.piece_id = np.array(self.piece_id, np.int32)
        self.root = np.array([child[byte] for byte in range(256)], np.int32)
        self.fail, self.pops, self.rest = (np.array(x, np.int32) for x in (fail, pops, rest))

    def _hashed(self) -> None:
        """Edges in a table by hash, at most one a slot; those that met another edge there stay in a sorted list."""
        self.bits = max(4, int(len(self.keys) * 4).bit_length())
        slot = self._slot(self.keys)
        self.slot_key, self.slot_to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.slot_key[slot[::-1]], self.slot_to[slot[::-1]] = self.keys[::-1], self.to[::-1]
        rest = self.slot_key[slot] != self.keys
        self.rest_keys, self.rest_to = np.append(self.keys[rest], np.iinfo(np.int64).max), np.append(self.to[rest], 0)
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slot[rest]] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each state has an edge for its byte, and where it leads."""
        key = state.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        hit, to = self.slot_key[slot] == key, self.slot_to[slot]
        if len(todo := np.flatnonzero(~hit & self.crowded[slot])):
            at = np.searchsorted(self.rest_keys, key[todo])
            hit[todo], to[todo] = self.rest_keys[at] == key[todo], self.rest_to[at]
        return hit, to

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: int = 32) -> np.ndarray:
        """Pieces of each span, read with the byte ``lead`` (a space) before it."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        live = len(order)
        for at in range(-1, int(size[0]) if live else 0):
            live = int(np.searchsorted(-size, -at, "left")) if at >= 0 else live
            byte = data[start[:live] + at].astype(np.int64) if at >= 0 else np.full(live, lead, np.int64)
            todo = np.arange(live)
            while len(todo):
                hit, to = self._step(state[todo], byte[todo])
                state[todo[hit]] = to[hit]
                todo = todo[~hit]
                total[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        total += self.rest[state]
        out = np.empty_like(total)
        out[order] = total
        return out

    def pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match piece ids of each span with the byte ``lead`` before it, and the offsets of each span's."""
        owner, ids = [], []
        at, todo = start.copy(), np.arange(len(start))
        first = True
        while len(todo):
            cursor, stop = at[todo], end[todo]
            # the first step is from the root, where every byte has an edge that is a piece
            if first:
                state = np.full(len(todo), self.root[lead], np.int32)
            else:
                state = self.root[data[cursor]]
                cursor += 1
            first = False
            best, after = self.piece_id[state], cursor.copy()
            live = np.flatnonzero(cursor < stop)
            state, cursor, stop = state[live], cursor[live], stop[live]
            while len(live):
                hit, to = self._step(state, data[cursor])
                go = np.flatnonzero(hit)
                live, state, cursor, stop = live[go], to[go], cursor[go] + 1, stop[go]
                found = self.piece_id[state]
                good = np.flatnonzero(found >= 0)
                best[live[good]], after[live[good]] = found[good], cursor[good]
                go = np.flatnonzero(cursor < stop)
                if len(go) < len(live):
                    live, state, cursor, stop = live[go], state[go], cursor[go], stop[go]
            owner.append(todo)
            ids.append(best)
            at[todo] = after
            todo = todo[after < end[todo]]
        if not owner:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        whose, flat = np.concatenate(owner), np.concatenate(ids)
        order = np.argsort(whose, kind="stable")
        return flat[order], np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(start)))))


def token_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and greedy word pieces of every whole text.

    Returns ``id_col``, n_words, n_tokens (long), one row per input row, repeated
    rows included. A null or empty text, or one of white space only, has 0 and 0.
    Other columns of ``docs`` are ignored, whatever their names; null ids stay null.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Automaton(vocabulary))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text"):
                words = textkit.Words(data, offsets)
                h = textkit.span_hashes(data, words.start, words.end)
                _, once, back = np.unique(h, return_index=True, return_inverse=True)
                pieces = automaton.count(data, words.start[once], words.end[once])[back]
                sums = np.concatenate(([0], np.cumsum(pieces)))
                n = np.diff(words.first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sums[words.first[1:]] - sums[words.first[:-1]], pa.int64())], ["id", "n_words", "n_tokens"])

    out = rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
