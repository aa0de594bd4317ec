"""Language-model scores of whole texts by causal self-attention over subword ids.

A text is its words (ASCII lower case) and an end; a word is its subword ids. An attention
model reads all ids of a text in overlapping windows, each id scored once, and so gives a
word's first id, its further ids, and that it ends there. The rest of a word, its first id
given, is interpolated with the word counts of all training texts, by as much as the words
of that first id are many different ones (Witten and Bell).

All training texts are counted: words, ids, and the company of ids, from which the model's
classes are learnt. The model is fitted on all windows of all training texts,
dealt by hash into shards of about ``shard`` windows: one shard gives a start, every shard
refines it in a task of its own, and the results are averaged. So what is gathered and
learnt grows with the corpus, and no result depends on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .attention import AttentionLM, Windows
from .shared import stored
from .token_counts import Automaton

WORDS, IDS, TEXTS, NEAR, TRAIN = range(5)
#: Text bytes handled at once; their arrays take about a hundred times that.
SLICE = 1 << 20
#: Windows of a text that are sent in one row; near ids are up to REACH places away, of the ANCHORS most frequent ids.
RUN, REACH, ANCHORS = 4096, 2, 64
#: Averages are taken of whole multiples of this, so that they don't depend on the order of a sum.
UNIT = 2.0**-32


def held_out(doc_id) -> F.Column:
    """True for the fifth of the ids that nothing is learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


class _Pieces:
    """Piece ids of words, with a bounded memory of the words cut before."""

    def __init__(self, automaton: Automaton, keep: int = 1 << 18):
        self.automaton, self.keep = automaton, keep
        self._clear()

    def _clear(self) -> None:
        self.hash, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def of(self, data: np.ndarray, words: textkit.Words, h: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, start, size): the pieces of the i-th distinct word (hashes ascending) are pool[start[i] : start[i] + size[i]]."""
        if len(self.hash) > self.keep:
            self._clear()
        slot = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        known = self.hash[slot] == h if len(self.hash) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        if len(new):
            ids, at = self.automaton.pieces(data, words.start[once[new]], words.end[once[new]])
            where = np.searchsorted(self.hash, h[new])
            self.hash, self.start, self.size = (np.insert(x, where, y) for x, y in ((self.hash, h[new]), (self.start, at[:-1] + len(self.pool)), (self.size, np.diff(at))))
            self.pool = np.concatenate((self.pool, ids))
            slot = np.searchsorted(self.hash, h)
        return self.pool, self.start[slot], self.size[slot]


class _Text:
    """The ids of a slice of texts: each text's words' pieces between ``begin`` and ``end``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pieces: _Pieces, end: int, flat: bool = True):
        low = textkit.LOWER[data]
        self.words = textkit.Words(low, offsets)
        h = textkit.word_hashes(self.words)
        code, found = pd.factorize(h)
        order = np.argsort(found)
        self.hash, rank = found[order], np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        self.back = rank[code]
        once = np.empty(len(found), np.int64)
        once[self.back[::-1]] = np.arange(len(h) - 1, -1, -1)  # the first of each stays
        pool, start, size = pieces.of(low, self.words, self.hash, once) if len(h) else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.first = pool[start] if len(h) else np.zeros(0, np.int32)
        self.size, self.pool, self.start = size, pool, start
        if not flat:
            return
        per_word = size[self.back]
        total = np.concatenate(([0], np.cumsum(per_word)))
        n = np.diff(total[self.words.first])
        self.offsets = np.concatenate(([0], np.cumsum(n + 2)))
        self.tokens = np.full(self.offsets[-1], end, np.int32)
        self.tokens[self.offsets[:-1]] = end + 1
        #: Place of each word's first id, and the one after its last.
        self.at = total[:-1] + np.repeat(np.arange(1, 2 * len(n), 2), np.diff(self.words.first))
        self.stop = self.at + per_word
        # all words' first ids, then the second ones of those that have one, and so on
        to, of = self.at, start[self.back]
        self.tokens[to] = self.first[self.back]
        more = np.flatnonzero(per_word > 1)
        to, of, left = to[more], of[more], per_word[more]
        while len(to):
            to, of, left = to + 1, of + 1, left - 1
            self.tokens[to] = pool[of]
            if len(more := np.flatnonzero(left > 1)) < len(left):
                to, of, left = to[more], of[more], left[more]


def _rows(kind: int, key: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(np.asarray(key).view(np.int64)), pa.array(np.asarray(first, np.int32)), pa.array(np.asarray(n, np.int64))], ["kind", "key", "first", "n"])


def _counts(texts: DataFrame, shared: Broadcast, ids: int) -> DataFrame:
    """(kind, key, first, n): counts of words by hash, of ids, and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(shared.value)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        known, head, total = none
        by_id, n = np.zeros(ids, np.int64), 0
        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text", SLICE):
                n += part.num_rows
                x = _Text(data, offsets, pieces, ids - 2, flat=False)
                if not len(x.hash):
                    continue
                c = np.bincount(x.back)
                stop = np.cumsum(x.size)
                each = x.pool[np.repeat(x.start - (stop - x.size), x.size) + np.arange(stop[-1])]
                by_id += np.bincount(each, np.repeat(c, x.size), ids).astype(np.int64)
                slot = np.searchsorted(known, x.hash)
                old = known[np.minimum(slot, len(known) - 1)] == x.hash if len(known) else np.zeros(len(x.hash), bool)
                total[slot[old]] += c[old]
                known, head, total = (np.insert(a, slot[~old], b) for a, b in ((known, x.hash[~old]), (head, x.first[~old]), (total, c[~old])))
                if len(known) > 1 << 20:
                    yield _rows(WORDS, known, head, total)
                    known, head, total = none
        yield _rows(WORDS, known, head, total)
        key = np.flatnonzero(by_id)
        yield _rows(IDS, key, np.zeros(len(key)), by_id[key])
        if n:
            yield _rows(TEXTS, np.zeros(1, np.int64), np.zeros(1), np.array([n]))

    out = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, key long, first int, n long")
    return stored(out.groupBy("kind", "key").agg(F.first("first").alias("first"), F.sum("n").alias("n")))


def _gathered(texts: DataFrame, shared: Broadcast, anchors: np.ndarray, ids: int, size: int) -> DataFrame:
    """(kind, key, n, windows): how often ids are near anchors, and all windows, as the ids that up to RUN of them in a row pass.

    The ids are 2 or 4 bytes each, after a byte that says which. Runs alike in key are alike; a task seldom repeats one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, width = _Pieces(shared.value), 2 * len(anchors)
        none, one = ids, np.int32(1)
        packed = np.dtype(np.uint16 if ids < 0xFFFF else np.int32)
        head_of = [bytes([packed.itemsize]) + start for start in (np.full(size, -1).astype(packed).tobytes(), b"")]
        seen: set[int] = set()
        place = np.full(ids + 1, -1, np.int64)
        place[anchors] = np.arange(len(anchors))
        near = np.zeros((ids + 1) * width, np.int32)
        names = ["kind", "key", "n", "windows"]
        held: list[tuple[int, int, bytes]] = []

        def runs(rows: list) -> pa.RecordBatch:
            key, n, ids_ = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([TRAIN] * len(rows), pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(ids_, pa.binary())], names)

        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text", SLICE):
                x = _Text(data, offsets, pieces, ids - 2)
                # texts apart by places that are near nothing
                text = np.arange(len(offsets) - 1)
                spread = np.full(len(x.tokens) + REACH * (len(text) + 1), none, np.int64)
                spread[np.arange(len(x.tokens)) + REACH * (np.repeat(text, np.diff(x.offsets)) + 1)] = x.tokens
                at = np.flatnonzero(place[spread] >= 0)
                column = place[spread[at]]
                for shift in range(1, REACH + 1):
                    for step, side in ((shift, 0), (-shift, len(anchors))):
                        np.add.at(near, spread[at + step] * width + (column + side), one)
                key = part.column(part.schema.get_field_index("key")).to_numpy().view(np.uint64)
                w = Windows(x.offsets, size)
                head = np.flatnonzero(w.which % RUN == 0)
                owner, first, n = w.owner[head], w.which[head], np.diff(np.append(head, len(w)))
                with np.errstate(over="ignore"):
                    name = textkit.mix(key[owner] + (first // RUN).astype(np.uint64)).view(np.int64)
                low = x.offsets[owner] + (first - 1) * size
                high = np.minimum(x.offsets[owner + 1], low + (n + 1) * size + 1)
                low += np.where(first, 0, size)
                token = x.tokens.astype(packed)
                for later, begin, end, key_, n_ in zip((first > 0).tolist(), low.tolist(), high.tolist(), name.tolist(), n.tolist(), strict=True):
                    if key_ not in seen:
                        held.append((key_, n_, head_of[later] + token[begin:end].tobytes()))
                        seen.add(key_)
                if len(seen) > 1 << 18:
                    seen.clear()
                    if len(held) >= 4096:
                        yield runs(held)
                        held = []
        if held:
            yield runs(held)
        key = np.flatnonzero(near[: ids * width])
        for lo in range(0, len(key), 1 << 16):
            some = key[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), NEAR, np.int32)), pa.array(some), pa.array(near[some].astype(np.int64)), pa.nulls(len(some), pa.binary())], names)

    rows = texts.select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "kind int, key long, n long, windows binary"))


def _windows(ids: np.ndarray, n: int, size: int) -> np.ndarray:
    """The ``n`` windows that the ids of a run pass, -1 after its end."""
    whole = np.full((n + 1) * size + 1, -1, np.int32)
    whole[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(whole, 2 * size + 1)[::size]


def _unpacked(ids: bytes) -> np.ndarray:
    if ids[0] == 4:
        return np.frombuffer(ids, np.int32, offset=1)
    out = np.frombuffer(ids, np.uint16, offset=1).astype(np.int32)
    out[out == 0xFFFF] = -1
    return out


def _table(group: pa.Table, size: int) -> np.ndarray:
    """The windows of a shard, each key's once, in an order that is that of their texts' hashes."""
    key = group["key"].to_numpy()
    _, once = np.unique(key, return_index=True)
    n, ids = group["n"].to_numpy(), group["windows"]
    return np.concatenate([_windows(_unpacked(ids[i].as_py()), n[i], size) for i in once.tolist()])


def _fit(gathered: DataFrame, model: AttentionLM, shard: int, steps: int) -> AttentionLM:
    """The model fitted on all windows of ``gathered``: a start from one shard, refined in each and averaged."""
    rows = gathered.filter(F.col("kind") == TRAIN)
    total = rows.select("key", "n").distinct().agg(F.sum("n")).first()[0]
    if not total:
        return model
    shards, size = -(-int(total) // shard), model.size
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "n", "windows")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    lowest = dealt.agg(F.min("shard")).first()[0]

    def start(group: pa.Table) -> pa.Table:
        windows = _table(group, size)
        rng = np.random.Generator(np.random.PCG64(11))
        fitted = AttentionLM.copy(shared.value).fit(windows, rng.integers(0, len(windows), 64 * steps), 4e-3, warm=50)
        return pa.table({"flat": pa.array([fitted.flat().tolist()], pa.list_(pa.float64()))})

    flat = np.array(dealt.filter(F.col("shard") == lowest).groupBy("shard").applyInArrow(start, "flat array<double>").first()[0])
    seed = rows.sparkSession.sparkContext.broadcast(flat)

    def refine(group: pa.Table) -> pa.Table:
        windows = _table(group, size)
        rng = np.random.Generator(np.random.PCG64(int(group["shard"][0].as_py())))
        fitted = AttentionLM.copy(shared.value).load(seed.value).fit(windows, rng.permutation(len(windows)), 2e-3, warm=20)
        moved = np.rint((fitted.flat() - seed.value) / UNIT).astype(np.int64)
        return pa.table({"moved": pa.array([moved], pa.list_(pa.int64()))})

    moved = stored(dealt.groupBy("shard").applyInArrow(refine, "moved array<bigint>"))
    mean = moved.select(F.posexplode("moved").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n")).toArrow()
    i, x, n = (mean[c].to_numpy() for c in ("i", "x", "n"))
    flat[i] += x.astype(float) / n * UNIT
    return model.load(flat)


class Model:
    """The attention model, the head words' counts and the corpus totals; of bounded size."""

    def __init__(self, train: DataFrame, shared: Broadcast, vocabulary: list[bytes], head: int, shard: int, steps: int):
        pieces = len(vocabulary)
        self.end, self.ids = pieces, pieces + 2
        self.counts = counts = _counts(train, shared, self.ids)
        totals = {r["kind"]: (r["rows"], r["n"]) for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
        self.texts = totals.get(TEXTS, (0, 0))[1]
        self.tokens = totals.get(WORDS, (0, 0))[1] + self.texts
        self.distinct = totals.get(WORDS, (0, 0))[0] + (self.texts > 0)
        self.words = words = counts.filter(F.col("kind") == WORDS).select("key", "first", "n")
        # the head: all words above a count that at most ``head`` words exceed
        level = F.floor(F.log2("n") * 16).cast("int")
        floor, room = None, head
        for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("level")).collect():
            if r["rows"] > room:
                break
            floor, room = r["level"], room - r["rows"]
        table = words.filter(level >= floor).select("key", "n").toArrow() if floor is not None else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        key = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.hash, self.n = key[order], table["n"].to_numpy()[order]
        # words and different words of each first id
        self.whole, self.kinds = np.zeros(self.ids), np.zeros(self.ids)
        for r in words.groupBy("first").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
            self.whole[r["first"]], self.kinds[r["first"]] = r["n"], r["k"]
        by_id = np.zeros(self.ids, np.int64)
        for r in counts.filter(F.col("kind") == IDS).select("key", "n").collect():
            by_id[r["key"]] = r["n"]
        by_id[self.end] = self.texts
        anchors = np.argsort(-by_id, kind="stable")[:ANCHORS]
        gathered = _gathered(train, shared, anchors, self.ids, 16)
        near = gathered.filter(F.col("kind") == NEAR).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        company = np.zeros(self.ids * 2 * len(anchors), np.float32)
        company[near["key"].to_numpy()] = near["n"].to_numpy()
        starts = np.array([p[:1] == b" " for p in vocabulary] + [True, False])
        self.net = _fit(gathered, AttentionLM(by_id, starts, company.reshape(self.ids, -1), size=16), shard, steps)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("counts", "words")}

    def log10_count(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def score(self, x: _Text) -> dict[str, np.ndarray]:
        """Per word occurrence: first (log10 of its first id), rest (that of the rest by the model), and per text end."""
        each, starts = self.net.log10(x.tokens, x.offsets)
        each, starts = each.astype(float), starts.astype(float)
        sums = np.concatenate(([0.0], np.cumsum(each)))
        return {"first": each[x.at], "rest": sums[x.stop] - sums[x.at + 1] + starts[x.stop], "end": each[x.offsets[1:] - 1]}


def lm_score(docs: DataFrame, vocabulary: list[bytes], head: int = 1 << 20, shard: int = 1 << 16, steps: int = 800) -> DataFrame:
    """Token counts, add-half unigram score and attention-model score of every whole text.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (tokens that occur in
    training texts), train_tokens (long), base_score and score (log10, double), one row per
    input row. Training texts are those of ids not held out, null ids included. Counts are of
    all of them; rows alike in id and text are one text for the model's windows, all of which
    are learnt from. A null or empty text is its end alone. Without
    training texts all counts are 0. Words are told apart by 64-bit hashes. Repeated rows count
    each. Other columns are ignored. ``head`` words are broadcast with their counts and the
    others meet theirs in a join; the scores don't depend on it.
    """
    spark = docs.sparkSession
    pieces = len(vocabulary)
    shared = spark.sparkContext.broadcast(Automaton(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()
    local = Model(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text"), shared, vocabulary, head, shard, steps)
    model = spark.sparkContext.broadcast(local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memory = model.value, _Pieces(shared.value)
        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text", SLICE):
                x = _Text(data, offsets, memory, pieces)
                got = m.score(x)
                n = np.diff(x.words.first)
                slot = np.minimum(np.searchsorted(m.hash, x.hash), max(0, len(m.hash) - 1))
                hit = m.hash[slot] == x.hash if len(m.hash) else np.zeros(len(x.hash), bool)
                count = np.where(hit, m.n[slot] if len(m.n) else 0, 0)
                whole, kinds = m.whole[x.first], m.kinds[x.first]
                share = np.where(whole > 0, kinds, 1.0)[x.back] * 10.0 ** got["rest"] + 1e-300
                rest = np.log10(np.where(whole > 0, count, 0)[x.back] + share) - np.log10(np.where(whole > 0, whole + kinds, 1.0))[x.back]
                per_word = np.stack([m.log10_count(count)[x.back], got["first"] + rest, hit.astype(float)[x.back]])
                sums = np.zeros((3, len(n)))
                full = np.flatnonzero(n)
                if len(full):
                    sums[:, full] = np.add.reduceat(per_word, x.words.first[full], axis=1)
                base, score, known = sums
                score += got["end"]
                rare = np.flatnonzero((~hit & (whole > 0))[x.back])
                fields = pa.StructArray.from_arrays([pa.array(x.hash[x.back[rare]].view(np.int64)), pa.array(share[rare])], ["key", "share"])
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(x.words.doc[rare], minlength=len(n))))).astype(np.int32)), fields)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n + 1), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score), tail], ["doc_id", "rid", "n_tokens", "known", "base", "score", "tail"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"))
    scored = stored(rows.mapInArrow(run, f"doc_id {kind}, rid long, n_tokens long, known long, base double, score double, tail array<struct<key:bigint,share:double>>"))
    # words below the head that have a count: what it adds to both scores
    rare = scored.select("rid", F.explode("tail").alias("x")).select("rid", "x.key", "x.share")
    found = rare.join(local.words.select("key", "n"), "key")
    more = found.groupBy("rid").agg(F.count(F.lit(1)).alias("k2"), F.sum(F.log10(2 * F.col("n") + 1)).alias("b2"), F.sum(F.log10(F.col("n") + F.col("share")) - F.log10("share")).alias("s2"))
    end = float(local.log10_count(np.array([local.texts]))[0])
    out = scored.drop("tail").join(more, "rid", "left")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("k2", F.lit(0)) + F.lit(int(local.texts > 0))).cast("long").alias("n_known"),
        F.lit(int(local.tokens)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b2", F.lit(0.0)) + F.lit(end)).alias("base_score"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"),
    )
