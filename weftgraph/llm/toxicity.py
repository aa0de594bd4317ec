"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs that skip a word of a text
(lower case, without outer punctuation), hashed into 2^bits slots. A word also counts
as its stems, its first 5 to 8 bytes, so that unseen inflections are recognised. The learner
keeps per-coordinate rates, and its L1 term leaves a sparse weight table of at most
2^bits entries, which is broadcast; scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

BITS = 20
STEMS = (5, 6, 7, 8)
_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word, stem, neighbouring pair and skipping pair, repeats included."""
    words = textkit.Words(data, offsets)
    s, e = words.core()
    doc, keep = words.doc, e > s
    s, e, doc = s[keep], e[keep], doc[keep]
    h = textkit.span_hashes(data, s, e, lower=True)
    shift = np.uint64(64 - bits)
    slots, docs = [h >> shift], [doc]
    with np.errstate(over="ignore"):
        for stem, at in textkit.prefix_hashes(data, s, e, STEMS):
            slots.append(stem >> shift)
            docs.append(doc[at])
        for gap, salt in ((1, _PAIR), (2, _SKIP)):
            if len(h) > gap:
                same = doc[gap:] == doc[:-gap]
                slots.append(textkit.mix(h[:-gap][same] * salt + h[gap:][same]) >> shift)
                docs.append(doc[gap:][same])
    return np.concatenate(docs), np.concatenate(slots).astype(np.int64)


def _fit(slots: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of FTRL-proximal after ``epochs`` passes in the given order; the last slot is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    free = size - 1  # the bias has no L1 term
    for _ in range(epochs):
        for x, y in zip(slots, labels, strict=True):
            x = np.append(x, free)
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            cut = np.full(len(x), l1)
            cut[-1] = 0.0
            w = np.where(np.abs(zx) <= cut, 0.0, -(zx - np.sign(zx) * cut) / ((beta + root) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
    cut = np.full(size, l1)
    cut[-1] = 0.0
    return np.where(np.abs(z) <= cut, 0.0, -(z - np.sign(z) * cut) / ((beta + np.sqrt(n)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12000, bits: int = BITS, epochs: int = 2, alpha: float = 0.2, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1) -> pd.DataFrame:
    """Non-zero weights (slot, weight) learnt from at most ``sample`` labelled rows.

    ``labels`` has doc_id and toxic; rows null in either, and rows held out by the
    caller, don't count. The sample is the rows lowest by a hash of their id, so it
    doesn't depend on partitioning, and its bound lets one task fit it. An id that
    occurs in several documents or label rows contributes each label once, with its first text.
    No labelled rows: no weights, and every score is 0.5.
    """
    picked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    picked = picked.orderBy(F.xxhash64(F.lit(7), F.col("doc_id")), "doc_id", "toxic").limit(sample)
    pairs = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    pairs = pairs.groupBy(F.xxhash64(F.lit(7), "doc_id").alias("place"), "toxic").agg(F.min("text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text"):
                doc, slot = _features(data, offsets, bits)
                both = np.unique(doc << bits | slot)
                first = np.searchsorted(both >> bits, np.arange(len(offsets)))
                slot = pa.array((both & ((1 << bits) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), slot)], ["place", "toxic", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.values.to_numpy() for x in b.column(2)), strict=True)]
        rows.sort(key=lambda r: r[:2])
        if rows:
            w = _fit([r[2] for r in rows], np.array([r[1] for r in rows], float), bits, epochs, alpha, beta, l1, l2)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["slot", "weight"])

    hashed = pairs.select("place", "toxic", "text").mapInArrow(featurise, "place long, toxic int, slots array<int>")
    return hashed.repartition(1).mapInArrow(learn, "slot int, weight double").toPandas()


def score(docs: DataFrame, weights: pd.DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with the score of each whole text in 0 to 1 added.

    A null or empty text, or one without words, gets the score of the bias alone. A column
    of the name score is replaced.
    """
    table = np.zeros((1 << bits) + 1)
    table[weights["slot"].to_numpy(np.int64)] = weights["weight"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((table[:-1].astype(np.float32), float(table[-1])))
    kept = [c for c in docs.columns if c != "score"]
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(kept)]
    rows = docs.select(*[(docs[c].cast("string") if c == "text" else docs[c]).alias(n) for c, n in zip(kept, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text"):
                doc, slot = _features(data, offsets, bits)
                live = w[slot] != 0
                both = np.unique(doc[live] << bits | slot[live])
                sums = np.bincount(both >> bits, w[both & ((1 << bits) - 1)].astype(float), len(offsets) - 1) + bias
                p = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], pa.array(p)], [*names, "score"])

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(run, f"{schema}, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "score")


def held_out(doc_id) -> F.Column:
    """True for the quarter of the ids that labels are not learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Held-out mark, score and prediction of every document.

    Returns doc_id, held_out, score, predicted (1 from ``threshold`` on), one row per
    input row. Labels of held-out ids are not learnt from; lang, source and doc_id are
    no features. An empty table gives no rows; extra columns are ignored.
    """
    weights = train(docs, labels.filter(~held_out(F.col("doc_id"))), **options)
    scored = score(docs.select("doc_id", "text"), weights).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
