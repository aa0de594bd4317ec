"""N-gram Jaccard join: MinHash banding, then verification on whole n-gram sets.

Texts with the same n-gram set form a class, so copies cost one signature. Band and row
counts are chosen for a target recall. Classes meet in band buckets and are linked to
the bucket's smallest class, which grows with the buckets and not with their pairs.
Every component of that graph is then compared in full, in blocks of bounded size, by
exact intersections of the n-gram sets; a block returns link counts and a spanning
forest, never its pairs. So banding has to join two similar texts by some path only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .graph_blocks import components, forest
from .shared import checkpointed, stored


def choose_bands(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band with 1 - (1 - threshold^rows)^bands >= recall in that many hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands < recall:
            break
        best = (bands, rows)
    return best


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8128))
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _band_hashes(grams: np.ndarray, bands: int, rows: int, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 512):
            low = np.minimum(low, (grams[None, at : at + 512] * mul[:, None] + add[:, None]).min(axis=1))
        acc = np.zeros(bands, np.uint64)
        for r in range(rows):
            acc = textkit.mix(acc * np.uint64(31) + low[r::rows])
    return acc


def _gram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    words = textkit.Words(data, offsets)
    h = textkit.span_hashes(data, words.start, words.end, lower=True)
    for i in range(len(offsets) - 1):
        yield np.unique(textkit.shingles(h[words.first[i] : words.first[i + 1]], k))


def _signatures(rows: DataFrame, k: int, bands: int, per_band: int) -> DataFrame:
    """(id, dh, node, n, bands) of each row; node names the n-gram set, n is its size."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _salts(bands * per_band)
        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text"):
                size, node, found = [], [], []
                for grams in _gram_sets(data, offsets, k):
                    size.append(len(grams))
                    with np.errstate(over="ignore"):
                        node.append(textkit.mix(np.bitwise_xor.reduce(textkit.mix(grams + np.uint64(1))) + grams.sum() * np.uint64(3)) if len(grams) else np.uint64(0))
                    if len(grams):
                        found.append(_band_hashes(grams, bands, per_band, mul, add))
                ends = np.concatenate(([0], np.cumsum([bands if n else 0 for n in size]))).astype(np.int32)
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "dh", "node", "n", "bands"])

    return rows.mapInArrow(run, f"id {kind}, dh long, node long, n int, bands array<long>")


def _grams(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with text replaced by its n-gram set, as bytes of 64-bit hashes."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text"):
                sets = pa.array([g.tobytes() for g in _gram_sets(data, offsets, k)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], sets], [*names, "grams"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, grams binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None, cells: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of sorted sets, left x right (or left x left), by products of 0/1 matrices.

    Members that occur in one set only count on the diagonal of left x left alone; columns
    are taken in strips, so memory stays at about ``cells`` numbers and the result.
    """
    sets = left + (right or [])
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1)[column] > 1 if len(flat) else new
    column, owner = column[often], owner[often]
    out = np.zeros((len(left), len(left) if right is None else len(right)), np.float32)
    if not len(column):
        if right is None:
            np.fill_diagonal(out, sizes)
        return out
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
    strip = max(64, cells // max(1, len(sets)))
    for at in range(0, int(column[-1]) + 1, strip):
        lo, hi = np.searchsorted(column, [at, at + strip])
        m = np.zeros((len(sets), min(strip, int(column[-1]) + 1 - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1.0
        out += m[: len(left)] @ (m[: len(left)] if right is None else m[len(left) :]).T
    if right is None:
        np.fill_diagonal(out, sizes)
    return out


def _verify(threshold: float):
    """Links within a block, or between two: (node, links, root) of each class in it."""

    def run(table: pa.Table) -> pa.Table:
        node, first = np.unique(table["node"].to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        side, weight = table["block"].to_numpy(), table["copies"].to_numpy()
        grams = [np.frombuffer(x.as_py(), np.uint64) for x in table["grams"]]
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
        size = np.array([len(g) for g in grams], float)
        if low == high:
            both = intersections([grams[i] for i in a], None)
        else:
            both = intersections([grams[i] for i in a], [grams[i] for i in b])
        jaccard = both / (size[a][:, None] + size[b][None, :] - both)
        link = jaccard >= threshold - 1e-6
        # float32 products are exact, the quotient decides in double precision
        link &= both.astype(float) >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-9
        links = np.zeros(len(node), np.int64)
        if low == high:
            np.fill_diagonal(link, False)
            links[a] = link @ weight[a]
        else:
            links[a] += link @ weight[b]
            links[b] += link.T @ weight[a]
        root = node[forest(len(node), a, b, link)]
        return pa.table({"node": node, "links": links, "root": root})

    return run


def ngram_join(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9999, block: int = 512, block_grams: int = 1 << 20, key: str | None = None) -> DataFrame:
    """Near-duplicate class and number of links of every document.

    Two texts link when the Jaccard similarity of their sets of k-word n-grams (lower
    case in ASCII, split at ASCII white space; a shorter text is one n-gram) is at least
    ``threshold``. Returns doc_id, class_id (the smallest doc_id reachable over links,
    itself included), n_links (other documents linked directly, copies included; long) and
    kept (doc_id = class_id), one row per input row. A text without words (null, empty)
    links with nothing. Null ids take part: their class_id is null only if no id in the
    class isn't. Repeated rows are copies of each other. Other columns are ignored, but for
    ``key``, a hash of id and text that the caller has made and wants returned, with a
    column group that all rows of a class share.
    """
    bands, per_band = choose_bands(threshold, recall)
    rows = docs.select(F.col("doc_id").alias("id"), (F.col(key) if key else F.xxhash64("text")).alias("dh"), F.col("text").cast("string").alias("text"))
    sig = stored(_signatures(rows, k, bands, per_band))
    some = sig.filter("n > 0")
    classes = stored(some.groupBy("node").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "dh")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    met = classes.select("node", F.posexplode("bands").alias("band", "h"))
    bucket = met.groupBy("band", "h").agg(F.min("node").alias("low"), F.max("node").alias("top")).filter("low <> top")
    near = components(met.join(bucket, ["band", "h"]).select(F.col("node").alias("a"), F.col("low").alias("b")))

    group = near.join(classes.select("node", "n", "copies", "rep"), "node")
    group = checkpointed(group)
    blocks = group.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block_grams), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    group = group.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = group.select("root", "node", "copies", "blocks", "block", F.col("rep.id").alias("rid"), F.col("rep.dh").alias("rdh"))
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.col("dh") == F.col("rdh"))).select("root", "node", "copies", "blocks", "block", "text")
    sets = _grams(texts, k)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    found = checkpointed(dealt.groupBy("root", "low", "high").applyInArrow(_verify(threshold), "node long, links long, root long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = linked.join(classes.select("node", "first_id"), "node")
    names = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    linked = named.join(names, "root").select("node", "class_id", F.col("root").alias("group"))
    # only classes with copies or links need a lookup; the others are their own class
    known = classes.filter("copies > 1").select("node").unionByName(links.filter("links > 0").select("node")).distinct()
    info = known.join(classes.select("node", "first_id", "copies"), "node").join(links, "node", "left").join(linked, "node", "left")
    info = checkpointed(info.select(F.col("node").alias("_node"), F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("group", "node").alias("group"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = sig.select("id", "dh", "n", "node").join(info, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    class_id = F.when(F.col("_node").isNull(), F.col("id")).otherwise(F.col("class_id"))
    extra = [F.col("dh").alias(key), F.coalesce("group", "node").alias("group")] if key else []
    return out.select(*extra, F.col("id").alias("doc_id"), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("id").eqNullSafe(class_id).alias("kept"))
