"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

The centres are fitted on a bounded sample. Every vector is compared in the cell of its
nearest centre with all vectors there and with visitors: vectors of other cells that lie
within the largest distance of a linked pair from the plane between the two centres. A
linked pair cannot be farther apart, so no link is lost at a cell's border. Cells are cut
into blocks of bounded size; a block returns link counts and a spanning forest, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph_blocks import components, forest
from .shared import checkpointed, stored


def fit_centres(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of spherical k-means; the start is every (n / k)-th row, an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def _unit(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return _normal(flat)


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; divided by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(rows: DataFrame, centres: np.ndarray, threshold: float, width: int) -> DataFrame:
    """(node, label, copies, v, cell, at_home) of each vector in its own cell and in those it visits."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        gap = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 256 else None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = _unit(part, "v", width) @ c.T
                home = near.argmax(axis=1)
                best = near[np.arange(len(home)), home]
                apart = gap[home] if gap is not None else np.sqrt(np.maximum(0.0, 2 - 2 * (c[home] @ c.T)))
                visit = best[:, None] - near <= reach * apart + 1e-9
                row, cell = np.nonzero(visit)
                take = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(cell.astype(np.int32)), pa.array(cell == home[row])], [*part.schema.names, "cell", "at_home"])

    return rows.mapInArrow(run, "node long, label long, copies long, v array<double>, cell int, at_home boolean")


def _compare(threshold: float, width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if table.num_rows == 0:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        node, weight = table["node"].to_numpy(), table["copies"].to_numpy()
        host, role = table["host"].to_numpy(), table["role"].to_numpy()
        x = _unit(table.to_batches()[0], "v", width)
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        link = x[a] @ x[b].T >= threshold
        link &= node[a][:, None] != node[b][None, :]
        links = np.zeros(len(node), np.int64)
        links[a] = link @ weight[b] if len(b) else 0
        names, back = np.unique(node, return_inverse=True)
        root = names[forest(len(names), back[a], back[b], link)]
        mine, first = np.unique(node[a], return_index=True)
        return pa.table({"node": mine, "links": links[a][first], "root": root[back[a][first]]})

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, cell_size: int = 2000, sample: int = 20000, max_cells: int = 1024, block: int = 1024) -> DataFrame:
    """Links, component and representative of every vector, among vectors of an equal label.

    Returns vec_id, n_links (other vectors of the same non-null label with a cosine of at
    least ``threshold`` in double precision; long), component_id (smallest vec_id reachable
    over links) and kept (vec_id = component_id), one row per input row. Vectors that are
    null, empty, zero, or hold nulls or non-finite numbers link with nothing, and vectors
    of different lengths don't link. Vectors alike in label and components are compared
    once. A null vec_id takes part; its component_id is null if all of the component's are.
    The centres come from at most ``sample`` vectors; there are at most ``max_cells`` cells,
    and larger cells are compared in more blocks.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    alive = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    base = vectors.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"), F.coalesce(alive, F.lit(False)).alias("alive"))
    base = stored(base.withColumn("node", F.when(F.col("alive"), F.xxhash64("label", "v"))))
    classes = base.filter("alive").groupBy("node").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("label", "v")).alias("x"))
    classes = stored(classes.select("node", "first_id", "copies", "x.label", "x.v"))

    found = None
    for width, n in sorted((r["w"], r["n"]) for r in classes.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()):
        rows = classes.filter(F.size("v") == width).select("node", "label", "copies", "v")
        labels = rows.select(F.approx_count_distinct("label")).first()[0]
        k = int(min(max_cells, max(1, math.ceil(n / max(1, labels) / cell_size))))
        taken = np.array([r["v"] for r in rows.select("v", "node").orderBy(F.xxhash64("node"), "node").limit(min(sample, 64 * k)).collect()], float).reshape(-1, width)
        centres = fit_centres(_normal(taken), k)
        seen = stored(_cells(rows, centres, threshold, width))
        blocks = seen.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        dealt = seen.join(blocks, ["label", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # each host block meets every block of its cell: as rows of role 0 (hosts) and 1 (all)
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        cols = ["label", "cell", "node", "copies", "v"]
        hosts = dealt.filter("at_home").withColumn("role", F.lit(0)).withColumn("guest", F.explode(every)).select(*cols, "role", F.col("own").alias("host"), "guest")
        guests = dealt.withColumn("role", F.lit(1)).withColumn("host", F.explode(every)).select(*cols, "role", "host", F.col("own").alias("guest"))
        part = hosts.unionByName(guests).groupBy("label", "cell", "host", "guest").applyInArrow(_compare(threshold, width), "node long, links long, root long")
        part = checkpointed(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = linked.join(classes.select("node", "first_id"), "node")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(names, "root").select("node", "component_id")
    info = classes.select("node", "first_id", "copies").join(links, "node", "left").join(linked, "node", "left")
    info = checkpointed(info.select(F.col("node").alias("_node"), F.coalesce("component_id", "first_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = base.select("id", "node").join(info, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("_node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
