"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Only lines that occur again can be part of a repeated run, so each document shrinks to
its segments of such lines, and equal segments to their first. Suffixes of the rest are
ranked by their first 1, 2, 4, ... lines. A run of l lines with 2^k <= l < 2^(k+1) is
named by two overlapping ranks of round k; the suffixes that share the name form an
LCP interval of depth l. Where an interval holds min_words words, all but its first
suffix are later copies, and the union of their runs is the maximal repeated run.
Runs just long enough have at most min_words lines, so log2(min_words) rounds suffice.
DataFrame operations only; documents are never gathered, only their line hashes move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, stored

#: Hash range of the first ranks: a fixed number of buckets, each sorted by itself.
BUCKETS = 4096


def _lines(text: Column) -> Column:
    """Non-blank lines as (i: line number, s: trimmed line)."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, "\r", "")).alias("s"))), lambda x: x["s"] != "")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """(h1, h2, rank) of lines that occur again; rank counts the occurrences of smaller lines, by hash."""
    seen = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("b", F.shiftrightunsigned("h1", 52))
    seen = checkpointed(seen)
    total = seen.groupBy("b").agg(F.sum("n").alias("n"))
    total = total.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("h1", "h2")) - F.col("n")
    return seen.withColumn("inside", inside).join(total, "b").select("h1", "h2", (F.col("inside") + F.col("before")).alias("rank"))


def _segments(lines: DataFrame, min_words: int) -> DataFrame:
    """Segments of repeated lines with at least min_words words: (doc_id, dh, t0, items of t, rank, m, mm, i).

    t counts non-blank lines and i all lines of the document.
    m is the fewest lines from an item that hold min_words words; runs from it of m to mm lines
    are the shortest ones by their start or by their end. Null m: too few words remain.
    """
    ranked = lines.join(_first_ranks(lines), ["h1", "h2"]).select("doc_id", "dh", "t", "i", "w", "rank").distinct()
    doc = Window.partitionBy("doc_id", "dh").orderBy("t")
    seg = Window.partitionBy("doc_id", "dh", "g")
    by_t = seg.orderBy("t")
    x = ranked.withColumn("g", F.col("t") - F.row_number().over(doc))
    x = x.withColumn("total", F.sum("w").over(seg)).filter(F.col("total") >= min_words)
    x = x.withColumn("b", F.sum("w").over(by_t) - F.col("w")).withColumn("k", F.row_number().over(by_t) - 1).withColumn("n", F.count(F.lit(1)).over(seg))
    reach = F.count(F.lit(1)).over(seg.orderBy("b").rangeBetween(Window.unboundedPreceding, min_words - 1))
    x = x.withColumn("m", F.when(F.col("total") - F.col("b") >= min_words, reach - F.col("k")).cast("int"))
    x = x.withColumn("mm", F.when(F.col("m").isNotNull(), F.greatest("m", F.coalesce(F.lead("m").over(by_t), F.col("n") - F.col("k")))).cast("int"))
    item = F.struct("t", "rank", "m", "mm", "i")
    return x.groupBy("doc_id", "dh", "g").agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("t0", F.col("items")[0]["t"]).drop("g")


def _next_ranks(pairs: DataFrame, width: int) -> DataFrame:
    """(r1, r2, rank): r1 plus the number of suffixes that share r1 and have a smaller r2.

    Counts go up in two steps, within and across ranges of r2, so that a rank that very
    many suffixes share is not counted in one task.
    """
    c = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("c")).withColumn("q", F.shiftright("r2", width))
    inside = c.withColumn("inside", F.sum("c").over(Window.partitionBy("r1", "q").orderBy("r2")) - F.col("c"))
    across = c.groupBy("r1", "q").agg(F.sum("c").alias("c"))
    across = across.select("r1", "q", (F.sum("c").over(Window.partitionBy("r1").orderBy("q")) - F.col("c")).alias("before"))
    return inside.join(across, ["r1", "q"]).select("r1", "r2", (F.col("r1") + F.col("inside") + F.col("before")).alias("rank"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Runs that are later copies: (doc_id, dh, runs: array of line numbers (s, e), e exclusive).

    dh hashes id and text. Earlier means a smaller (doc_id, dh, line), null ids first.
    Rows alike in id and text are one document.
    """
    text = F.col("text").cast("string")
    lines = docs.select("doc_id", F.xxhash64("doc_id", text).alias("dh"), F.posexplode(_lines(text)).alias("t", "line"))
    lines = lines.select("doc_id", "dh", "t", F.col("line.i").alias("i"), F.xxhash64("line.s").alias("h1"), F.xxhash64(F.lit(1), "line.s").alias("h2"), F.regexp_count("line.s", F.lit("[^\\x20\\x09-\\x0D]+")).alias("w"))
    lines = stored(lines)
    segments = stored(_segments(lines, min_words))

    ids = F.col("items.rank")
    segments = segments.withColumn("s1", F.xxhash64(ids)).withColumn("s2", F.xxhash64(F.lit(1), ids)).withColumn("at", F.struct("doc_id", "dh", "t0"))
    first = segments.groupBy("s1", "s2").agg(F.min("at").alias("first"))
    marked = segments.join(first, ["s1", "s2"]).withColumn("copy", ~F.col("at").eqNullSafe(F.col("first"))).drop("s1", "s2", "first", "at")
    marked = checkpointed(marked)
    whole = marked.filter("copy").select("doc_id", "dh", F.col("items")[0]["i"].alias("s"), (F.element_at("items", -1)["i"] + 1).alias("e"))

    state = marked.filter(~F.col("copy")).select("doc_id", "dh", "t0", "items")
    size = state.agg(F.sum(F.size("items")).alias("n"), F.max(F.array_max("items.mm")).alias("most")).first()
    width = max(1, (int(size["n"] or 1).bit_length() + 1) // 2)
    named = None
    for k in range(int(size["most"] or 0).bit_length()):
        step = 1 << k
        rows = state.select("doc_id", "dh", "t0", "items", F.posexplode("items").alias("k", "x"))
        at = lambda offset: F.get(F.col("items"), F.col("k") + offset)
        low, high = F.greatest(F.col("x.m"), F.lit(step)), F.least(F.col("x.mm"), F.lit(2 * step - 1))
        runs = rows.filter(F.col("x.m").isNotNull() & (low <= high)).select("doc_id", "dh", F.col("x.t").alias("t"), F.col("x.rank").alias("ra"), F.col("x.i").alias("s"), "items", "k", F.explode(F.sequence(low, high)).alias("l"))
        runs = checkpointed(runs.select("doc_id", "dh", "t", "l", "ra", at(F.col("l") - step)["rank"].alias("rb"), "s", (at(F.col("l") - 1)["i"] + 1).alias("e")))
        named = runs if named is None else named.unionByName(runs)
        if size["most"] < 2 * step:
            break
        pairs = rows.select("doc_id", "dh", "t0", "x", F.col("x.rank").alias("r1"), F.coalesce(at(F.lit(step))["rank"], F.lit(-1)).alias("r2"))
        ranked = pairs.join(_next_ranks(pairs.select("r1", "r2"), width), ["r1", "r2"])
        item = F.struct(F.col("x.t").alias("t"), F.col("rank"), F.col("x.m").alias("m"), F.col("x.mm").alias("mm"), F.col("x.i").alias("i"))
        state = checkpointed(ranked.groupBy("doc_id", "dh", "t0").agg(F.sort_array(F.collect_list(item)).alias("items")))
    if named is None:
        found = whole
    else:
        named = named.withColumn("at", F.struct("doc_id", "dh", "t"))
        interval = named.groupBy("l", "ra", "rb").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        later = named.join(interval, ["l", "ra", "rb"]).filter(F.col("at") != F.col("first"))
        found = whole.unionByName(later.select("doc_id", "dh", "s", "e"))
    # overlapping and touching runs are one
    order = Window.partitionBy("doc_id", "dh").orderBy("s", "e")
    apart = F.col("s") > F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("island", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    merged = island.groupBy("doc_id", "dh", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.groupBy("doc_id", "dh").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` without the lines of later copies of repeated runs of min_words words or more.

    All columns stay and text loses its repeated lines; added are n_lines and n_removed (lines
    before and removed, long) and runs (removed line numbers (s, e), e exclusive; null if none).
    Lines are compared without outer spaces and carriage returns. Blank ones are skipped, and
    go only inside a removed run; a document whose lines all go has the text ''. A null or empty
    text, or one without repeats, is unchanged. The first copy of every run, by doc_id (null
    first), then by a hash, then by line, stays. Repeated rows are one document: each gets the
    same result. Added names that clash with columns of ``docs`` are taken from the operator.
    """
    text = F.col("text").cast("string")
    base = docs.drop("n_lines", "n_removed", "runs")
    cut = checkpointed(repeated_runs(docs, min_words)).select(F.col("doc_id").alias("__weft_id"), F.col("dh").alias("__weft_dh"), "runs")
    hit = base.withColumn("__weft_key", F.xxhash64("doc_id", text)).join(cut, F.col("doc_id").eqNullSafe(F.col("__weft_id")) & (F.col("__weft_key") == F.col("__weft_dh")), "left").drop("__weft_id", "__weft_dh", "__weft_key")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["e"] - 1)))
    # an array of one binds the split text, so that it isn't split again for each line
    bound = F.array(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone")))
    rest = lambda z: F.array_except(F.sequence(F.lit(0), F.size(z["lines"]) - 1), z["gone"])
    kept = F.transform(bound, lambda z: F.array_join(F.transform(rest(z), lambda i: F.get(z["lines"], i)), "\n"))[0]
    n_removed = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"]), F.lit(0).cast("long"))
    n_lines = F.coalesce(F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1), F.lit(0)).cast("long")
    out = hit.withColumn("n_lines", n_lines).withColumn("n_removed", n_removed).withColumn("text", F.when(F.col("runs").isNotNull(), kept).otherwise(text))
    return out.select(*base.columns, "n_lines", "n_removed", "runs")
