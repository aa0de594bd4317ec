"""Benchmark decontamination by template canonicalisation.

Words become lower-case cores; numbers, names and units become typed placeholders whose
values are slots. Windows of ``window`` template words of a document are looked up among
those of the benchmark by hash. For each document and item the hits are aligned, over
neighbouring shifts where words were added or left out, and the slot values of aligned
words must be consistent: a slot whose item value stands for another value elsewhere
doesn't count. Successive placeholders of one kind are one slot. So a question with other numbers is still found, and
text that only shares a template by chance is not. Names are told by their capitals, so
both tables are also matched without name placeholders, for texts in other letter case,
and by their literal words, for items made of numbers and units.

The benchmark's windows are broadcast after its size is checked; a larger benchmark is
joined in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit

#: Words that count as units.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec min h hr hrs ms hz khz mhz ghz b kb mb gb tb w kw v a mph kmh "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees"
)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x11D1, 0x22E2, 0x33F3))
_SPELLED = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"


def _hash_list(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    w = textkit.Words(data, np.array([0, len(data)]))
    return np.sort(textkit.span_hashes(data, w.start, w.end, lower=True))


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


_UNIT_HASHES, _NUMBER_HASHES = _hash_list(UNITS), _hash_list(_SPELLED)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template, plain, value, first): template word, the same without name placeholders, and own hash of every word with a core, by text.

    A number is a core of digits, with inner points, commas, colons, slashes, percent or
    currency signs, or a spelled-out number; a unit stands right after a number; a name
    starts with an ASCII capital, has a lower-case letter, and doesn't begin a sentence.
    """
    words = textkit.Words(data, offsets)
    s, e = words.core()
    keep = e > s
    doc = words.doc[keep]
    before_end = words.end[keep]
    s, e = s[keep], e[keep]
    value = textkit.span_hashes(textkit.latin_lower(data), s, e)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    template = value.copy()
    if not len(s):
        return template, template, value, first
    digit = np.concatenate(([0], np.cumsum(textkit.DIGIT[data])))
    plain = np.concatenate(([0], np.cumsum(textkit.DIGIT[data] | textkit.PUNCT[data])))
    number = ((digit[e] > digit[s]) & (plain[e] - plain[s] == e - s)) | _in(_NUMBER_HASHES, value)
    last = data[before_end - 1]
    ends = np.isin(last, np.frombuffer(b".!?:", np.uint8))
    start = np.ones(len(s), bool)
    start[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    second = np.minimum(s + 1, len(data) - 1)
    name = textkit.UPPER[data[s]] & ~start & (e - s > 1) & ~textkit.UPPER[data[second]] & ~textkit.DIGIT[data[second]]
    unit = np.zeros(len(s), bool)
    unit[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit &= _in(_UNIT_HASHES, value)
    template[number], template[unit] = NUMBER, UNIT
    plain = template.copy()
    template[name & ~number & ~unit] = NAME
    return template, plain, value, first


def merged(template: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, value, first) with successive placeholders of one kind as one slot, so that values may change their word count."""
    if not len(template):
        return template, value, first
    start = np.ones(len(template), bool)
    start[1:] = (template[1:] != template[:-1]) | ~_slots(template[1:])
    start[first[first < len(start)]] = True
    at = np.flatnonzero(start)
    within = np.arange(len(start)) - at[np.cumsum(start) - 1]
    value = np.where(within > 0, textkit.mix(value + within.astype(np.uint64)), value)
    return template[at], np.add.reduceat(value, at), np.concatenate(([0], np.cumsum(start)))[first]


def _windows(template: np.ndarray, k: int) -> np.ndarray:
    return textkit.shingles(template, k)


def _slots(template: np.ndarray) -> np.ndarray:
    return (template == NUMBER) | (template == NAME) | (template == UNIT)


def _informative(template: np.ndarray, k: int) -> np.ndarray:
    """Windows with at least half ordinary words; others would match on placeholders alone."""
    slot = _slots(template)
    total = np.concatenate(([0], np.cumsum(slot)))
    k = min(k, len(template))
    return (total[k:] - total[: len(total) - k]) * 2 <= k


#: How many words two neighbouring pieces of an alignment may be shifted, and the words of a piece between indexed ones.
SHIFTS, PIECE = 4, 3


def _runs(item: np.ndarray, text: np.ndarray, shift: int, least: int) -> list[tuple[int, int, int]]:
    """(shift, begin, end) of the runs of ``least`` or more words of the item that the text has at that shift."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi - lo < least:
        return []
    equal = np.zeros(len(item) + 2, np.int8)
    equal[lo + 1 : hi + 1] = item[lo:hi] == text[lo + shift : hi + shift]
    edge = np.diff(equal)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(shift, int(b), int(e)) for b, e in zip(begin, end, strict=True) if e - b >= least]


def _chains(item: np.ndarray, text: np.ndarray, anchors: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the item, their shifts) of alignments: runs in ascending order of item and text.

    Windows without an index entry count where they agree. Runs on up to SHIFTS neighbouring
    shifts are chained, from PIECE words on where an anchor, a shift with an indexed window, is near.
    """
    least = min(PIECE, window)
    near = np.unique(anchors[:, None] + np.arange(-SHIFTS, SHIFTS + 1)) if len(item) > window else anchors
    groups = np.split(near, np.flatnonzero(np.diff(near) > 1) + 1)
    for group in groups:
        runs = sorted((r for d in group for r in _runs(item, text, int(d), least)), key=lambda r: (r[1] + r[0], r[1], r[0]))
        best: list[tuple[int, bool, int, int]] = []  # words, whether a window is among them, run before, begin
        for k, (d, b, e) in enumerate(runs):
            top = (e - b, e - b >= window, -1, b)
            for j in range(k - 1, -1, -1):
                d0, b0, e0 = runs[j]
                if b0 + d0 < b + d - len(item) - SHIFTS:
                    break
                if abs(d - d0) > SHIFTS or b0 >= b and d >= d0:
                    continue
                start = max(b, e0, e0 + d0 - d)  # words that both runs hold stay with the first
                if e - start > 0 and best[j][3] < e0:
                    top = max(top, (best[j][0] + e - start, best[j][1] or e - b >= window, j, start))
            best.append(top)
        used: set[int] = set()
        for k in sorted(range(len(runs)), key=lambda k: best[k], reverse=True):
            if k in used or not best[k][1]:
                continue
            places, shifts, at = [], [], k
            while at >= 0:
                used.add(at)
                d, _, e = runs[at]
                places.append(np.arange(best[at][3], e))
                shifts.append(np.full(e - best[at][3], d))
                at = best[at][2]
            yield np.concatenate(places[::-1]), np.concatenate(shifts[::-1])


def _consistent(ours: np.ndarray, theirs: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which words to keep: all but the slots whose item value stands for another value more often."""
    keep = np.ones(len(ours), bool)
    if slots.any():
        pairs, back, n = np.unique(np.stack([ours[slots], theirs[slots]]), axis=1, return_inverse=True, return_counts=True)
        order = np.lexsort((-n, pairs[0]))
        first = np.ones(len(order), bool)
        first[1:] = pairs[0][order][1:] != pairs[0][order][:-1]
        good = np.zeros(len(n), bool)
        good[order[first]] = True
        keep[slots] = good[back.ravel()]
    return keep


class Benchmark:
    """Template words of every item and a sorted table of their window hashes.

    With names, numbers, units and names are placeholders; without, only numbers and units.
    A literal table has no placeholders, and all windows: it finds exact copies of items
    whose windows are mostly placeholders.
    """

    def __init__(self, items: list[tuple], window: int, names: bool = True, literal: bool = False):
        self.window, self.names, self.literal = window, names, literal
        self.ids = [i for i, _ in items]
        hashes, owner, place, self.template, self.value = [], [], [], [], []
        for at, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode(), np.uint8)
            named, plain, value, _ = canonical(data, np.array([0, len(data)]))
            template = value if literal else named if names else plain
            if not literal:
                template, value, _ = merged(template, value, np.array([0]))
            self.template.append(template)
            self.value.append(value)
            h = _windows(template, window)
            good = np.ones(len(h), bool) if literal or not len(h) else _informative(template, window)
            hashes.append(h[good])
            owner.append(np.full(good.sum(), at))
            place.append(np.flatnonzero(good))
        h, o, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owner, place))
        order = np.lexsort((p, o, h))
        self.hash, self.owner, self.place = h[order], o[order], p[order]
        self.sizes = sorted({min(window, len(t)) for t in self.template if len(t)})

    def find(self, template: np.ndarray, value: np.ndarray, coverage: float, run: int) -> list[tuple[int, int, float, int, bool]]:
        """(item, template words matched, coverage, longest run, exact) of the items found in one text."""
        at, item, place, width = [], [], [], []
        for k in self.sizes:
            h = textkit.shingles(template, k) if len(template) >= k else np.zeros(0, np.uint64)
            if not len(h) or not len(self.hash):
                continue
            lo = np.searchsorted(self.hash, h, "left")
            hi = np.searchsorted(self.hash, h, "right")
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            if not len(n):
                continue
            slot = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)
            fits = np.array([min(self.window, len(self.template[o])) == k for o in self.owner[slot]])
            at.append(np.repeat(hit, n)[fits])
            item.append(self.owner[slot][fits])
            place.append(self.place[slot][fits])
            width.append(np.full(fits.sum(), k))
        if not at:
            return []
        at, item, place, width = (np.concatenate(x) for x in (at, item, place, width))
        found = []
        for o in np.unique(item):
            mine = item == o
            w = int(width[mine][0])
            best = None
            for places, shifts in _chains(self.template[o], template, np.unique(at[mine] - place[mine]), w):
                ours, theirs = self.value[o][places], value[places + shifts]
                keep = _consistent(ours, theirs, _slots(self.template[o][places]))
                if w < self.window and not (keep.all() and len(places) == w):
                    continue  # a short item must occur whole
                where = places[keep]
                if not len(where):
                    continue
                turn = np.flatnonzero((np.diff(where) > 1) | (np.diff(shifts[keep]) != 0))
                edges = np.concatenate(([-1], turn, [len(where) - 1]))
                row = (len(where), int(np.diff(edges).max()), bool(keep.all() and (ours == theirs).all() and not np.diff(shifts).any()))
                if best is None or row > best:
                    best = row
            if best:
                share = best[0] / len(self.template[o])
                if share >= coverage or best[1] >= run:
                    found.append((int(o), best[0], share, best[1], best[2]))
        return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.6, run: int = 13, limit: int = 1 << 25) -> DataFrame:
    """Documents that hold a benchmark item, as it stands or with other numbers, names or units.

    Returns doc_id, item_id, n_words (template words matched, long), coverage (their share of
    the item), longest_run (long) and exact (all values equal), one row per document row and
    item whose consistent alignment covers at least ``coverage`` of the item's words, or a
    run of ``run`` of them. An item shorter than ``window`` words must occur whole. Null and
    empty texts or items match nothing; null ids stay null; items with equal texts are all
    reported, and repeated rows each get their rows. No items: no rows. The benchmark is
    broadcast if it has at most ``limit`` characters; a larger one is dealt by hash into
    parts below that size, each joined in a pass of its own. Other columns are ignored.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-2 * size // limit)) if size > limit else 1
    out = None
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = _contained(docs, some, window, coverage, run)
        out = found if out is None else out.unionByName(found)
    return out


def _contained(docs: DataFrame, items: DataFrame, window: int, coverage: float, run: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([Benchmark(rows_, window, names, literal) for rows_ in [[(r[0], r[1]) for r in items.collect()]] for names, literal in ((True, False), (False, False), (False, True))])
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    item_type = to_arrow_type(items.schema["item_id"].dataType)

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = shared.value
        for batch in batches:
            for part, data, offsets in textkit.slices(batch, "text"):
                named, plain, value, first = canonical(data, offsets)
                best: dict[tuple[int, int], tuple] = {}
                for bench in both:
                    template, own, at_word = (value, value, first) if bench.literal else merged(named if bench.names else plain, value, first)
                    hot = np.zeros(len(offsets) - 1, bool)
                    for k in bench.sizes:  # texts without any window of the benchmark are passed over together
                        if len(template) >= k and len(bench.hash):
                            at = np.flatnonzero(_in(bench.hash, textkit.shingles(template, k)))
                            hot[np.searchsorted(at_word, at, "right") - 1] = True
                    for i in np.flatnonzero(hot):
                        for f in bench.find(template[at_word[i] : at_word[i + 1]], own[at_word[i] : at_word[i + 1]], coverage, run):
                            best[i, f[0]] = max(best.get((i, f[0]), ()), f[1:])
                out = [(i, o, *f) for (i, o), f in best.items()]
                if out:
                    doc, item, n, share, longest, exact = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.array(doc))), pa.array([both[0].ids[i] for i in item], item_type), pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array(longest, pa.int64()), pa.array(exact, pa.bool_())],
                        ["doc_id", "item_id", "n_words", "coverage", "longest_run", "exact"],
                    )

    return rows.mapInArrow(run_batches, f"doc_id {doc_kind}, item_id {item_kind}, n_words long, coverage double, longest_run long, exact boolean")
