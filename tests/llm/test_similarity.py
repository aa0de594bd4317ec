"""N-gram join, embedding dedup and decontamination, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import ngram_join as N
from weftgraph.llm.decontamination import decontaminate
from weftgraph.llm.embedding_dedup import embedding_dedup
from weftgraph.llm.shared import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def closure(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def grams(text):
    w = [x.lower() for x in re.split("[ \t-\r]+", text or "") if x]
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_bands_reach_the_recall_asked_for():
    bands, rows = N.choose_bands(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999 and rows >= 4


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for group in range(6):
        base = [word() for _ in range(rng.choice([6, 40, 90]))]
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            docs.append((len(docs) + 10, " ".join(text)))
    docs += [(1, docs[3][1]), (2, docs[3][1].upper()), (3, ""), (4, None), (5, "a b"), (6, "A  b"), (7, " \t\n")]
    want_links, linked = dict.fromkeys([d for d, _ in docs], 0), []
    for i, (a, ta) in enumerate(docs):
        for b, tb in docs[:i]:
            x, y = grams(ta), grams(tb)
            if x and y and len(x & y) >= 0.8 * len(x | y):
                want_links[a] += 1
                want_links[b] += 1
                linked.append((a, b))
    root = closure([d for d, _ in docs], linked)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit(1))
    for block in (512, 3):  # small blocks take the path of groups too large for one task
        got = {r["doc_id"]: r for r in N.ngram_join(df, block=block).collect()}
        assert {d: got[d]["n_links"] for d in got} == want_links
        assert {d: got[d]["class_id"] for d in got} == root
        assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


def test_ngram_join_of_null_ids_repeats_and_nothing(spark):
    rows = N.ngram_join(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "other words")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in rows) == [("7", "7", 2), ("7", "7", 2), ("None", "7", 2), ("None", "None", 0)]
    assert N.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intersections_in_strips():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (N.intersections(sets, None, cells=2000) == want).all() and (N.intersections(sets[:5], sets[5:], cells=100) == np.array(want)[:5, 5:]).all()


@pytest.mark.parametrize(("cell", "block"), [(2000, 1024), (20, 16)])
def test_embedding_links_equal_brute_force_across_cells_and_blocks(spark, cell, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([b + rng.normal(scale=s, size=(n, 16)) for b, s, n in zip(base, rng.choice([0.02, 0.1, 0.16], 12), rng.integers(3, 25, 12), strict=True)])
    label = rng.integers(0, 2, len(x))
    rows = [(i + 100, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))]
    rows += [(1, rows[0][1], rows[0][2]), (2, rows[0][1], None), (3, None, 0), (4, [0.0] * 16, 0), (5, [None] + [1.0] * 15, 0), (6, [float("nan")] * 16, 0), (7, [float("inf")] + [1.0] * 15, 1), (8, [], 0)]
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, c in rows if c is not None and i not in (2, 3, 4, 5, 6, 7, 8)}
    lab = {i: c for i, _, c in rows}
    linked = [(a, b) for a in ok for b in ok if a < b and lab[a] == lab[b] and ok[a] @ ok[b] >= 0.98]
    root = closure([r[0] for r in rows], linked)
    got = {r["vec_id"]: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell_size=cell, block=block).collect()}
    assert len(got) == len(rows) and linked
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in linked) for i in got}


def test_embedding_dedup_of_nothing(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert embedding_dedup(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).first()["component_id"] == 1


ITEM = "If Maria has 12 apples and gives Peter 5 km of rope before lunch, how many apples does Maria keep in the end?"


def found(spark, *texts, items=((1, ITEM),), **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("item_id", F.lit(9))
    return sorted((r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate(docs, spark.createDataFrame(list(items), "item_id long, text string"), **options).collect())


def test_decontamination_finds_verbatim_and_reparameterised_items_only(spark):
    other = ITEM.replace("Maria", "Anna").replace("12", "340").replace("Peter", "Otto").replace("5 km", "7 miles")
    mixed = ITEM.replace("Maria has", "Anna has")  # Maria is Anna first and Maria later: that slot doesn't count, the rest of the copy does
    text = "Some words come first. " + ITEM.upper().lower() + " And then more."
    got = found(spark, ITEM, f"Intro. {other} Outro.", "nothing of the kind is here at all, only words", None, "", text, mixed, ITEM[:20])
    assert [g[:2] for g in got] == [(0, 1), (1, 1), (5, 1), (6, 1)] and got[0][2] and not got[1][2] and not got[3][2]


def test_decontamination_of_items_rich_in_numbers(spark):
    row = "12 kg 30 km 7 miles 45 seconds 19 pounds 3 liters 88 hours 5 days 64 years"
    half = "Compute the total of these values for me please: 3 kg 4 km 5 kg 6 km 7 kg 8 km 9 kg 10 km"
    other = half.replace("3 kg", "33 kg").replace("8 km", "81 km")
    got = found(spark, f"Data: {row} end.", f"Now {half}. Done", f"Now {other}. Done", row.replace("1", "2").replace("3", "4"), items=((1, row), (2, half)))
    assert got == [(0, 1, True), (1, 2, True), (2, 2, False)]


def test_decontamination_of_shifted_and_partly_inconsistent_copies(spark):
    item = "every morning the old baker walks slowly across the bridge to buy fresh white flour"
    words = item.split()
    added, left = " ".join(words[:7] + ["quite"] + words[7:]), " ".join(words[:6] + words[7:])
    trip = "On Monday the train from Paris reaches the coast after 25 stops and then returns to Paris by night"
    longer = trip.replace("Paris", "New York").replace("25", "twenty five")
    sums = "if a box holds 4 pens and a bag holds 4 pens then how many are there"
    differ = sums.replace("bag holds 4", "bag holds 9").replace("box holds 4", "box holds 7")
    chance = "the old baker walks home and then all of us go across the bridge to the other side"
    got = found(spark, added, left, longer, differ, chance, items=((1, item), (2, trip), (3, sums)))
    assert [g[:2] for g in got] == [(0, 1), (1, 1), (2, 2), (3, 3)]
    assert not any(g[2] for g in got)


def test_decontamination_in_parts_short_items_and_nothing(spark):
    items = [(1, ITEM), (2, "a short item"), (3, None), (4, ""), (5, "a short item")]
    text = "here is A short, item indeed. " + ITEM
    assert [g[:2] for g in found(spark, text, items=items)] == [(0, 1), (0, 2), (0, 5)]
    assert [g[:2] for g in found(spark, text, items=items, limit=60)] == [(0, 1), (0, 2), (0, 5)]
    assert found(spark, text, items=[(3, None)]) == []
