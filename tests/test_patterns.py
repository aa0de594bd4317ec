"""Shared contexts and missing links against brute force, and without all pairs of a large group."""

import random
import time
from collections import Counter
from itertools import combinations

import pytest

from weftgraph.operators import literature


def contexts(terms, least):
    sets = {}
    for e, t in terms:
        if e is not None and t is not None and len(t) > 2:
            sets.setdefault(e, set()).add(t)
    n = Counter(" ".join(sorted(a & b)) for a, b in combinations(sets.values(), 2) if a & b)
    return {c: k for c, k in n.items() if k >= least}


@pytest.mark.parametrize("widest", [0, 2, 3, 10])
def test_shared_contexts_equal_brute_force(spark, widest):
    rng = random.Random(widest)
    terms = [(e, t) for e in range(60) for t in rng.choices(["alpha", "beta", "gamma", "delta", "eps", "ze", "a b", "b cd", None], k=rng.randint(0, 6))] + [(None, "alpha"), (None, "beta")]
    for least in (1, 2):
        got = literature.shared_context_patterns(spark.createDataFrame(terms, "entity long, term string"), least, widest=widest).collect()
        assert {r["context"]: r["n_pairs"] for r in got} == contexts(terms, least)
        assert all(r["strength"] == round(min(r["n_pairs"] / 3, 1), 6) for r in got)


def test_contexts_of_a_frequent_term_need_no_pairs(spark):
    n, start = 60_000, time.time()
    got = literature.shared_context_patterns(spark.range(n).selectExpr("id AS entity", "explode(array('common', IF(id % 2 = 0, 'even', 'odd'))) AS term")).collect()
    half = n // 2 * (n // 2 - 1) // 2
    assert {r["context"]: r["n_pairs"] for r in got} == {"common": n // 2 * (n // 2), "common even": half, "common odd": half}
    assert time.time() - start < 90  # 1.8 billion pairs


def links(members, edges, least, first):
    out = set()
    for p in {p for p, _ in members if p is not None}:
        mine = {m for q, m in members if q == p}
        if len(mine) >= least:
            some = sorted(m for m in mine if m is not None)
            out |= {(p, *x) for x in [x for x in combinations(some, 2) if x not in edges][:first]}
    return out


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_missing_links_equal_brute_force(spark, share):
    rng = random.Random(int(share * 100))
    members = [(p, f"m{i}") for p in "abcde" for i in rng.sample(range(60), {"a": 2, "b": 3}.get(p, 40))] + [("a", None), ("b", None), (None, "m1"), (None, "m2"), (None, "m3"), ("c", "m1"), ("c", "m1")]
    names = [f"m{i}" for i in range(60)]
    edges = [x for x in ((a, b) for a in names for b in names) if rng.random() < share] + [(None, "m1"), ("m1", None), ("m1", "m1")]
    for least, first in ((3, 10), (3, 1), (50, 3), (1, 400)):
        got = literature.missing_links(spark.createDataFrame(members, "pathway string, member string"), spark.createDataFrame(edges * 2, "u string, v string"), least, first).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == links(members, set(edges), least, first)


def test_missing_links_of_a_large_pathway_need_no_pairs(spark):
    n, start = 50_000, time.time()
    members = spark.range(n).selectExpr("'p' AS pathway", "format_string('%06d', id) AS member")
    edges = spark.range(1, n).filter("id NOT IN (7, 49999)").selectExpr("'000000' AS u", "format_string('%06d', id) AS v")
    got = [tuple(r)[1:] for r in literature.missing_links(members, edges, first=4).orderBy("a", "b").collect()]
    assert got == [("000000", "000007"), ("000000", "049999"), ("000001", "000002"), ("000001", "000003")]
    assert time.time() - start < 90  # 1.2 billion pairs
