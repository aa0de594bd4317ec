"""Predictors, graph measures, sampling and metrics on small graphs with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import graph, metrics, predict, sampling


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "u string, v string")


def score(f, spark, edges, pair, **kw):
    return f(frame(spark, pair), graph.adjacency(frame(spark, *edges)), **kw).first()["score"]


def test_shared_neighbour_scores(spark):
    edges = [("a", "h"), ("b", "h"), ("a", "r"), ("b", "r"), ("h", "x"), ("h", "y")]
    assert score(predict.common_neighbours, spark, edges, ("a", "b")) == 2
    assert math.isclose(score(predict.adamic_adar, spark, edges, ("a", "b")), 1 / math.log(4) + 1 / math.log(2))
    assert score(predict.jaccard, spark, edges, ("a", "b")) == 1.0
    assert score(predict.preferential_attachment, spark, edges, ("a", "h")) == 8
    for p in (predict.common_neighbours, predict.adamic_adar, predict.jaccard, predict.preferential_attachment, predict.l3_paths):
        assert score(p, spark, edges, ("a", "nowhere")) == 0


def test_l3_walks_prefer_quiet_routes_and_skip_the_own_endpoint(spark):
    quiet = [("u", "a"), ("a", "b"), ("b", "v")]
    base = score(predict.l3_paths, spark, quiet, ("u", "v"))
    assert math.isclose(base, 0.5)
    assert score(predict.l3_paths, spark, [*quiet, ("b", "x"), ("b", "y")], ("u", "v")) < base
    assert score(predict.l3_paths, spark, [*quiet, ("u", "c"), ("c", "d"), ("d", "v")], ("u", "v")) > base
    assert score(predict.l3_paths, spark, [("u", "a"), ("a", "v")], ("u", "v")) == 0


def test_path_power_equals_the_dense_matrix_power(spark):
    import numpy as np

    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(9)]
    edges = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(14)})
    a = np.zeros((9, 9))
    for u, v in edges:
        a[nodes.index(u), nodes.index(v)] = a[nodes.index(v), nodes.index(u)] = 1
    s = np.diag(1 / np.sqrt(np.maximum(a.sum(1), 1)))
    want = np.linalg.matrix_power(s @ a @ s, 5)
    pairs = [(nodes[i], nodes[j]) for i in range(9) for j in range(i)]
    for r in predict.path_power(frame(spark, *pairs), graph.adjacency(frame(spark, *edges)), 5).collect():
        assert math.isclose(r["score"], want[nodes.index(r["u"]), nodes.index(r["v"])], abs_tol=1e-12)
    with pytest.raises(ValueError):
        predict.path_power(frame(spark, ("a", "b")), graph.adjacency(frame(spark, ("a", "b"))), 1)


def ranked(spark, pos, neg):
    return metrics.ranking(spark.createDataFrame([(float(s), True) for s in pos] + [(float(s), False) for s in neg], "score double, is_pos boolean"))


@pytest.mark.parametrize(("pos", "neg", "auc", "mrr"), [([3, 4], [1, 2], 1.0, 1.0), ([1], [2, 3], 0.0, 1 / 3), ([1, 1], [1, 1], 0.5, 1 / 3)])
def test_auc_and_pessimistic_ranks(spark, pos, neg, auc, mrr):
    r = ranked(spark, pos, neg).first()
    assert (r["auc"], r["mrr"]) == (auc, round(mrr, 6))


def test_metrics_of_nothing_do_not_fail(spark):
    empty = spark.createDataFrame([], "g string, score double, is_pos boolean")
    assert metrics.ranking(empty, "g").count() == 0
    assert metrics.average_precision(empty, "g").count() == 0


def test_average_precision_collapses_ties(spark):
    rows = [(0.9, True), (0.5, True), (0.5, False), (0.1, False)]
    ap = metrics.average_precision(spark.createDataFrame(rows, "score double, is_pos boolean")).first()["ap"]
    assert math.isclose(ap, 0.5 * 1 + 0.5 * 2 / 3, abs_tol=1e-6)


def test_bootstrap_interval_brackets_and_repeats(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(1, 1), True) for _ in range(80)] + [(rng.gauss(0, 1), False) for _ in range(80)]
    df = spark.createDataFrame(rows, "score double, is_pos boolean")
    auc, one, two = metrics.ranking(df).first()["auc"], metrics.bootstrap(df, resamples=80).first(), metrics.bootstrap(df, resamples=80).first()
    assert one == two and one["low"] < auc < one["high"]


def test_percentiles_share_ties_and_handle_empty_references(spark):
    q = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "score double")
    got = {r["score"]: r["pct"] for r in metrics.percentiles(q, spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "score double")).collect()}
    assert got == {1.0: 0.125, 2.0: 0.5, 9.0: 1.0}
    assert {r["pct"] for r in metrics.percentiles(q, q.limit(0)).collect()} == {0.0}


def test_negatives_are_typed_unknown_and_reproducible(spark):
    edges = [(f"g{i}", f"d{j}") for i in range(8) for j in range(8) if (i * j) % 3 == 0]
    pos = frame(spark, ("g1", "d1"), ("g2", "d2"), ("g4", "d5"))
    adj = graph.adjacency(frame(spark, *edges))
    known = frame(spark, *[tuple(sorted(e)) for e in edges], ("d1", "g1"))
    draw = lambda: sorted(map(tuple, sampling.negatives(pos, adj, known, lambda c: F.substring(c, 1, 1), 2, seed=5).collect()))
    got = draw()
    assert got and got == draw() and len(set(got)) == len(got) <= 6
    assert all(u[0] != v[0] and u < v for u, v in got) and not {tuple(sorted(e)) for e in edges} & set(got)


def test_components_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[202] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbourhood_reaches_hubs_without_crossing_them(spark):
    edges = [("s", "hub"), *[("hub", f"x{i}") for i in range(5)], ("s", "a"), ("a", "b")]
    seeds = spark.createDataFrame([("q", "s")], "seed_set string, node string")
    got = {r["node"]: r["hop"] for r in graph.neighbourhood(frame(spark, *edges), seeds, 2, cap=3).collect()}
    assert got == {"hub": 1, "a": 1, "b": 2}


def test_ancestors_are_nearest_first_and_cycles_end(spark):
    is_a = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "child string, parent string")
    got = {(r["child"], r["ancestor"]): r["step"] for r in graph.ancestors(is_a).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2}


def test_clustering_of_a_triangle_with_a_tail(spark):
    got = {r["node"]: r["coefficient"] for r in graph.clustering(graph.adjacency(frame(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")))).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3), "d": 0.0}


def test_candidates_exclude_known_unwanted_and_own_pairs(spark):
    adj = graph.adjacency(frame(spark, ("g1", "d1"), ("g2", "d1"), ("g2", "d2")))
    wanted = spark.createDataFrame([("d", "g")], "t1 string, t2 string")
    got = graph.candidates(adj, wanted, lambda c: F.substring(c, 1, 1), frame(spark, ("d1", "g1"), ("d1", "g2"), ("d2", "g2"))).collect()
    assert [tuple(r) for r in got] == [("d2", "g1")]  # d1 - g2 and d2 - g2 are edges, and so known


def test_degree_buckets(spark):
    x = spark.createDataFrame([(d,) for d in (0, 1, 2, 3, 4, 7, 8)], "d long").select(sampling.degree_bucket(F.col("d")).alias("b"))
    assert [r["b"] for r in x.collect()] == [0, 1, 2, 2, 3, 3, 4]
