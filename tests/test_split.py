"""Temporal split: leakage, cold starts, direction, undated pairs, evidence."""

import math

from pyspark.sql import functions as F

from weftgraph.operators import split

SCHEMA = "subject string, object string, year int, predicate string, confidence double, negated boolean"


def asserted(spark, *rows):
    return spark.createDataFrame([(*r, "P", 1.0, False) if len(r) == 3 else r for r in rows], SCHEMA)


def fixed(spark, *rows):
    return spark.createDataFrame(list(rows), "u string, v string")


def roles(df):
    return {(r["u"], r["v"]): r["role"] for r in df.collect()}


def test_pair_asserted_on_both_sides_of_the_cutoff_trains(spark):
    a = asserted(spark, ("a", "b", 2010), ("a", "b", 2020), ("c", "d", 2020))
    assert roles(split.temporal_split(a, fixed(spark), 2015)) == {("a", "b"): "train", ("c", "d"): "cold"}


def test_backbone_pairs_are_known_not_test(spark):
    a = asserted(spark, ("a", "b", 2020), ("a", "c", 2010), ("b", "c", 2010))
    assert roles(split.temporal_split(a, fixed(spark, ("b", "a")), 2015))[("a", "b")] == "known"


def test_cold_start_undated_loops_and_direction(spark):
    a = asserted(spark, ("b", "a", 2010), ("a", "b", 2011), ("a", "a", 2010), ("a", "c", None), ("c", "b", 2020), ("y", "z", 2020), ("d", "e", 2020), ("d", "e", 2001))
    got = roles(split.temporal_split(a, fixed(spark), 2015))
    assert got == {("a", "b"): "train", ("a", "c"): "backbone", ("b", "c"): "test", ("y", "z"): "cold", ("d", "e"): "train"}


def test_cutoff_year_itself_is_tested(spark):
    a = asserted(spark, ("a", "b", 2014), ("b", "c", 2014), ("a", "c", 2015))
    assert roles(split.temporal_split(a, fixed(spark), 2015))[("a", "c")] == "test"


def test_evidence_ignores_later_years_and_falls_with_negation(spark):
    rows = [("a", "b", 2010, "X", 0.8, False), ("a", "b", 2011, "Y", 0.6, False), ("b", "a", 2012, "Y", 0.6, True), ("a", "b", 2020, "Z", 1.0, False)]
    e = split.evidence(asserted(spark, *rows), 2015).first()
    assert (e["support"], e["negated_count"], e["dominant_predicate"]) == (3, 1, "Y")
    assert math.isclose(e["weight"], (2.0 / 3) * math.log(4) * (1 - 0.5 / 3))


def test_year_distribution_counts_pairs_once(spark):
    a = asserted(spark, *[("a", "b", 2010)] * 10, ("c", "d", 2011))
    assert [tuple(r) for r in split.year_distribution(a).orderBy("year").collect()] == [(2010, 1, 1), (2011, 1, 2)]


def test_leakage_guard_is_free_of_orientation(spark):
    got = split.drop_leaked(fixed(spark, ("b", "a"), ("a", "c"), ("a", "a")), fixed(spark, ("a", "b"))).orderBy("v").collect()
    assert [tuple(r) for r in got] == [("a", "b", True), ("a", "c", False)]


def test_validation_slice_takes_the_latest_share(spark):
    train = spark.createDataFrame([(f"n{i:02d}", "z", 2000 + i // 4) for i in range(20)] + [("u", "z", None)], "u string, v string, first_year int")
    got = split.validation_slice(train, 0.15).filter(F.col("slice") == "validate").orderBy("u").collect()
    assert [r["u"] for r in got] == ["n16", "n17", "n18"]


def test_empty_input_gives_no_pairs(spark):
    assert split.temporal_split(asserted(spark), fixed(spark), 2015).count() == 0
