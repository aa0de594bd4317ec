"""Similar names, links, mentions in sentences, novelty, passages, and the fixed values, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import discovery, ingest, linking, literature, score


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.75, 0.8, 0.9])
def test_similar_names_equal_all_pairs(spark, threshold):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14))) for _ in range(40)]
    near = []
    for x in base * 2:
        y = list(x)
        for _ in range(rng.randrange(3)):
            if y:
                y[rng.randrange(len(y))] = rng.choice(["", "x", "ab"])
        near.append("".join(y))
    want = {(a, b) for a in base for b in near if a == b or 1 - edits(a, b) / max(len(a), len(b)) >= threshold - 1e-9}
    left, right = spark.createDataFrame([(x,) for x in [*base, None]], "a string"), spark.createDataFrame([(x,) for x in [*near, None]], "b string")
    assert {(r["a"], r["b"]) for r in linking.similar_names(left, right, threshold).collect()} == want
    with pytest.raises(ValueError):
        linking.similar_names(left, right, 0.5)


def test_names_are_normalised_in_order(spark):
    rows = spark.createDataFrame([("  BRCA1  Gene!",), ("kinase protein x",), ("a-b, c",)], "t string").select(linking.normalised_name(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["brca1", "kinase  x", "a-b c"]


def test_disambiguation(spark):
    rows = [(1, "a", 1.0, 0.0), (2, "a", 0.95, 0.1), (3, "a", 0.86, 0.1), (4, "a", 0.9, 0.9), (4, "b", 0.95, 0.1), (5, "a", 0.9, 0.1), (5, "b", 0.9, 0.2)]
    got = {r[0]: tuple(r)[1:] for r in linking.disambiguate(spark.createDataFrame(rows, "mention_id int, entity_id string, similarity double, context double")).collect()}
    assert got == {1: ("a", 1.0, "EXACT"), 2: ("a", 0.95, "FUZZY"), 3: ("a", 0.86, "SEMANTIC"), 4: ("a", 0.9, "CONTEXTUAL"), 5: (None, 0.0, "CONFLICT")}


def test_sentences_that_mention_a_name(spark):
    text = "We saw FLT3-ITD in many of the cases. Short ITD. Here ITD stands alone, without its gene. The gene FLT3 itself is not enough here. An editdone word is none of them either."
    rows = spark.createDataFrame([(text, "FLT3 ITD"), (text, "a.b"), (text, " ")], "t string, n string")
    got = [r[0] for r in rows.select(discovery.sentences_mentioning(F.col("t"), F.col("n"))).collect()]
    assert got[0] == ["We saw FLT3-ITD in many of the cases.", "Here ITD stands alone, without its gene."] and got[1] == [] and not got[2]


def test_novelty_of_relations(spark):
    known = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "a")], "entity string, partner string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y"), ("a", "z"), ("z", "d")], "u string, v string")
    assert {(r["u"], r["v"]): r["novelty"] for r in discovery.novelty(pairs, known).collect()} == {("a", "b"): 0.0, ("b", "a"): 0.0, ("x", "y"): 0.5, ("a", "z"): 0.6, ("z", "d"): 0.55}


def test_passages_are_found_wherever_they_stand(spark):
    needles = [(1, "one two three four five six"), (2, "two three x"), (3, "a b c"), (4, "one two three four five six")]
    docs = [(1, "so one two three four five six."), (2, "xone two three four five sixy"), (3, "one two three  four five six"), (4, "za b cz"), (5, ""), (6, None), (7, "two three x")]
    got = literature.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(needles, "query_id long, needle string"))
    assert {tuple(r) for r in got.collect()} == {(q, d) for q, n in needles for d, t in docs if t and n in t}
    with pytest.raises(ValueError):
        literature.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "one two")], "query_id long, needle string"))


def test_moving_performance_is_the_fold(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.9 else "b", i * 97, rng.random() < 0.6, rng.random(), rng.random()) for i in range(300)]
    got = {r["agent"]: r for r in score.moving_performance(spark.createDataFrame(rows, "agent string, pos long, ok boolean, confidence double, took double")).collect()}
    for agent in "ab":
        success, seconds = 0.5, 0.0
        for _, _, ok, _, took in sorted((r for r in rows if r[0] == agent), key=lambda r: r[1]):
            success, seconds = 0.9 * success + 0.1 * ok, 0.9 * seconds + 0.1 * took
        assert got[agent]["success"] == pytest.approx(success) and got[agent]["seconds"] == pytest.approx(seconds)


def test_fixed_values():
    assert (len(score.PAIR_PRIORS), len(score.RELATION_FACTORS), len(ingest.PREDICATES), len(T.TRIGGERS), len(T.NEGATIONS), len(T.CONTRADICTIONS)) == (15, 7, 10, 34, 11, 14)
    assert ingest.PREDICATES["Predictive", "Reduced Sensitivity"] == ("RESISTANT_TO", "therapy") and score.PAIR_PRIORS["GENE", "DISEASE"] == 0.8


def test_relations_between_mentions(spark):
    def found(text, *spans):
        s = spark.createDataFrame([(1, 0, text)], "doc_id int, sentence int, text string")
        m = spark.createDataFrame([(1, 0, text.index(x), text.index(x) + len(x), x) for x in spans], "doc_id int, sentence int, start int, end int, text string")
        return [tuple(r)[2:] for r in literature.trigger_relations(s, m).collect()]

    assert found("BRCA1 mutations are associated with breast cancer", "BRCA1", "breast cancer") == [("BRCA1", "ASSOCIATED_WITH", "breast cancer", 0.75)]
    assert found("Melanoma was treated with vemurafenib", "Melanoma", "vemurafenib") == [("vemurafenib", "TREATS", "Melanoma", 0.75)]
    assert found("Imatinib failed to inhibit; it suppresses nothing of KIT", "Imatinib", "KIT") == []
    assert found("The drug A, long after all of the many other things were said, inhibits B", "A", "B")[0][3] == 0.55
