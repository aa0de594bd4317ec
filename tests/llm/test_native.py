"""Line dedup and mixing, against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.llm.line_dedup import line_dedup
from weftgraph.llm.mixing import mix_sources

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(docs, least):
    """Line numbers to delete: every run of enough words that occurred before, by (id, line)."""
    rows = {}
    for d, text in sorted(docs):
        rows[d] = [(i, x.replace("\r", "").strip(" ")) for i, x in enumerate((text or "").split("\n"))]
        rows[d] = [x for x in rows[d] if x[1]]
    seen, gone = set(), defaultdict(set)
    for d, _ in sorted(docs):
        for a in range(len(rows[d])):
            for b in range(a, len(rows[d])):
                run = tuple(x[1] for x in rows[d][a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[d] |= set(range(rows[d][a][0], rows[d][b][0] + 1))
                    seen.add(run)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["a b c", "d e", "f", "g h i j", "k l", "", " m n ", "o\r"]
    docs = [(i, "\n".join(rng.choice(lines[: rng.choice([3, 8])]) for _ in range(rng.choice([0, 1, 5, 14])))) for i in range(16)]
    docs += [(100 + i, docs[rng.randrange(16)][1]) for i in range(5)]
    want = brute_lines(docs, 5)
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()}
    for d, text in docs:
        assert got[d]["text"] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[d])
        assert got[d]["n_removed"] == len(want[d])


def test_line_dedup_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "x"), (1, long, "y"), (2, long, "z"), (None, long + "\nend", "n"), (3, None, "q"), (4, "", "q"), (5, long + "\n\n" + long, "s")]
    got = {(r["doc_id"], r["runs2"]): (r["text"], r["n_removed"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, runs2 string")).collect()}
    assert got[(None, "n")] == (long + "\nend", 0) and got[(1, "x")] == got[(1, "y")] == ("", 1) and got[(2, "z")] == ("", 1)
    assert got[(3, "q")] == (None, 0) and got[(4, "q")] == ("", 0) and got[(5, "s")] == ("", 2)
    empty = line_dedup(spark.createDataFrame([], "doc_id long, text string, runs string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_lines", "n_removed", "runs"]


def targets(docs):
    """Targets by repeated dealing, as the definition has it."""
    size = Counter()
    for _, text, _, source, _ in docs:
        size[source] += len([w for w in re.split("[ \t-\r]+", text or "") if w])
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, target, open_ = 1.5 * sum(size.values()), dict.fromkeys(order, 0.0), list(order)
    while open_ and goal > 1e-9:
        share, goal = {s: goal * weight[s] / sum(weight[x] for x in open_) for s in open_}, 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * size[s]:
                goal += target[s] - 2 * size[s]
                target[s] = 2 * size[s]
                open_.remove(s)
    return size, target


def test_mixing_meets_targets_and_repeats(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(900)]
    docs += [(900, None, None, "e", 0), (901, "one two\u00a0three\tfour", None, "b", 0), (902, "x", "en", "a", 0), (902, "x", "en", "a", 0)]
    df = spark.createDataFrame(docs, DOCS).withColumn("size", F.lit("clash"))
    size, target = targets(docs)
    one = mix_sources(df).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, mix_sources(df.repartition(3)).collect()))
    taken = Counter()
    for r in one:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    assert len(one) == len(docs) and all(abs(taken[s] - target[s]) <= 2 for s in size)
    assert next(r["size"] for r in one if r["doc_id"] == 901) == 3  # a no-break space is not ASCII white space
    rate = {r["doc_id"]: r for r in one}
    assert rate[900]["copies"] == 1 and rate[900]["taken"] == 0


def test_mixing_of_no_documents(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
