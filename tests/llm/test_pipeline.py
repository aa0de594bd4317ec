"""The pipeline: each stage and the whole against brute force, on a small corpus with nulls and repeats."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "every morning the old baker walks slowly across the bridge to buy fresh white flour for the whole village"


def words(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [[i, text(rng.randrange(20, 60)), "en", rng.choice(["a", "b", "c", None]), 0] for i in range(240)]
    toxic = set(range(0, 120, 4))
    for i in toxic:
        w = rows[i][1].split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["scumxx", "idiotxx", "moronxx"]))
        rows[i][1] = " ".join(w)
    passage = text(55)
    for i in (130, 131, 132):
        rows[i][1] += "\n" + passage  # a repeated line of over 50 words
    for i, j in ((140, 141), (140, 142), (150, 151)):
        rows[j][1] = rows[i][1] + " " + word()  # near copies
    rows[160][1] = rows[161][1]
    rows[170][1] += " " + ITEM
    rows += [[None, rows[180][1], "en", "a", 0], [None, rows[180][1], "en", "b", 0], [None, text(30) + " end", None, None, 0], [None, None, "en", "a", 0], [500, None, None, "b", 0], [501, "", "en", "c", 0]]
    same = text(40)
    rows += [[None, same, "en", "a", 0], [None, same + " more", "en", "b", 0], [600, text(40), "en", "a", 1], [600, rows[-1][1], "en", "b", 2]]
    rows.append(list(rows[5]))
    return [tuple(r) for r in rows], toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows, toxic = corpus()
    spark.createDataFrame(rows, DOCS).withColumn("_id", F.lit(1)).withColumn("_key", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def near_classes(rows):
    """Texts of each class of a similarity of 0.8 or more, closed over links."""
    texts = sorted({r[1] for r in rows if words(r[1])})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    sets = {t: grams(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return {t: find(t) for t in texts}


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    _, toxic = corpus()
    for name, stage in P.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = P.stored(stage(spark, docs, folder))
        assert out.columns == docs.columns
        after = [tuple(r) for r in out.collect()]
        if name == "toxicity":
            assert Counter(before) - Counter(after) == Counter(r for r in before if r[0] in toxic)  # the clean ones all stay
        elif name == "line_dedup":
            first, gone = set(), {}
            for r in sorted(before, key=lambda r: (r[0] is not None, r[0] or 0)):
                for line in {x for x in (r[1] or "").split("\n") if len(x.split()) >= 50}:
                    if line in first:
                        gone[r[0]] = line
                    first.add(line)
            want = Counter()
            for r in before:
                text = r[1] if r[0] not in gone else "\n".join(x for x in r[1].split("\n") if x != gone[r[0]])
                want[(r[0], text, *r[2:4], len(text) if r[0] in gone else r[4], *r[5:])] += 1
            assert gone and Counter(after) == want
        elif name == "ngram_jaccard_join":
            group = near_classes(before)
            of = lambda r: group.get(r[1])
            sizes = Counter(of(r) for r in before if of(r) is not None)
            assert Counter(of(r) for r in after if of(r) is not None) == Counter(dict.fromkeys(sizes, 1))  # one of each class
            best = {c: min((r[0] is None, r[0] or 0) for r in before if of(r) == c) for c in sizes}
            assert all((r[0] is None, r[0] or 0) == best[of(r)] for r in after if of(r) is not None)
            assert Counter(r for r in before if of(r) is None) == Counter(r for r in after if of(r) is None)  # texts without words
        else:
            assert Counter(before) - Counter(after) == Counter(r for r in before if ITEM in (r[1] or "")) and len(after) < len(before)
        docs = out
    want = Counter((r["doc_id"], r["size"]) for r in P.STAGES[-1][1](spark, docs, folder).collect())
    assert want == Counter((r["doc_id"], len(words(r["text"]))) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"]) for r in P.run(spark, folder).collect()) == want


def test_stages_of_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("1 = 0")
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
