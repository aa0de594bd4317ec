"""The language model learns from every window of every training text."""

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import lm_scoring
from weftgraph.llm.attention import Windows
from weftgraph.llm.shared import ship
from weftgraph.llm.token_counts import Automaton


def test_all_windows_of_all_texts_are_gathered(spark, monkeypatch):
    ship(spark)
    vocabulary = [bytes([i]) for i in range(256)]
    texts = [None, "", "a", "ab cd", "abcd " * 7, "xyz" * 40, "q" * 90_000, *(f"text {i} " * i for i in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared = spark.sparkContext.broadcast(Automaton(vocabulary))
    got = lm_scoring._gathered(docs, shared, np.arange(4), 258, 16).filter(F.col("kind") == lm_scoring.TRAIN).select("key", "n", "windows").toArrow()
    want = []
    for t in texts:
        ids = np.array([257, *((" " + " ".join(t.split())).encode() if t and t.split() else b""), 256])
        w = Windows(np.array([0, len(ids)]), 16)
        at = w.places(slice(None))
        want += [tuple(r) for r in np.where(at >= 0, ids[np.maximum(at, 0)], -1)]
    assert sum(got["n"].to_pylist()) == len(want)
    assert sorted(tuple(r) for r in lm_scoring._table(got, 16)) == sorted(want)
