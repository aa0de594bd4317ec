"""The language model's shortcuts: smaller vectors and tables, the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import attention, lm_scoring, textkit
from weftgraph.llm.shared import ship
from weftgraph.llm.token_counts import Automaton


def test_fit_is_adam_and_holds_the_embeddings_that_occur():
    rng = np.random.default_rng(3)
    counts = np.arange(40, 0, -1)
    make = lambda: attention.AttentionLM(counts, np.arange(40) % 2 == 0, None, size=4, dim=4, rows=4096, own=6, clusters=2)
    windows = rng.integers(0, 12, (50, 9)).astype(np.int32)
    windows[::7, :4], windows[::5, 6:] = -1, -1
    order = rng.permutation(50)
    fitted, plain = make().fit(windows, order, 1e-2, warm=3, batch=16), make()
    m1, m2 = ({k: np.zeros(v.shape) for k, v in plain.p.items()} for _ in range(2))
    for step in range(1, 5):
        lr = 1e-2 * min(1, step / 3) * (1 - 0.9 * step / 4)
        for k, g in plain._gradient(windows[order[(step - 1) * 16 : step * 16]]).items():
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.99 * m2[k] + 0.01 * g.astype(float) ** 2
            plain.p[k] = (plain.p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    assert fitted.flat() == pytest.approx(plain.flat(), abs=1e-4)
    apart = np.setdiff1d(np.arange(4096), fitted.row[:12])
    assert (fitted.p["E"][apart] == make().p["E"][apart]).all()
    assert attention._Fit(fitted, windows).flat.size < 1000


def test_word_hashes_equal_span_hashes():
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b"abcxyz\xc3\xa9  \t\n", np.uint8), 20_000)
    words = textkit.Words(data, np.array([0, 0, 17, 9000, 9000, 20_000]))
    want = textkit.span_hashes(data, words.start, words.end)
    assert (textkit.word_hashes(words) == want).all() and (textkit.word_hashes(words, limit=10) == want).all()
    assert not len(textkit.word_hashes(textkit.Words(data[:0], np.array([0, 0]))))


def test_runs_take_two_bytes_an_id_and_rows_alike_give_one(spark):
    ship(spark)
    vocabulary = [bytes([i]) for i in range(256)]
    docs = spark.createDataFrame([(1, "abc " * 300)] * 50 + [(None, "de " * 200)] * 50, "doc_id long, text string").coalesce(1)
    shared = spark.sparkContext.broadcast(Automaton(vocabulary))
    got = lm_scoring._gathered(docs, shared, np.arange(4), 258, 16).filter(F.col("kind") == lm_scoring.TRAIN).toArrow()
    assert len(got) == 2  # of 1202 and 602 ids, after 16 places without one
    assert sorted(len(w) for w in got["windows"].to_pylist()) == [1 + 2 * (16 + 602), 1 + 2 * (16 + 1202)]
    twice = got.select(["key", "n", "windows"])
    assert (lm_scoring._table(twice.take([0, 1, 0]), 16) == lm_scoring._table(twice, 16)).all()
    wide = lm_scoring._gathered(docs, shared, np.arange(4), 70_000, 16).filter(F.col("kind") == lm_scoring.TRAIN).select("key", "n", "windows").toArrow()
    narrow, wide = lm_scoring._table(twice, 16), lm_scoring._table(wide, 16)
    named = narrow >= 256  # the end and the beginning are the last two ids
    assert (np.where(named, narrow + 70_000 - 258, narrow) == wide).all()
