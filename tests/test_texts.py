"""Text expressions, mentions, relations, retrieval, scores and streams."""

import math

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import literature, retrieve, score
from weftgraph.streaming import streams


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first()["x"]


def test_sentences_keep_abbreviations_and_numbers(spark):
    got = one(spark, T.sentences(F.col("t")), "Smith et al. found 3.5 mg. It works! Does it? See Fig. 2.")
    assert got == ["Smith et al. found 3.5 mg.", "It works!", "Does it?", "See Fig. 2."]
    assert one(spark, T.sentences(F.col("t")), "") == []


def test_chunks_overlap_by_whole_sentences_and_lose_none(spark):
    text = " ".join(f"Sentence number {i} has six words." for i in range(20))
    chunks = one(spark, T.pack_sentences(T.sentences(F.col("t")), 30, 10), text)
    assert len(chunks) > 3 and all(f"number {i} " in " ".join(chunks) for i in range(20))
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(chunks, chunks[1:], strict=False))
    assert one(spark, T.pack_sentences(T.sentences(F.col("t")), 30, 10), "") == []
    assert one(spark, T.pack_sentences(T.sentences(F.col("t")), 5, 2), "one two three four five six seven eight.") == ["one two three four five six seven eight."]


def test_similarities(spark):
    both = spark.createDataFrame([("abc", "abd"), ("", "")], "a string, b string")
    got = both.select(T.levenshtein_similarity(F.col("a"), F.col("b")).alias("l"), T.set_jaccard(T.char_bigrams(F.col("a")), T.char_bigrams(F.col("b"))).alias("j")).collect()
    assert got[0]["l"] == pytest.approx(2 / 3) and got[0]["j"] == pytest.approx(1 / 3) and (got[1]["l"], got[1]["j"]) == (1.0, 1.0)
    assert one(spark, T.token_estimate(F.col("t")), "a b  c") == 4 and one(spark, T.token_estimate(F.col("t")), "  ") == 1


def test_token_offsets_cut_the_words_back_out(spark):
    docs = spark.createDataFrame([(1, "Été, BRAF-V600  x_1."), (2, ""), (3, None)], "doc_id long, text string")
    rows = literature.tokens(docs).join(docs, "doc_id").collect()
    assert sorted(r["token"] for r in rows) == ["BRAF", "V600", "x_1", "Été"]
    assert all(r["text"][r["start"] : r["end"]] == r["token"] for r in rows)


def test_aliases_take_the_longest_leftmost_whole_words(spark):
    docs = spark.createDataFrame([(1, "Breast cancer, not cancerous; BREAST  Cancer type 2 diabetes")], "doc_id long, text string")
    aliases = spark.createDataFrame([("breast cancer", "B"), ("cancer", "C"), ("cancer type", "T"), ("type 2 diabetes", "D"), ("2", "no"), ("breast cancer", "B2")], "alias string, node_id string")
    got = sorted((r["start"], r["node_id"]) for r in literature.alias_mentions(docs, aliases).collect())
    assert got == [(0, "B"), (0, "B2"), (30, "B"), (30, "B2"), (45, "D")]


def test_trigger_relations(spark):
    s = spark.createDataFrame([(1, 0, "X is treated with Y"), (1, 1, "X does not treats Y"), (1, 2, "X another activates Y"), (1, 3, "X near Y")], "doc_id long, sentence int, text string")
    m = spark.createDataFrame([(1, k, a, b, t) for k, n in enumerate((19, 19, 21, 8)) for a, b, t in ((0, 1, "X"), (n - 1, n, "Y"))], "doc_id long, sentence int, start int, end int, text string")
    got = sorted((r["sentence"], r["subject"], r["predicate"], r["object"]) for r in literature.trigger_relations(s, m).collect())
    assert got == [(0, "Y", "TREATS", "X")]  # a cue is found within words too: "another" holds "not"


def test_sections_before_the_first_header_have_none(spark):
    docs = spark.createDataFrame([(1, "intro text\nMethods: we\nmore\nResults\nx")], "doc_id long, text string")
    got = [r["section"] for r in literature.sections(docs, T.SECTIONS).orderBy("pos").collect()]
    assert got == [None, "methods", "methods", "results", "results"]


def test_cooccurrence_counts_mention_pairs(spark):
    m = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")], "doc_id long, term string")
    assert sorted((r["a"], r["b"], r["n"]) for r in literature.cooccurrence(m, 1).collect()) == [("a", "a", 1), ("a", "b", 3)]


def test_retrieval_metrics_of_a_known_ranking(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], "query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 11), (1, 99), (2, 77)], "query_id long, doc_id long")
    r = retrieve.evaluate(ranked, qrels, 3).first()
    assert (r["queries"], r["recall"], r["mrr"], r["hit_rate"]) == (2, 0.25, 0.25, 0.5)
    assert r["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 2, abs=1e-6)


def test_fusion_prefers_agreement_then_the_first_list(spark):
    x = spark.createDataFrame([(0, 1, 1, "a"), (0, 1, 2, "b"), (1, 1, 1, "c"), (1, 1, 2, "b")], "list int, query_id long, rank int, doc_id string")
    assert [r["doc_id"] for r in retrieve.fuse(x, 3).orderBy("rank").collect()] == ["b", "a", "c"]


def test_weighted_scores_skip_missing_parts(spark):
    x = spark.createDataFrame([(1.0, None), (None, None), (0.5, 1.0)], "a double, b double").select(score.weighted({"a": 0.75, "b": 0.25}).alias("s"))
    assert [r["s"] for r in x.collect()] == [1.0, None, 0.625]


def test_moving_performance_folds_in_order(spark):
    x = spark.createDataFrame([("a", 2, False, 1.0, 0.0), ("a", 1, True, 1.0, 0.0)], "agent string, pos long, ok boolean, confidence double, took double")
    assert score.moving_performance(x).first()["success"] == pytest.approx((0.5 * 0.9 + 0.1) * 0.9)


def test_uncertainty_of_agreeing_members_is_aleatoric(spark):
    x = spark.createDataFrame([(1, m, c, p) for m in (0, 1) for c, p in (("x", 1.0), ("y", 3.0))] + [(2, m, c, float(m == int(c))) for m in (0, 1) for c in ("0", "1")], "item long, member int, class string, p double")
    got = {r["item"]: r for r in score.uncertainty(x).collect()}
    assert got[1]["epistemic"] == pytest.approx(0, abs=1e-9) and got[2]["aleatoric"] == pytest.approx(0, abs=1e-6) and got[2]["epistemic"] == pytest.approx(math.log(2), abs=1e-6)


def test_stream_distinct_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 9}:00:00", i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "t string, k int").select(F.col("t").cast("timestamp").alias("ts"), "k")
    df.write.parquet(str(tmp_path / "in"))
    out = streams.run_available(streams.distinct(streams.read(spark, str(tmp_path / "in"), df.schema), ["k"], "1 day"))
    assert sorted(r["k"] for r in out.collect()) == [0, 1, 2]


def test_cache_computes_each_key_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    for keys in (["a", "b", "a"], ["b", "c"]):
        streams.cached(spark.createDataFrame([(k,) for k in keys], "k string"), 0, path, "k", F.upper)
    assert sorted((r["k"], r["value"]) for r in spark.read.parquet(path).collect()) == [("a", "A"), ("b", "B"), ("c", "C")]
