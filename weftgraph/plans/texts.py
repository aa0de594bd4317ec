"""Text, retrieval, pattern and score operators on documents, embeddings and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, literature, metrics, resolve, retrieve, sampling, score
from ..sources.tables import main_lines, table
from .links import MAIN

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _masked(c: str) -> str:
    for a in T.ABBREVIATIONS:
        c = f"replace({c}, '{a}', '{a.replace('.', chr(1))}')"
    return c


_SENT = f"list_filter(list_transform(string_split(regexp_replace({_masked('text')}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("""WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
  l AS (SELECT doc_id, pos, ['', 'Abstract', '', 'INTRODUCTION ', 'methods: ', '  MATERIALS AND METHODS', 'Results. ', '', 'CONCLUSIONS ', 'References', 'Acknowledgments '][(doc_id + pos) % 11 + 1] || line AS line FROM l0),
  h AS (SELECT *, nullif(lower(regexp_extract(line, '^\\s*(ACKNOWLEDGMENTS|Acknowledgments|MATERIALS AND METHODS|INTRODUCTION|Introduction|CONCLUSIONS|DISCUSSION|Discussion|CONCLUSION|Conclusion|REFERENCES|References|ABSTRACT|Abstract|METHODS|Methods|RESULTS|Results)', 1)), '') AS header FROM l),
  s AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM h) SELECT doc_id, section, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM s GROUP BY 1, 2""")
def section_labels(spark, d):
    """Documents with a header, or none, put before each line in turn, as the invented prose has none."""
    heads = F.array(*[F.lit(h) for h in ("", "Abstract", "", "INTRODUCTION ", "methods: ", "  MATERIALS AND METHODS", "Results. ", "", "CONCLUSIONS ", "References", "Acknowledgments ")])
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.get(heads, ((F.col("doc_id") + i) % 11).cast("int")), x)), "\n")
    x = literature.sections(table(spark, d, "documents").select("doc_id", text.alias("text")), T.SECTIONS)
    return x.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("""WITH x AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 2))) AS a, list_distinct(list_transform(range(1, length(p_brand || p_type)), lambda i: substr(lower(p_brand || p_type), i, 2))) AS b FROM part)
  SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM x""")
def char_bigram_jaccard(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(T.set_jaccard(T.char_bigrams(F.col("p_name")), T.char_bigrams(F.concat("p_brand", "p_type"))), 6).alias("jaccard"))


@query("SELECT doc_id, (floor(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) * 1.3) + 1)::INTEGER AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query()
def sentence_chunks(spark, d):
    x = table(spark, d, "documents").select("doc_id", T.pack_sentences(T.sentences(F.col("text")), 200, 40).alias("c"))
    return x.select("doc_id", F.posexplode("c").alias("chunk_id", "text"))


@query("SELECT doc_id, t AS text, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS t FROM documents) WHERE regexp_full_match(t, '[A-Z][A-Z0-9]{2,9}') AND t NOT IN ('" + "', '".join(T.NOT_GENES) + "') GROUP BY 1, 2")
def gene_mentions(spark, d):
    return literature.gene_mentions(table(spark, d, "documents")).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, count(*) AS n, sum(strlen(t) - strlen(t) + length(t))::BIGINT AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS t FROM documents) GROUP BY 1")
def word_offsets(spark, d):
    """Words by offsets; the span's length and the text cut at it must agree."""
    x = literature.tokens(table(spark, d, "documents").select("doc_id", "text"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


_PHRASES = (*[t for t, _, _ in T.TRIGGERS], "is not treated with", "near", "responds to and treats", "causes, rather than")

#: What each phrase is to give, written out apart from the operator's table.
_EXPECTED = """(VALUES (0, 'TREATS', 1), (1, 'TREATS', 1), (2, 'TREATS', 1), (3, 'SENSITIZES_TO', 0), (4, 'RESISTANT_TO', 0), (5, 'TREATS', 0), (6, 'TREATS', 0), (7, 'TREATS', 0), (8, 'INHIBITS', 0), (9, 'INHIBITS', 0), (10, 'INHIBITS', 0), (11, 'INHIBITS', 0),
  (12, 'ACTIVATES', 0), (13, 'ACTIVATES', 0), (14, 'ACTIVATES', 0), (15, 'CAUSES', 0), (16, 'CAUSES', 0), (17, 'CAUSES', 0), (18, 'CAUSES', 0), (19, 'CAUSES', 0), (20, 'CAUSES', 0), (21, 'MUTATED_IN', 0), (22, 'MUTATED_IN', 1), (23, 'EXPRESSED_IN', 0), (24, 'EXPRESSED_IN', 0),
  (25, 'INTERACTS_WITH', 0), (26, 'INTERACTS_WITH', 0), (27, 'ASSOCIATED_WITH', 0), (28, 'ASSOCIATED_WITH', 0), (29, 'ASSOCIATED_WITH', 0), (30, 'ASSOCIATED_WITH', 0), (31, 'ASSOCIATED_WITH', 0), (32, 'PREDICTS', 0), (33, 'PREDICTS', 0), (36, 'TREATS', 1)) AS w(k, predicate, swap)"""


@query(f"""WITH x AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS doc_id, p_name AS a, 'S' || l_suppkey AS b, (l_orderkey + l_linenumber) % 38 AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT DISTINCT doc_id, CASE WHEN swap = 1 THEN b ELSE a END AS subject, predicate, CASE WHEN swap = 1 THEN a ELSE b END AS object, 0.75::DOUBLE AS confidence FROM x JOIN {_EXPECTED} USING (k)""")
def trigger_relations(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 38 + 1).cast("int"))
    b = F.concat(F.lit("S"), "l_suppkey")
    x = x.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("doc_id"), F.lit(0).alias("sentence"), F.col("p_name").alias("a"), b.alias("b"), F.concat_ws(" ", "p_name", p, b).alias("text")).distinct()
    n = F.length("text")
    spans = F.array(F.struct(F.lit(0).alias("start"), F.length("a").alias("end"), F.col("a").alias("text")), F.struct((n - F.length("b")).alias("start"), n.alias("end"), F.col("b").alias("text")))
    mentions = x.select("doc_id", "sentence", F.explode(spans).alias("m")).select("doc_id", "sentence", "m.*")
    return literature.trigger_relations(x.select("doc_id", "sentence", "text"), mentions).select("doc_id", "subject", "predicate", "object", F.col("confidence").cast("double"))


@query("""WITH n AS (SELECT l_orderkey AS doc_id, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT doc_id, 'N:' || p_name AS node_id, count(*) AS n FROM n GROUP BY 1, 2""")
def alias_mentions(spark, d):
    part = table(spark, d, "part")
    x = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    docs = x.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(F.upper("p_name"))), " and; ").alias("text"))
    names = part.select(F.col("p_name").alias("alias"), F.concat(F.lit("N:"), "p_name").alias("node_id")).distinct()
    single = part.select(F.element_at(F.split("p_name", " "), -1).alias("alias")).distinct().select("alias", F.concat(F.lit("W:"), "alias").alias("node_id"))
    return literature.alias_mentions(docs, names.unionByName(single)).groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, trim(regexp_replace(substr(text, 21, 180), '\\s+', ' ', 'g')) AS context FROM documents")
def context_window(spark, d):
    return table(spark, d, "documents").select("doc_id", T.context_window(F.col("text"), F.lit(120), F.lit(100), 100).alias("context"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-]{2,}')) AS w, unnest(range(0, len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-]{2,}')))) AS i FROM documents),
  f AS (SELECT doc_id, lower(w) AS w, min(i) AS i FROM w WHERE lower(w) NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'may', 'are', 'was', 'were', 'have', 'has', 'from', 'into', 'than', 'then', 'its', 'increase', 'increases', 'decrease', 'decreases', 'contributes') GROUP BY 1, 2) SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY i)) AS terms FROM f GROUP BY 1""")
def hypothesis_terms(spark, d):
    """Distinct terms in order of first occurrence, stop words dropped."""
    x = table(spark, d, "documents").select("doc_id", F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9][a-z0-9\\-]{2,})"), 1), lambda w: ~w.isin(*T.STOP_WORDS))).alias("t"))
    return x.filter(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("terms"))


_AGAINST = ("no association", "not associated", "no significant", "not significant", "failed to", "did not", "no evidence", "no correlation", "contrary to", "refute", "contradict", "unable to replicate", "no effect", "absence of")


@query("SELECT doc_id, NOT (" + " OR ".join(f"contains(low, '{c}')" for c in _AGAINST) + ") AS supports, round((contains(low, 'the')::INT + contains(low, 'der')::INT + contains(low, 'que')::INT) / 3, 6) AS relevance FROM (SELECT doc_id, lower(text) || [" + ", ".join(f"' {c}'" for c in ("", *_AGAINST)) + "][doc_id % 15 + 1] AS low FROM documents)")
def support_classification(spark, d):
    """Documents with one of the phrases, or none, added in turn, as the invented prose has none."""
    ends = F.element_at(F.array(F.lit(""), *[F.lit(c) for c in T.CONTRADICTIONS]), (F.col("doc_id") % 15 + 1).cast("int"))
    low = F.concat(F.lower("text"), F.lit(" "), ends)
    terms = F.array(*[F.lit(t) for t in ("the", "der", "que")])
    cues = F.array(*[F.lit(t) for t in T.CONTRADICTIONS])
    return table(spark, d, "documents").select("doc_id", (~F.exists(cues, lambda c: F.contains(low, c))).alias("supports"), F.round(F.size(F.filter(terms, lambda t: F.contains(low, t))) / 3, 6).alias("relevance"))


@query("""WITH p AS (SELECT p_partkey AS pair, p_name || ' ' || p_type AS a, p_brand || ' ' || p_name AS b FROM part), w AS (SELECT pair, regexp_extract_all(lower(a), '[a-z0-9_]{2,}') AS wa, regexp_extract_all(lower(b), '[a-z0-9_]{2,}') AS wb FROM p),
  t AS (SELECT pair, unnest(list_concat(wa, list_transform(range(1, len(wa)), lambda i: wa[i] || ' ' || wa[i + 1]))) AS t, 1 AS na, 0 AS nb FROM w UNION ALL SELECT pair, unnest(list_concat(wb, list_transform(range(1, len(wb)), lambda i: wb[i] || ' ' || wb[i + 1]))), 0, 1 FROM w),
  f AS (SELECT pair, t, sum(na) AS na, sum(nb) AS nb, ln(3 / (1 + (sum(na) > 0)::INT + (sum(nb) > 0)::INT)) + 1 AS idf FROM t GROUP BY 1, 2) SELECT pair, round(sum(na * nb * idf * idf) / sqrt(sum(na * na * idf * idf) * sum(nb * nb * idf * idf)), 6) AS cosine FROM f GROUP BY pair""")
def tfidf_cosine(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pair"), F.concat_ws(" ", "p_name", "p_type").alias("a"), F.concat_ws(" ", "p_brand", "p_name").alias("b"))
    return literature.tfidf_cosine(p).withColumn("cosine", F.round("cosine", 6))


@query("""WITH m AS (SELECT o_custkey AS doc_id, p_type AS term, row_number() OVER () AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
  SELECT least(a.term, b.term) AS a, greatest(a.term, b.term) AS b, count(*) AS n, least(count(*) / 10, 1.0)::DOUBLE AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return literature.cooccurrence(x.select(F.col("o_custkey").alias("doc_id"), F.col("p_type").alias("term")))


_PAPERS = "m AS (SELECT DISTINCT l_orderkey AS paper, unnest(['P:' || p_brand, 'T:' || p_type]) AS term FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_PAPERS} SELECT a.term AS a, b.term AS b, count(*) AS n FROM m a JOIN m b ON a.paper = b.paper AND a.term < b.term AND substr(a.term, 1, 1) <> substr(b.term, 1, 1) GROUP BY 1, 2 HAVING count(*) >= 3")
def cooccurrence_patterns(spark, d):
    """Terms of different types in at least three common papers."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = x.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(F.concat(F.lit("P:"), "p_brand"), F.concat(F.lit("T:"), "p_type"))).alias("term")).distinct()
    return literature.cooccurrence(m, 3).filter(F.substring("a", 1, 1) != F.substring("b", 1, 1)).select("a", "b", "n")


_TERMS = "t AS (SELECT DISTINCT p_partkey AS entity, unnest(string_split(p_name, ' ')) AS term FROM part UNION SELECT p_partkey, p_brand FROM part)"


@query(f"""WITH {_TERMS}, b AS (SELECT a.entity AS a, b.entity AS b, string_agg(a.term, ' ' ORDER BY a.term) AS context FROM t a JOIN t b ON a.term = b.term AND a.entity < b.entity WHERE length(a.term) > 2 GROUP BY 1, 2)
  SELECT context, count(*) AS n_pairs, round(least(count(*) / 3, 1), 6)::DOUBLE AS strength FROM b GROUP BY 1 HAVING count(*) >= 2""")
def shared_context_patterns(spark, d):
    p = table(spark, d, "part")
    t = p.select(F.col("p_partkey").alias("entity"), F.explode(F.concat(F.split("p_name", " "), F.array("p_brand"))).alias("term"))
    return literature.shared_context_patterns(t)


@query("""WITH m AS (SELECT DISTINCT p_brand AS pathway, 'P' || p_partkey AS member FROM part), e AS (SELECT DISTINCT 'P' || a.l_partkey AS u, 'P' || b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
  n AS (SELECT pathway FROM m GROUP BY 1 HAVING count(*) >= 3) SELECT pathway, a, b FROM (SELECT x.pathway, x.member AS a, y.member AS b, row_number() OVER (PARTITION BY x.pathway ORDER BY x.member, y.member) AS r FROM m x JOIN m y ON x.pathway = y.pathway AND x.member < y.member WHERE x.pathway IN (FROM n) AND (x.member, y.member) NOT IN (SELECT u, v FROM e)) WHERE r <= 10""")
def pathway_missing_links(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("pathway"), F.concat(F.lit("P"), "p_partkey").alias("member"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    later = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))
    e = x.alias("a").join(x.alias("b"), later).select(F.concat(F.lit("P"), "a.l_partkey").alias("u"), F.concat(F.lit("P"), "b.l_partkey").alias("v"))
    return literature.missing_links(m, e)


@query("SELECT user_id AS entity, count(DISTINCT day(ts) // 5) AS windows, (min(day(ts) // 5) * 5)::INTEGER AS first, (max(day(ts) // 5) * 5)::INTEGER AS last FROM events GROUP BY 1 HAVING count(DISTINCT day(ts) // 5) >= 2")
def emergence_windows(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("t"))
    return score.emergence(e, 5)


_RULES = (("literature", ("the ", "of ")), ("graph", ("der ", "und ")), ("hypothesis", ("que ", "les ")))


@query("SELECT conv_id, turn, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in cs) + f" THEN '{n}'" for n, cs in _RULES) + " ELSE 'general' END AS task FROM conversations")
def task_routing(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", score.route(F.col("text"), _RULES).alias("task"))


_KEYS = ("the", "and", "of", "to", "der", "und", "die", "le", "la", "de", "que", "el", "en", "los")


@query("WITH k AS (SELECT conv_id, turn, text, unnest([" + ", ".join(f"'{k}'" for k in _KEYS) + """]) AS k, unnest(range(0, 14)) AS o FROM conversations), h AS (SELECT conv_id, k, min((turn, o)) AS f FROM k WHERE contains(lower(text), k) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY f DESC) AS q FROM h) SELECT conv_id, string_agg(k, ' ' ORDER BY f) AS active FROM r WHERE q <= 10 GROUP BY 1""")
def active_entities(spark, d):
    """The last ten distinct keywords of a conversation, in order of first mention."""
    keys = F.posexplode(F.array(*[F.lit(k) for k in _KEYS])).alias("o", "k")
    x = table(spark, d, "conversations").select("conv_id", "turn", "text", keys).filter(F.contains(F.lower("text"), F.col("k")))
    first = x.groupBy("conv_id", "k").agg(F.min(F.struct("turn", "o")).alias("f"))
    a = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("f", "k"))).alias("xs"))
    return a.select("conv_id", F.array_join(F.transform(F.slice("xs", F.greatest(F.size("xs") - 9, F.lit(1)), 10), lambda x: x["k"]), " ").alias("active"))


@query("""WITH x AS (SELECT event_type AS agent, event_type <> 'error' AND value > 20 AS ok, value / 100 AS took, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
  y AS (SELECT agent, sum(0.1 * 0.9 ** k * ok::INT) + any_value(0.5 * 0.9 ** n) AS success, sum(0.1 * 0.9 ** k * took) AS seconds, avg(least(value / 50, 1)) AS c FROM x GROUP BY agent) SELECT agent, round(success, 6) AS success, round(seconds, 6) AS seconds, round(success * c - least(seconds / 10, 0.5), 6) AS routing FROM y""")
def agent_routing(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("agent"), F.col("event_id").alias("pos"), ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("ok"), F.least(F.col("value") / 50, F.lit(1.0)).alias("confidence"), (F.col("value") / 100).alias("took"))
    x = score.moving_performance(e)
    return x.select("agent", *[F.round(c, 6).alias(c) for c in ("success", "seconds", "routing")])


_TOP = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label AS ql FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings ON query_id <> vec_id),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 10)"""


def _cosine(spark, d, k=10):
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.top_k(q, v, k)


@query(f"WITH {_TOP} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM c")
def cosine_topk(spark, d):
    return _cosine(spark, d).withColumn("score", F.round("score", 6))


_LABEL = """, l AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id)::INTEGER AS rank FROM q JOIN embeddings ON label = ql AND vec_id > query_id QUALIFY rank <= 10)"""


def _label_ranking(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = F.broadcast(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")))
    x = v.join(q, (F.col("label") == F.col("ql")) & (F.col("vec_id") > F.col("query_id")))
    return x.select("query_id", F.col("vec_id").alias("doc_id"), F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")).alias("rank")).filter("rank <= 10")


@query(f"""WITH {_TOP} {_LABEL}, u AS (SELECT 0 AS list, query_id, doc_id, rank FROM c UNION ALL SELECT 1, query_id, doc_id, rank FROM l), f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min((list, rank)) AS first FROM u GROUP BY 1, 2)
  SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, doc_id) AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(spark, d):
    a = _cosine(spark, d).select(F.lit(0).alias("list"), "query_id", "doc_id", "rank")
    b = _label_ranking(spark, d).select(F.lit(1).alias("list"), "query_id", "doc_id", "rank")
    return retrieve.fuse(a.unionByName(b), 10).withColumn("score", F.round("score", 9))


@query(f"WITH {_TOP} {_LABEL}, u AS (SELECT query_id, rank, doc_id, 0 AS source FROM c WHERE rank <= 6 UNION ALL SELECT query_id, rank, doc_id, 1 FROM l WHERE rank <= 4) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, source)::INTEGER AS rank, doc_id, source FROM u")
def weighted_interleave(spark, d):
    return retrieve.interleave(_cosine(spark, d), _label_ranking(spark, d), 10)


@query(f"""WITH {_TOP}, r AS (SELECT query_id, vec_id AS doc_id FROM q JOIN embeddings ON label = ql AND vec_id <> query_id), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1),
  g AS (SELECT c.query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM c JOIN r USING (query_id, doc_id) GROUP BY 1), x AS (SELECT n.*, coalesce(hits, 0) AS hits, first, coalesce(dcg, 0) AS dcg, list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM n LEFT JOIN g USING (query_id))
  SELECT count(*) AS queries, round(avg(hits / 10), 6) AS precision, round(avg(hits / n), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg, round(avg((hits > 0)::INT), 6) AS hit_rate FROM x""")
def retrieval_metrics(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    q = F.broadcast(v.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql")))
    qrels = v.join(q, (F.col("label") == F.col("ql")) & (F.col("doc_id") != F.col("query_id"))).select("query_id", "doc_id")
    return retrieve.evaluate(_cosine(spark, d), qrels, 10)


@query("SELECT vec_id, round(CASE WHEN s <= 1 THEN s ELSE 1 / (1 + s) END, 6) AS similarity FROM (SELECT vec_id, vec_id % 7 / 3 AS s FROM embeddings)")
def score_threshold(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(retrieve.similarity(F.col("vec_id") % 7 / 3), 6).alias("similarity"))


_EDGES = "e AS (SELECT 'C' || o_custkey AS u, 'P' || m[2] AS v FROM " + MAIN + "), b AS (SELECT u AS node, v AS nbr FROM e UNION ALL SELECT v, u FROM e), g AS (SELECT node, count(*) AS deg FROM b GROUP BY 1)"


@query(f"""WITH {_EDGES}, s AS (SELECT 'C' || c_custkey AS seed_set, 'C' || c_custkey AS node FROM customer), o AS (SELECT DISTINCT b.* FROM b JOIN g USING (node) WHERE deg <= 15),
  h1 AS (SELECT DISTINCT seed_set, nbr AS node FROM s JOIN o USING (node) WHERE nbr <> seed_set), h2 AS (SELECT DISTINCT seed_set, nbr AS node FROM h1 JOIN o USING (node) WHERE nbr <> seed_set AND (seed_set, nbr) NOT IN (SELECT seed_set, node FROM h1))
  SELECT seed_set, node, 1 AS hop FROM h1 UNION ALL SELECT seed_set, node, 2 FROM h2""")
def bfs_degree_capped(spark, d):
    e = main_lines(spark, d).select(F.concat(F.lit("C"), "o_custkey").alias("u"), F.concat(F.lit("P"), "m.l_partkey").alias("v"))
    s = F.concat(F.lit("C"), "c_custkey")
    seeds = table(spark, d, "customer").select(s.alias("seed_set"), s.alias("node"))
    return graph.neighbourhood(e, seeds, 2, 15)


@query("""WITH j AS (SELECT l_suppkey AS query_id, 'w' || l_partkey AS node, l_orderkey AS doc_id FROM lineitem), a AS (SELECT DISTINCT query_id, node FROM j WHERE doc_id % 2 = 0), x AS (SELECT DISTINCT query_id, doc_id % 100 AS doc_id, node FROM j)
  SELECT query_id, doc_id, round(count(*) FILTER (WHERE (query_id, node) IN (SELECT query_id, node FROM a)) / sqrt(count(*)), 6) AS score FROM x GROUP BY 1, 2""")
def context_ranking(spark, d):
    j = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("w"), "l_partkey").alias("node"), F.col("l_orderkey").alias("doc_id"))
    return retrieve.rank_contexts(j.withColumn("doc_id", F.col("doc_id") % 100).distinct(), j.filter("doc_id % 2 = 0").select("query_id", "node").distinct()).withColumn("score", F.round("score", 6))


@query("SELECT l_suppkey AS query_id, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS docs FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 3 AND CAST('0x' || substr(md5('11|' || l_suppkey), 1, 8) AS BIGINT) % 2 = 0")
def query_set(spark, d):
    """Queries with at least three distinct documents; half of them by a hash of seed and key."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("d"))
    return x.filter((F.size("d") >= 3) & (sampling.draw(F.lit("11"), F.col("query_id").cast("string")) % 2 == 0)).select("query_id", F.size("d").cast("long").alias("n"), F.array_join("d", ",").alias("docs"))


@query("""WITH r AS (SELECT b.item_id AS query_id, d.doc_id, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)), k AS (SELECT query_id, doc_id FROM r WHERE NOT regexp_matches(lower(text), '(^|[^a-z0-9])(thor|here)([^a-z0-9]|$)'))
  SELECT query_id, count(*) AS kept, dense_rank() OVER (ORDER BY query_id)::INTEGER AS number FROM k GROUP BY 1""")
def lexically_disjoint(spark, d):
    """Judged documents that don't name a query's terms; benchmark passages are found by the hash of their first words and then compared."""
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    r = literature.containing(docs.select("doc_id", "text"), bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("needle")))
    r = r.join(docs.select("doc_id", "text"), "doc_id")
    kept = r.filter(~F.lower("text").rlike("(^|[^a-z0-9])(thor|here)([^a-z0-9]|$)"))
    x = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    return x.withColumn("number", F.dense_rank().over(Window.orderBy("query_id")))


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents), h AS (SELECT DISTINCT doc_id, t FROM t WHERE t IN ('thor', 'idiot', 'der', 'que')) SELECT (SELECT count(*) FROM documents) AS chunks, count(DISTINCT doc_id) AS linked, count(DISTINCT t) AS nodes FROM h")
def rag_coverage(spark, d):
    docs = table(spark, d, "documents")
    aliases = spark.createDataFrame([(w, w) for w in ("thor", "idiot", "der", "que")], "alias string, node_id string")
    m = literature.alias_mentions(docs, aliases, longest=1)
    return docs.agg(F.count(F.lit(1)).alias("chunks")).join(m.agg(F.countDistinct("doc_id").alias("linked"), F.countDistinct("node_id").alias("nodes")))


@query("SELECT o_orderkey, round(least(1, greatest(0, (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 0.4 * (o_custkey % 10) / 10 END + 0.3 * (o_orderkey % 7) / 7 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 0.3 END) / (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 0.4 END + 0.3 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 0.3 END))), 6)::DOUBLE AS score FROM orders")
def weighted_score_aggregate(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 10 / 10).alias("a"), (F.col("o_orderkey") % 7 / 7).alias("b"), F.when(F.col("o_orderkey") % 5 != 0, 1.0).alias("c"))
    return o.select("o_orderkey", F.round(score.weighted({"a": 0.4, "b": 0.3, "c": 0.3}), 6).alias("score"))


@query("""WITH v AS (SELECT l_orderkey AS doc_id, lower(trim(p_type)) AS key, 1 - l_discount AS confidence, l_returnflag AS label FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT doc_id, key, count(*) AS votes, round(avg(confidence) * least(count(*) / 4, 1), 6) AS confidence, max((confidence, label))[2] AS label FROM v GROUP BY 1, 2 HAVING count(*) >= 3""")
def majority_vote(spark, d):
    v = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.upper("p_type").alias("text"), F.col("l_returnflag").alias("label"), (1 - F.col("l_discount")).alias("confidence"))
    return score.majority(v, 4).withColumn("confidence", F.round("confidence", 6))


@query("""WITH x AS (SELECT doc_id, quality AS y, (doc_id * 37 % 101) / 101 AS s, (CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) % 5)::INTEGER AS fold FROM labels), c AS (SELECT fold, count(*) FILTER (WHERE s >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE s < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE s < 0.5 AND y = 0) AS tn, avg((s - y) ** 2) AS b FROM x GROUP BY 1)
  SELECT fold, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(b, 6) AS brier FROM c""")
def confusion_metrics(spark, d):
    x = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), (F.col("doc_id") * 37 % 101 / 101).alias("score"), sampling.fold("doc_id").alias("fold"))
    return metrics.classification(x, "fold")


@query("""WITH p AS (SELECT l_orderkey AS item, l_linenumber AS member, unnest(['a', 'b', 'c']) AS class, unnest([l_quantity, 51 - l_quantity, 10 + l_tax]) AS p FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)), q AS (SELECT *, p / sum(p) OVER (PARTITION BY item, member) AS q FROM p),
  m AS (SELECT item, class, avg(q) AS q FROM q GROUP BY 1, 2), t AS (SELECT item, sum(-q * ln(q + 1e-12)) AS total FROM m GROUP BY 1), a AS (SELECT item, sum(-q * ln(q + 1e-12)) / count(DISTINCT member) AS aleatoric FROM q GROUP BY 1)
  SELECT item, round(total, 6) AS total, round(aleatoric, 6) AS aleatoric, round(greatest(0, total - aleatoric), 6) AS epistemic FROM t JOIN a USING (item)""")
def uncertainty_split(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    cls = F.explode(F.array(F.struct(F.lit("a").alias("class"), F.col("q").alias("p")), F.struct(F.lit("b").alias("class"), (51 - F.col("q")).alias("p")), F.struct(F.lit("c").alias("class"), (10 + F.col("t")).alias("p"))))
    m = x.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("member"), cls.alias("x")).select("item", "member", "x.*")
    return score.uncertainty(m).select("item", *[F.round(c, 6).alias(c) for c in ("total", "aleatoric", "epistemic")])


@query("""WITH x AS (SELECT o_orderkey, ['GENE', 'DISEASE', 'DRUG', 'PROTEIN', 'PATHWAY', 'MUTATION', 'PHENOTYPE', 'FUSION'][o_orderkey % 8 + 1] AS a, ['GENE', 'DISEASE', 'DRUG', 'PROTEIN', 'PATHWAY', 'MUTATION', 'PHENOTYPE', 'FUSION'][o_custkey % 8 + 1] AS b,
    ['TREATS', 'CAUSES', 'PREVENTS', 'INHIBITS', 'ACTIVATES', 'INTERACTS_WITH', 'ASSOCIATED_WITH', 'BINDS'][o_orderkey // 8 % 8 + 1] AS p FROM orders)
  SELECT o_orderkey, round(least(1, CASE least(a, b) || '/' || greatest(a, b) WHEN 'DISEASE/GENE' THEN 0.8 WHEN 'DISEASE/DRUG' THEN 0.9 WHEN 'DRUG/GENE' THEN 0.7 WHEN 'DISEASE/PROTEIN' THEN 0.8 WHEN 'DISEASE/PATHWAY' THEN 0.6 WHEN 'GENE/GENE' THEN 0.5 WHEN 'PROTEIN/PROTEIN' THEN 0.6
    WHEN 'DISEASE/MUTATION' THEN 0.8 WHEN 'DRUG/MUTATION' THEN 0.7 WHEN 'GENE/MUTATION' THEN 0.6 WHEN 'MUTATION/PHENOTYPE' THEN 0.6 WHEN 'MUTATION/MUTATION' THEN 0.5 WHEN 'DISEASE/FUSION' THEN 0.8 WHEN 'DRUG/FUSION' THEN 0.7 WHEN 'DISEASE/PHENOTYPE' THEN 0.7 ELSE 0.3 END::DOUBLE
    * CASE p WHEN 'TREATS' THEN 1.2 WHEN 'CAUSES' THEN 1.1 WHEN 'PREVENTS' THEN 1.1 WHEN 'INTERACTS_WITH' THEN 0.9 WHEN 'ASSOCIATED_WITH' THEN 0.8 ELSE 1 END::DOUBLE), 6) AS plausibility FROM x""")
def plausibility(spark, d):
    types = ("GENE", "DISEASE", "DRUG", "PROTEIN", "PATHWAY", "MUTATION", "PHENOTYPE", "FUSION")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % 8 + 1).cast("int"))
    kind = pick((*score.RELATION_FACTORS, "BINDS"), F.floor(F.col("o_orderkey") / 8))
    return table(spark, d, "orders").select("o_orderkey", F.round(score.plausibility(pick(types, F.col("o_orderkey")), pick(types, F.col("o_custkey")), kind), 6).alias("plausibility"))


@query("SELECT p_partkey, round(0.4 * (p_size / 50) + 0.3 * (p_partkey % 10) / 10 + 0.2 * 0.5 + 0.1 * least((p_partkey % 6) / 3, 1), 6)::DOUBLE AS priority FROM part ORDER BY priority DESC, p_partkey LIMIT 20")
def hypothesis_ranking(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(score.hypothesis_priority(F.col("p_size") / 50, F.col("p_partkey") % 10 / 10, F.lit(0.5), F.col("p_partkey") % 6), 6).alias("priority")).orderBy(F.desc("priority"), "p_partkey").limit(20)


@query("""WITH r AS (SELECT l_partkey AS item, l_linenumber AS rating, l_discount AS confidence FROM lineitem), m AS (SELECT item, rating FROM (SELECT item, rating, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, rating) AS q FROM r GROUP BY 1, 2) WHERE q = 1)
  SELECT item, round(sum(r.rating * CASE WHEN confidence = 0 THEN 1 ELSE confidence END) / sum(CASE WHEN confidence = 0 THEN 1 ELSE confidence END), 6) AS weighted, round(avg(r.rating), 6) AS mean, round(stddev_pop(r.rating), 6) AS deviation, count(*) AS n, any_value(m.rating) AS mode FROM r JOIN m USING (item) GROUP BY item""")
def expert_consensus(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rating"), F.col("l_discount").alias("confidence"))
    x = score.consensus(r)
    return x.select("item", *[F.round(c, 6).alias(c) for c in ("weighted", "mean", "deviation")], "n", "mode")


@query("SELECT l_partkey AS item, round(least(1, 0.6 * avg(1 - l_discount) + 0.25 * count(*) / (count(*) + 1) + 0.15 * least(ln(1 + sum(l_linenumber)) / ln(101), 1)), 6)::DOUBLE AS confidence FROM lineitem GROUP BY 1")
def literature_confidence(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_linenumber").alias("citations"))
    return score.literature_confidence(e).withColumn("confidence", F.round("confidence", 6))


@query("SELECT l_suppkey AS item, round(0.7 * max(s) + 0.3 * avg(s), 6)::DOUBLE AS confidence FROM (SELECT l_suppkey, 0.4 * (1 - l_discount) + 0.4 * (l_quantity / 50) + 0.2 * (l_tax * 10) AS s FROM lineitem) GROUP BY 1")
def experimental_confidence(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), (1 - F.col("l_discount")).alias("design"), (F.col("l_quantity") / 50).alias("significance"), (F.col("l_tax") * 10).alias("power"))
    return score.experimental_confidence(s).withColumn("confidence", F.round("confidence", 6))


@query("""WITH x AS (SELECT l_partkey AS item, coalesce(avg((l_returnflag <> 'R')::INT) FILTER (WHERE year(l_shipdate) >= 2000), 0.5) AS recent, coalesce(avg((l_returnflag <> 'R')::INT) FILTER (WHERE year(l_shipdate) < 2000), 0.5) AS historic FROM lineitem GROUP BY 1)
  SELECT item, round(recent, 6) AS recent, round(historic, 6) AS historic, CASE WHEN recent - historic > 0.1 THEN 'rising' WHEN recent - historic < -0.1 THEN 'falling' ELSE 'stable' END AS trend, round(least(1, (0.7 * recent + 0.3 * historic) * CASE WHEN recent - historic > 0.1 THEN 1.1 WHEN recent - historic < -0.1 THEN 0.9 ELSE 1 END), 6)::DOUBLE AS score FROM x""")
def temporal_trends(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.year("l_shipdate").alias("year"), (F.col("l_returnflag") != "R").alias("supports"))
    return score.trend(f, 2000).select("item", *[F.round(c, 6).alias(c) for c in ("recent", "historic", "score")], "trend")


@query("SELECT CASE WHEN grouping(event_type) = 1 THEN '*' ELSE event_type END AS provider, CASE WHEN grouping(m) = 1 THEN '*' ELSE m END AS model, count(*) AS calls, sum(floor(value))::BIGINT AS tokens FROM (SELECT event_type, 'm' || (user_id % 3) AS m, value FROM events) GROUP BY ROLLUP (event_type, m)")
def usage_rollup(spark, d):
    c = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.floor("value").alias("tokens"))
    return score.usage(c)


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS y FROM x) SELECT vec_id, round(max(y) / sqrt(sum(y * y)), 6) AS largest, round(sum(y) / sqrt(sum(y * y)), 6) AS total FROM c GROUP BY 1""")
def centred_embeddings(spark, d):
    x = retrieve.centred(table(spark, d, "embeddings"))
    return x.select("vec_id", F.round(F.array_max("embedding"), 6).alias("largest"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT DISTINCT doc_id, CASE WHEN slot < 8000 THEN 'train' WHEN slot < 9000 THEN 'validate' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) % 10000 AS slot FROM documents)")
def hash_split(spark, d):
    return sampling.hash_split(table(spark, d, "documents").select("doc_id").distinct(), "doc_id", {"train": 0.8, "validate": 0.1, "test": 0.1})


@query()
def embedding_clusters(spark, d):
    """K-means cells of the vectors, by Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector(retrieve.doubles(F.col("embedding"))).alias("features"))
    return KMeans(k=10, seed=42, maxIter=10).fit(x).transform(x).select("vec_id", F.col("prediction").alias("cell"))


@query()
def embedding_projection(spark, d):
    """The first two principal components of the vectors, by Spark ML."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector(retrieve.doubles(F.col("embedding"))).alias("features"))
    return PCA(k=2, inputCol="features", outputCol="p").fit(x).transform(x).select("vec_id", vector_to_array("p").alias("components"))
