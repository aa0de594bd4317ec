"""Linking, bridges, variant scores, sentences, novelty, validation and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, linking
from ..sources.tables import assertions, main_lines, table
from .links import ASSERT, MAIN

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LABELS = ("GENE", "PROTEIN", "DRUG", "CHEMICAL", "DISEASE", "MUTATION")


def _label(column: str):
    return F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col(column) % 6 + 1).cast("int"))


def _linked_mentions(spark, d):
    """Names of parts as they are, with a descriptor, or misspelt, and customers that no part is like."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.upper("p_name"), F.lit("  Gene!"))).when(k == 2, F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.lit("q"))).otherwise(F.reverse("p_name"))
    return p.select(F.col("p_partkey").alias("mention_id"), text.alias("text"), _label("p_size").alias("label"))


def _linked_entities(spark, d):
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return p.select(F.concat(F.lit("K:"), "p_name").alias("entity_id"), _label("k").alias("type"), F.col("p_name").alias("name"), F.array(F.concat("p_name", F.lit(" protein")), F.concat(F.lit("the "), "p_name")).alias("synonyms"))


_NAMES = "['GENE', 'PROTEIN', 'DRUG', 'CHEMICAL', 'DISEASE', 'MUTATION']"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\b(gene|protein)\\b', '', 'g'))"
_SIM = "CASE WHEN a = b THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"
_LINK = f"""m0 AS (SELECT p_partkey AS mention_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '  Gene!' WHEN 2 THEN left(p_name, length(p_name) - 1) || 'q' ELSE reverse(p_name) END AS text, {_NAMES}[p_size % 6 + 1] AS label FROM part),
  m AS (SELECT mention_id, label, {_NORM.format("text")} AS a FROM m0),
  e0 AS (SELECT 'K:' || p_name AS entity_id, {_NAMES}[min(p_partkey) % 6 + 1] AS type, p_name AS name FROM part GROUP BY p_name)"""
_CANDIDATES = f"""WITH {_LINK}, s0 AS (SELECT entity_id, type, unnest([name, name || ' protein', 'the ' || name]) AS s FROM e0), s AS (SELECT entity_id, type, {_NORM.format("s")} AS b FROM s0),
  types AS (SELECT unnest({_NAMES}) AS label, unnest({_NAMES}) AS type UNION ALL SELECT unnest(['GENE', 'PROTEIN', 'DISEASE', 'DRUG', 'DRUG', 'CHEMICAL']), unnest(['PROTEIN', 'GENE', 'DISORDER', 'CHEMICAL', 'COMPOUND', 'DRUG'])),
  pairs AS (SELECT mention_id, entity_id, label, type, {_SIM} AS sim FROM m JOIN types USING (label) JOIN s USING (type)),
  c AS (SELECT mention_id, entity_id, max(sim * CASE WHEN label = type THEN 1 ELSE 0.96 END) AS similarity FROM pairs WHERE sim >= 0.85 - 1e-9 GROUP BY 1, 2)"""


@query(f"""WITH {_LINK}, c AS (SELECT DISTINCT name AS candidate, {_NORM.format("name")} AS b FROM e0), x AS (SELECT mention_id AS query_id, candidate, {_SIM} AS score FROM m JOIN c ON TRUE), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate) AS rank FROM x WHERE score >= 0.8 - 1e-9)
  SELECT query_id, rank::INTEGER AS rank, candidate, round(score, 6) AS score FROM r WHERE rank <= 5""")
def best_name_matches(spark, d):
    q = _linked_mentions(spark, d).select(F.col("mention_id").alias("query_id"), "text")
    return linking.best_matches(q, _linked_entities(spark, d).select(F.col("name").alias("candidate"))).withColumn("score", F.round("score", 6))


@query(f"""WITH {_LINK}, c AS (SELECT DISTINCT name AS candidate, {_NORM.format("name")} AS b FROM e0), x AS (SELECT mention_id, candidate, {_SIM} AS score FROM m JOIN c ON TRUE), r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, candidate) AS rank FROM x WHERE score >= 0.8 - 1e-9)
  SELECT m.mention_id AS query_id, candidate AS kg_id, round(coalesce(score, 0), 6)::DOUBLE AS confidence, CASE WHEN score IS NULL THEN 'unmatched' WHEN score >= 1 THEN 'exact' ELSE 'fuzzy' END AS match_type FROM m LEFT JOIN r ON r.mention_id = m.mention_id AND rank = 1""")
def linked_names(spark, d):
    q = _linked_mentions(spark, d).select(F.col("mention_id").alias("query_id"), "text")
    return linking.link_names(q, _linked_entities(spark, d).select(F.col("name").alias("candidate"))).withColumn("confidence", F.round("confidence", 6))


@query(_CANDIDATES + " SELECT mention_id, entity_id, round(similarity, 6) AS similarity FROM c")
def linking_candidates(spark, d):
    return linking.candidate_entities(_linked_mentions(spark, d), _linked_entities(spark, d)).withColumn("similarity", F.round("similarity", 6))


def _links(spark, d):
    c = linking.candidate_entities(_linked_mentions(spark, d), _linked_entities(spark, d))
    context = (F.length("entity_id") + F.col("mention_id")) % 7 / 6
    return linking.disambiguate(c.withColumn("similarity", F.round("similarity", 9)).withColumn("context", F.round(context, 9)))


_DONE = _CANDIDATES + """, x AS (SELECT mention_id, entity_id, round(similarity, 9) AS similarity, round((length(entity_id) + mention_id) % 7 / 6, 9) AS context FROM c),
  y AS (SELECT *, 0.6::DOUBLE * similarity + 0.4::DOUBLE * context AS score, count(*) OVER (PARTITION BY mention_id) AS n FROM x), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, similarity DESC, entity_id) = 1),
  links AS (SELECT mention_id, CASE WHEN n = 1 OR score >= 0.8 THEN entity_id END AS entity_id, round(CASE WHEN n = 1 THEN similarity WHEN score >= 0.8 THEN (similarity + context) / 2 ELSE 0 END, 6)::DOUBLE AS confidence,
    CASE WHEN n = 1 AND similarity >= 1 THEN 'EXACT' WHEN n = 1 AND similarity >= 0.9 THEN 'FUZZY' WHEN n = 1 THEN 'SEMANTIC' WHEN score >= 0.8 THEN 'CONTEXTUAL' ELSE 'CONFLICT' END AS match_type FROM z)"""


@query(_DONE + " SELECT * FROM links")
def disambiguated_links(spark, d):
    return _links(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(_DONE + ", b AS (SELECT match_type, floor(confidence * 10 + 1e-9) / 10 AS bin FROM links) SELECT coalesce(match_type, '*') AS match_type, coalesce(bin, -1)::DOUBLE AS bin, count(*) AS links FROM b GROUP BY ROLLUP (match_type, bin)")
def link_statistics(spark, d):
    return linking.link_statistics(_links(spark, d).withColumn("confidence", F.round("confidence", 6)))


_EVIDENCE = "e AS (SELECT DISTINCT p_type AS disease, p_brand AS profile, l_orderkey AS paper FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {_EVIDENCE}, pr AS (SELECT DISTINCT disease, profile FROM e), w AS (SELECT disease FROM pr GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), u AS (SELECT DISTINCT disease, paper FROM e)
  SELECT pr.disease, pr.profile, count(*) AS papers, sum(u.paper)::BIGINT AS checksum FROM pr JOIN w USING (disease) JOIN u USING (disease) LEFT JOIN e ON e.disease = pr.disease AND e.profile = pr.profile AND e.paper = u.paper WHERE e.paper IS NULL GROUP BY 1, 2 HAVING count(*) >= 3""")
def bridge_queries(spark, d):
    """Two-hop queries: how many papers of a disease's other profiles each profile may reach."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e = x.select(F.col("p_type").alias("disease"), F.col("p_brand").alias("profile"), F.col("l_orderkey").alias("paper"))
    return discovery.bridge_papers(e, least=3).groupBy("disease", "profile").agg(F.count(F.lit(1)).alias("papers"), F.sum("paper").alias("checksum"))


@query("""WITH q AS (SELECT conv_id * 100 + turn AS query_id, 'what of Brand#' || (conv_id % 25 + 1) || ' and brand#' || (turn % 7 + 1) || ', please' AS text FROM conversations), e AS (SELECT DISTINCT p_brand AS u, p_type AS v, 'MADE_AS' AS predicate FROM part),
  b AS (SELECT u AS node, v AS nbr, * FROM e UNION ALL SELECT v, u, * FROM e), h AS (SELECT DISTINCT query_id, nbr, u, v, predicate FROM q JOIN b ON regexp_matches(lower(text), '(^|[^a-z0-9_#:])' || lower(node) || '([^a-z0-9_#:]|$)')),
  f AS (SELECT query_id, nbr, min((u, v, predicate)) AS e FROM h GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY nbr)::INTEGER AS rank, e[1] AS u, e[2] AS v, e[3] AS predicate FROM f QUALIFY rank <= 4""")
def named_node_relations(spark, d):
    c = table(spark, d, "conversations")
    q = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat(F.lit("what of Brand#"), (F.col("conv_id") % 25 + 1).cast("string"), F.lit(" and brand#"), (F.col("turn") % 7 + 1).cast("string"), F.lit(", please")).alias("text"))
    e = table(spark, d, "part").select(F.col("p_brand").alias("u"), F.col("p_type").alias("v"), F.lit("MADE_AS").alias("predicate")).distinct()
    return discovery.named_relations(q.distinct(), e)


_VARIANT = """n AS (SELECT 'N:' || p_partkey AS node, upper(p_brand) || ' p.' || change AS key, p_partkey FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'amp' ELSE chr((65 + p_size % 20)::INTEGER) || p_size || CASE WHEN p_size % 3 = 0 THEN '*' ELSE 'E' END END AS change FROM part) WHERE regexp_full_match(change, '[A-Z][0-9]+[A-Z*]')),
  c AS (SELECT key, c_nationkey AS cohort, count(*) AS n FROM lineitem JOIN n ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), cases AS (SELECT c_nationkey AS cohort, count(*) AS cases FROM customer GROUP BY 1), dis AS (SELECT n_nationkey AS cohort, 'D:' || n_regionkey AS disease FROM nation WHERE n_regionkey <> 2)"""


def _variants(spark, d):
    p = table(spark, d, "part")
    change = F.when(F.col("p_partkey") % 5 == 0, "amp").otherwise(F.concat(F.char((65 + F.col("p_size") % 20).cast("int")), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "*").otherwise("E")))
    nodes = p.select(F.concat(F.lit("N:"), "p_partkey").alias("node"), discovery.variant_key(F.col("p_brand"), change).alias("key"), "p_partkey").filter("key IS NOT NULL")
    x = table(spark, d, "lineitem").join(nodes, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = x.groupBy("key", F.col("c_nationkey").alias("cohort")).agg(F.count(F.lit(1)).alias("n"))
    cases = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cohort")).agg(F.count(F.lit(1)).alias("cases"))
    diseases = table(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("cohort"), F.concat(F.lit("D:"), "n_regionkey").alias("disease"))
    return counts, cases, nodes.select("node", "key"), diseases


def _variant_query(mode: str, total: str):
    def run(spark, d):
        return discovery.variant_scores(*_variants(spark, d), mode).withColumn("score", F.round("score", 6))

    run.__name__ = f"variant_{mode}"
    query(f"WITH {_VARIANT}, t AS ({total}) SELECT node AS u, disease AS v, round(max(c.n / total), 6) AS score FROM c JOIN t ON t.k = c.{'key' if mode == 'specificity' else 'cohort'} JOIN dis USING (cohort) JOIN n ON n.key = c.key GROUP BY 1, 2")(run)


_variant_query("specificity", "SELECT key AS k, sum(n) AS total FROM c GROUP BY 1")
_variant_query("prevalence", "SELECT cohort AS k, cases AS total FROM cases")


@query(f"WITH {_VARIANT}, t AS (SELECT key AS k, sum(n) AS total FROM c GROUP BY 1), s AS (SELECT node AS u, disease AS v, max(c.n / total) AS score FROM c JOIN t ON t.k = c.key JOIN dis USING (cohort) JOIN n ON n.key = c.key GROUP BY 1, 2), p AS (SELECT 'D:' || r_regionkey AS u, 'N:' || p_partkey AS v FROM part JOIN region ON r_regionkey = p_partkey % 5) SELECT count(*) AS pairs, round(avg((coalesce(score, 0) > 0)::INT), 6) AS coverage, round(avg(coalesce(score, 0)), 6) AS mean FROM p LEFT JOIN s ON s.u = p.v AND s.v = p.u")
def variant_coverage(spark, d):
    """Share of pairs (disease, variant) that the scores of (variant, disease) say something about."""
    p = table(spark, d, "part").select(F.concat(F.lit("D:"), (F.col("p_partkey") % 5).cast("string")).alias("u"), F.concat(F.lit("N:"), "p_partkey").alias("v"))
    x = discovery.score_pairs(p, discovery.variant_scores(*_variants(spark, d)))
    return x.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("score") > 0).cast("double")), 6).alias("coverage"), F.round(F.avg("score"), 6).alias("mean"))


_TERM = "trim(regexp_replace(regexp_replace(p_brand || '::' || p_type, '[^\\w\\s\\-+.]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH x AS (SELECT *, CASE p_size % 4 WHEN 1 THEN left(p_name, 3) WHEN 2 THEN p_brand WHEN 3 THEN p_type END AS gene FROM part)
  SELECT p_partkey, CASE WHEN gene IS NULL OR starts_with(upper(p_name), upper(gene)) THEN p_name ELSE gene || ' ' || p_name END AS text, '"' || {_TERM} || '"' AS term FROM x""")
def node_texts(spark, d):
    k = F.col("p_size") % 4
    gene = F.when(k == 0, "nan").when(k == 1, F.substring("p_name", 1, 3)).when(k == 2, F.col("p_brand")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", discovery.node_text(F.col("p_name"), gene).alias("text"), discovery.query_term(F.concat_ws("::", "p_brand", "p_type")).alias("term"))


_B = "[^\\p{L}\\p{N}_]"


@query(f"""WITH n AS (SELECT doc_id, text, lower(regexp_extract_all(text, '[A-Za-z]{{2,}}')[3]) AS a, lower(regexp_extract_all(text, '[A-Za-z]{{2,}}')[4]) AS b FROM documents), s AS (SELECT doc_id, a, b, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))) AS s, unnest(range(0, 100000)) AS i FROM n),
  h AS (SELECT doc_id, a, b, trim(s) AS s, i FROM s WHERE s IS NOT NULL AND length(trim(s)) BETWEEN 21 AND 599 AND contains(lower(s), b) AND regexp_matches(lower(trim(s)), '(^|{_B})(' || a || '[\\s\\-_:]*' || b || '|' || b || ')({_B}|$)'))
  SELECT doc_id, count(*) AS sentences, md5(any_value(a) || ' ' || any_value(b) || ' ' || string_agg(s, ' ' ORDER BY i) FILTER (WHERE r <= 12)) AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM h) GROUP BY doc_id""")
def mention_sentences(spark, d):
    """Sentences that mention the third and fourth word of a document as a name, and the context built of them."""
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), 1)
    x = table(spark, d, "documents").select("doc_id", "text", F.concat_ws("-", F.lower(F.get(w, F.lit(2))), F.lower(F.get(w, F.lit(3)))).alias("name"), F.size(w).alias("n")).filter("n > 3")
    x = x.withColumn("s", discovery.sentences_mentioning(F.col("text"), F.col("name"))).filter(F.size("s") > 0)
    return x.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(discovery.context_text(F.replace("name", F.lit("-"), F.lit(" ")), F.col("s"))).alias("context"))


_KNOWN = f"WITH {ASSERT}, k AS (SELECT DISTINCT subject AS entity, object AS partner FROM assertions WHERE year < 1997), q AS (SELECT DISTINCT 'P:' || l_partkey AS u, 'C:' || o_custkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(_KNOWN + """, z AS (SELECT entity, count(*) AS n FROM k GROUP BY 1) SELECT q.u, q.v, CASE WHEN k.entity IS NOT NULL THEN 0 WHEN coalesce(zu.n, 0) = 0 AND coalesce(zv.n, 0) = 0 THEN 0.5 ELSE 0.5 + 0.5 * least(greatest(coalesce(zu.n, 0), coalesce(zv.n, 0)) / 10, 1) END::DOUBLE AS novelty
  FROM q LEFT JOIN z zu ON zu.entity = q.u LEFT JOIN z zv ON zv.entity = q.v LEFT JOIN k ON k.entity = q.v AND k.partner = q.u""")
def relation_novelty(spark, d):
    k = assertions(spark, d).filter("year < 1997").select(F.col("subject").alias("entity"), F.col("object").alias("partner"))
    return discovery.novelty(_asked(spark, d), k)


def _asked(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.concat(F.lit("P:"), "l_partkey").alias("u"), F.concat(F.lit("C:"), "o_custkey").alias("v")).distinct()


@query(f"WITH {ASSERT}, k AS (SELECT DISTINCT subject AS v, object AS u, predicate AS relation FROM assertions), q AS (SELECT DISTINCT 'P:' || l_partkey AS u, 'C:' || o_custkey AS v, l_returnflag AS relation FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT q.*, (k.u IS NOT NULL)::INTEGER AS label FROM q LEFT JOIN k USING (u, v, relation)")
def known_relation_labels(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    q = x.select(F.concat(F.lit("P:"), "l_partkey").alias("u"), F.concat(F.lit("C:"), "o_custkey").alias("v"), F.col("l_returnflag").alias("relation")).distinct()
    return discovery.known_labels(q, assertions(spark, d).select(F.col("subject").alias("u"), F.col("object").alias("v"), F.col("predicate").alias("relation")))


_LATER = """m AS (SELECT DISTINCT l_orderkey AS paper, CAST(year(o_orderdate) AS INTEGER) AS year, unnest([p_brand, p_type]) AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), p AS (SELECT DISTINCT a.p_brand AS u, b.p_type AS v FROM part a JOIN part b ON a.p_size = b.p_size)"""


@query(f"WITH {_LATER}, l AS (SELECT DISTINCT a.entity AS u, b.entity AS v FROM m a JOIN m b ON a.paper = b.paper WHERE a.year >= 2001 AND b.year >= 2001) SELECT p.u, p.v, (l.u IS NOT NULL)::INTEGER AS label FROM p LEFT JOIN l USING (u, v)")
def later_cooccurrence_labels(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    pairs = p.select(F.col("p_brand").alias("u"), "p_size").distinct().join(p.select(F.col("p_type").alias("v"), "p_size").distinct(), "p_size").select("u", "v").distinct()
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = x.select(F.col("l_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.explode(F.array("p_brand", "p_type")).alias("entity"))
    return discovery.later_labels(pairs, m, 2001)


@query("""WITH a AS (SELECT substr(p_brand, 1, 7) || '-' || p_type AS type_pair, l_discount * 10 AS score, l_returnflag = 'R' AS hit FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT type_pair, count(*) AS pairs, round(avg(hit::INT), 6) AS rate, round(avg(hit::INT) / (SELECT avg(hit::INT) FROM a), 6) AS lift, round(avg(score) FILTER (WHERE hit), 6) AS mean_hit, round(avg(score) FILTER (WHERE NOT hit), 6) AS mean_miss FROM a GROUP BY 1""")
def outcome_rates(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a = x.select(F.concat_ws("-", F.substring("p_brand", 1, 7), "p_type").alias("type_pair"), (F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").alias("hit"))
    out = discovery.outcome_rates(a)
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "lift", "mean_hit", "mean_miss")})


@query(f"""WITH p AS (SELECT DISTINCT 'n' || o_custkey AS u, 'N' || m[2] AS v FROM {MAIN}), e AS (SELECT upper('n' || l_partkey) AS name, l_suppkey, l_quantity FROM lineitem), x AS (SELECT u, v, l_quantity FROM p JOIN e ON upper(u) = name UNION ALL SELECT u, v, l_quantity FROM p JOIN e ON upper(v) = name)
  SELECT u, v, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM x GROUP BY 1, 2""")
def endpoint_evidence(spark, d):
    p = main_lines(spark, d).select(F.concat(F.lit("n"), "o_custkey").alias("u"), F.concat(F.lit("N"), "m.l_partkey").alias("v")).distinct()
    e = table(spark, d, "lineitem").select(F.concat(F.lit("n"), "l_partkey").alias("name"), "l_quantity")
    return discovery.endpoint_evidence(p, e).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT u, v, predicate FROM (SELECT 'S' || l_suppkey AS u, 'P' || l_partkey AS v, l_returnflag AS predicate, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_returnflag) AS r FROM lineitem) WHERE r = 1")
def deduped_relations(spark, d):
    """Relations in both directions by turns; the first of each pair stays, in the direction supplier - part here."""
    s, p = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey")
    turn = F.col("l_linenumber") % 2 == 0
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    x = table(spark, d, "lineitem").select(F.when(turn, s).otherwise(p).alias("u"), F.when(turn, p).otherwise(s).alias("v"), F.col("l_returnflag").alias("predicate"), order.alias("pos"))
    return discovery.dedupe_relations(x, "pos").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "predicate")


@query("""SELECT p_type AS kind, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS deviation, count(*) FILTER (WHERE s >= 0.7) AS high, count(*) FILTER (WHERE s >= 0.8) AS very_high_band, count(*) FILTER (WHERE s >= 0.6 AND s < 0.8) AS high_band, count(*) FILTER (WHERE s >= 0.4 AND s < 0.6) AS middle_band, count(*) FILTER (WHERE s < 0.4) AS low_band,
  round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high_end FROM (SELECT p_type, p_size / 50 AS s FROM part) GROUP BY 1""")
def report_bands(spark, d):
    x = table(spark, d, "part").select(F.col("p_type").alias("kind"), (F.col("p_size") / 50).alias("score"))
    low = discovery.percentile_interval(x, "kind").select("kind", F.round("low", 6).alias("low"), F.round("high", 6).alias("high_end"))
    return discovery.bands(x, "kind").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)}).join(low, "kind")


_SCORED = "x AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INTEGER AS label, l_quantity / 50 AS score FROM lineitem)"


@query(f"""WITH {_SCORED}, f AS (SELECT CAST('0x' || substr(md5('42|' || l_orderkey), 1, 8) AS BIGINT) % 5 AS fold, label, score >= 0.5 AS hat FROM x), c AS (SELECT fold, count(*) AS n, count(*) FILTER (WHERE hat AND label = 1) AS tp, count(*) FILTER (WHERE hat AND label = 0) AS fp, count(*) FILTER (WHERE NOT hat AND label = 1) AS fn FROM f GROUP BY 1),
  m AS (SELECT fold, n, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c) SELECT count(*) AS folds, sum(n)::BIGINT AS n, round(avg(precision), 6) AS precision, round(stddev_pop(precision), 6) AS precision_std, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(stddev_pop(f1), 6) AS f1_std FROM m""")
def fold_validation(spark, d):
    from ..operators.sampling import fold

    x = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") / 50).alias("score"))
    m = discovery.fold_metrics(x, fold("l_orderkey"))
    r = lambda e, n: F.round(e, 6).alias(n)
    return m.agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), r(F.avg("precision"), "precision"), r(F.stddev_pop("precision"), "precision_std"), r(F.avg("recall"), "recall"), r(F.avg("f1"), "f1"), r(F.stddev_pop("f1"), "f1_std"))


@query("""WITH x AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 38 THEN 'N' ELSE 'R' END AS predicted, l_quantity / 50 AS score, l_discount * 10 AS y FROM lineitem), k AS (SELECT DISTINCT label AS k FROM x UNION SELECT DISTINCT predicted FROM x),
  c AS (SELECT k, (SELECT count(*) FROM x WHERE label = k) AS t, (SELECT count(*) FROM x WHERE predicted = k) AS s, (SELECT count(*) FROM x WHERE label = k AND predicted = k) AS h FROM k)
  SELECT count(*) AS classes, round(sum(h) / sum(t), 6) AS accuracy, round(avg(2 * h / (t + s)), 6) AS macro_f1, round(sum(2 * h / (t + s) * t) / sum(t), 6) AS weighted_f1, (SELECT round(avg(abs(score - y)), 6) FROM x) AS mae, (SELECT round(avg((score - y) ** 2), 6) FROM x) AS mse, (SELECT round(sqrt(avg((score - y) ** 2)), 6) FROM x) AS rmse, (SELECT round(corr(y, score), 6) FROM x) AS pearson FROM c""")
def class_and_regression_metrics(spark, d):
    q = F.col("l_quantity")
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.when(q < 15, "A").when(q < 38, "N").otherwise("R").alias("predicted"), (q / 50).alias("score"), (F.col("l_discount") * 10).alias("y"))
    both = discovery.class_metrics(x).join(F.broadcast(discovery.regression_metrics(x.select(F.col("y").alias("label"), "score"))))
    return both.select("classes", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "mae", "mse", "rmse", "pearson")])


@query("""SELECT o_orderkey, round(greatest(0, least(1, (year(o_orderdate) - 1970) / 30)), 6)::DOUBLE AS recency, round(0.5 + (s - 0.5) * least(n / 5, 1), 6)::DOUBLE AS literature, round(0.6 * s + CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 0 END + 0.15 * least(n / 4, 1), 6)::DOUBLE AS biology, CASE WHEN s >= 0.7 THEN 'supported' WHEN s <= 0.3 THEN 'contradicted' ELSE 'inconclusive' END AS verdict,
  round(0.5 + CASE WHEN s > 0.7 THEN 0.2 WHEN s > 0.5 THEN 0.1 ELSE 0 END + CASE WHEN n > 6 THEN 0.15 WHEN n > 4 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS assessment FROM (SELECT *, (o_orderkey % 11)::DOUBLE / 10 AS s, o_custkey % 10 AS n FROM orders)""")
def hypothesis_checks(spark, d):
    s, n = (F.col("o_orderkey") % 11).cast("double") / 10, F.col("o_custkey") % 10
    r = lambda e, name: F.round(e.cast("double"), 6).alias(name)
    return table(spark, d, "orders").select(
        "o_orderkey", r(discovery.recency(F.year("o_orderdate"), 2000), "recency"), r(discovery.literature_check(s, n), "literature"), r(discovery.biology_check(s, F.col("o_orderkey") % 2 == 0, n), "biology"),
        discovery.verdict(s).alias("verdict"), r(discovery.assessment(s, n / 10), "assessment"),
    )


@query("""SELECT conv_id AS query_id, string_agg('[' || turn || '] (' || coalesce(nullif(role, 'user'), 'unknown') || ') ' || text, chr(10) || chr(10) ORDER BY turn) AS context, min(CASE WHEN conv_id % 3 = 0 THEN 'uid' || turn ELSE coalesce(nullif(role, 'user'), 'doc') || ':' || turn END) AS first_chunk FROM (SELECT DISTINCT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn) GROUP BY 1""")
def cited_contexts(spark, d):
    source = F.when(F.col("role") != "user", F.col("role"))
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    x = discovery.cited_context(c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), source.alias("source"), "text"))
    ids = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.min(discovery.chunk_id(F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("uid"), F.col("turn").cast("string"))), source, F.col("turn"))).alias("first_chunk"))
    return x.join(ids, "query_id")


@query("""WITH e AS (SELECT nullif('P' || l_partkey, 'P7') AS source, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'S' || (l_suppkey + l_linenumber % 2) END AS target FROM lineitem), n AS (SELECT CASE WHEN p_partkey % 100 <> 7 THEN 'P' || p_partkey END AS id FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier),
  x AS (SELECT unnest([source, target]) AS x FROM e) SELECT * FROM (SELECT 'node without id' AS error, count(*) AS n FROM n WHERE id IS NULL UNION ALL SELECT 'edge without source', count(*) FROM e WHERE source IS NULL UNION ALL SELECT 'edge without target', count(*) FROM e WHERE target IS NULL UNION ALL SELECT 'unknown end', count(*) FROM x WHERE x IS NOT NULL AND x NOT IN (SELECT id FROM n WHERE id IS NOT NULL)) WHERE n > 0""")
def graph_payload_errors(spark, d):
    p, s = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).cast("string"))
    e = table(spark, d, "lineitem").select(F.when(F.col("l_partkey") != 7, p).alias("source"), F.when(F.col("l_linenumber") != 7, s).alias("target"))
    n = table(spark, d, "part").select(F.when(F.col("p_partkey") % 100 != 7, F.concat(F.lit("P"), "p_partkey")).alias("id")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id")))
    return discovery.graph_errors(n, e)


@query(f"""WITH e AS (SELECT 'C' || o_custkey AS u, 'P' || m[2] AS v, 1 - m[6] * 8 AS c FROM {MAIN}), b AS (SELECT u, v FROM e WHERE c >= 0.5 UNION SELECT v, u FROM e WHERE c >= 0.5), s AS (SELECT DISTINCT 'S' || s_suppkey AS x, 'C' || s_suppkey AS node FROM supplier),
  h0 AS (SELECT node AS seed, node FROM s), h1 AS (SELECT DISTINCT seed, b.v AS node FROM h0 JOIN b ON b.u = node WHERE b.v <> seed), h2 AS (SELECT DISTINCT seed, b.v AS node FROM h1 JOIN b ON b.u = node WHERE b.v <> seed AND (seed, b.v) NOT IN (SELECT seed, node FROM h1)),
  a AS (SELECT seed, node, 0 AS hop FROM h0 UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2), k AS (SELECT seed, node, hop FROM a QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, node) <= 40),
  g AS (SELECT k.seed, k.node, count(*) AS degree FROM k JOIN b ON b.u = k.node JOIN k k2 ON k2.seed = k.seed AND k2.node = b.v GROUP BY 1, 2) SELECT k.*, coalesce(degree, 0) AS degree FROM k LEFT JOIN g USING (seed, node)""")
def ego_subgraphs(spark, d):
    m = main_lines(spark, d)
    e = m.select(F.concat(F.lit("C"), "o_custkey").alias("u"), F.concat(F.lit("P"), "m.l_partkey").alias("v"), (1 - F.col("m.l_discount") * 8).alias("confidence"))
    return discovery.ego_graphs(e, table(spark, d, "supplier").select(F.concat(F.lit("C"), "s_suppkey").alias("node")), cap=40)
