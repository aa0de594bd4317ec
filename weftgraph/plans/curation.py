"""Curated sources, ontologies, interactions and entity resolution on stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import checkpointed
from ..operators import graph, ingest, resolve
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _mutations(spark, d):
    """Gene by cohort counts: line items per brand and customer nation."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("p_brand").alias("symbol"), F.col("c_nationkey").alias("project")).agg(F.count(F.lit(1)).alias("occurrences"))


def _genes(spark, d):
    """Lengths: sizes per brand; every seventh brand has none."""
    x = table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("p_size").cast("long").alias("length"))
    return x.withColumn("length", F.when(F.substring("symbol", 7, 2).cast("int") % 7 != 0, F.col("length")))


def _cohorts(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("project")).agg(F.count(F.lit(1)).alias("cases"))


ENRICH = """WITH m AS (SELECT p_brand AS symbol, c_nationkey AS project, count(*) AS occurrences FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  g AS (SELECT p_brand AS symbol, sum(p_size) AS length FROM part GROUP BY 1 HAVING CAST(substr(p_brand, 7, 2) AS INTEGER) % 7 <> 0), c AS (SELECT c_nationkey AS project, count(*) AS cases FROM customer GROUP BY 1),
  x AS (SELECT m.*, cases, sum(occurrences) OVER (PARTITION BY project) * length / (SELECT sum(length) FROM g) AS expected FROM m JOIN g USING (symbol) JOIN c USING (project))"""


@query(ENRICH + " SELECT symbol, project, occurrences, cases, round(expected, 6) AS expected, round(occurrences / expected, 6) AS enrichment FROM x")
def background_enrichment(spark, d):
    x = ingest.enrichment(_mutations(spark, d), _genes(spark, d), _cohorts(spark, d))
    return x.withColumns({"expected": F.round("expected", 6), "enrichment": F.round("enrichment", 6)})


@query(ENRICH + " SELECT symbol, n_name AS cohort, round(occurrences / expected, 6) AS enrichment, round(least(occurrences / expected / 20, 1), 4) AS confidence FROM x JOIN nation ON n_nationkey = project WHERE occurrences / expected >= 1.1 AND occurrences >= 5")
def gene_cohort_edges(spark, d):
    x = ingest.enrichment(_mutations(spark, d), _genes(spark, d), _cohorts(spark, d)).filter("enrichment >= 1.1 AND occurrences >= 5")
    names = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("cohort"))
    return x.join(names, F.col("project") == F.col("n_nationkey")).select("symbol", "cohort", F.round("enrichment", 6).alias("enrichment"), F.round(F.least(F.col("enrichment") / 20, F.lit(1.0)), 4).alias("confidence"))


def _is_a(spark, d):
    """Type to region by way of brand, nation and supplier: a hierarchy of mixed depth."""
    p = table(spark, d, "part")
    rows = [p.select(F.concat(F.lit("part:"), "p_partkey").alias("child"), F.concat(F.lit("brand:"), "p_brand").alias("parent")), p.select(F.concat(F.lit("brand:"), "p_brand").alias("child"), F.concat(F.lit("type:"), "p_type").alias("parent"))]
    rows += [table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("region:"), "n_regionkey").alias("parent")), table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("child"), F.concat(F.lit("nation:"), "s_nationkey").alias("parent"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


_ISA = """is_a AS (SELECT 'part:' || p_partkey AS child, 'brand:' || p_brand AS parent FROM part UNION SELECT 'brand:' || p_brand, 'type:' || p_type FROM part UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
  up AS (SELECT child, parent AS ancestor, 1 AS step FROM is_a UNION SELECT up.child, is_a.parent, step + 1 FROM up JOIN is_a ON is_a.child = up.ancestor WHERE step < 6 AND is_a.parent <> up.child), closure AS (SELECT child, ancestor, min(step)::INTEGER AS step FROM up GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_ISA} SELECT * FROM closure")
def ontology_ancestors(spark, d):
    return graph.ancestors(_is_a(spark, d))


@query(f"""WITH RECURSIVE {_ISA}, terms AS (SELECT DISTINCT child AS term FROM is_a), targets AS (SELECT parent AS target FROM is_a WHERE parent LIKE 'type:%' OR parent LIKE 'region:1%' UNION SELECT child FROM is_a WHERE child LIKE '%:3'),
  hit AS (SELECT term, term AS target, 0 AS step FROM terms WHERE term IN (SELECT target FROM targets) UNION ALL SELECT child, ancestor, step FROM closure WHERE ancestor IN (SELECT target FROM targets)),
  best AS (SELECT term, target, step FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY step, target) AS r FROM hit) WHERE r = 1) SELECT terms.term, target, step::INTEGER AS step FROM terms LEFT JOIN best USING (term)""")
def ontology_match(spark, d):
    is_a = checkpointed(_is_a(spark, d))
    ends = is_a.select(F.col("parent").alias("target")).filter("target LIKE 'type:%' OR target LIKE 'region:1%'").unionByName(is_a.select(F.col("child").alias("target")).filter("target LIKE '%:3'")).distinct()
    return ingest.match_by_ancestor(is_a.select(F.col("child").alias("term")).distinct(), graph.ancestors(is_a), ends)


def _links(spark, d):
    """Part pairs of one order; channels from quantity, price and discount."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount").withColumn("n", F.concat(F.lit("P"), "l_partkey"))
    a, b = x.alias("a"), x.alias("b")
    pair = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.n") < F.col("b.n")))
    score = lambda e: F.floor(e).cast("int")
    return pair.select(F.col("a.n").alias("b"), F.col("b.n").alias("a"), score((F.col("a.l_quantity") + F.col("b.l_quantity")) * 9).alias("experimental"), score((F.col("a.l_extendedprice") + F.col("b.l_extendedprice")) / 200).alias("coexpression"), score(F.greatest("a.l_discount", "b.l_discount") * 9000).alias("database"))


_LINKS = """WITH x AS (SELECT l_orderkey, 'P' || l_partkey AS n, l_quantity AS q, l_extendedprice AS e, l_discount AS d FROM lineitem),
  links AS (SELECT a.n AS a, b.n AS b, floor((a.q + b.q) * 9)::INTEGER AS experimental, floor((a.e + b.e) / 200)::INTEGER AS coexpression, floor(greatest(a.d, b.d) * 9000)::INTEGER AS database FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.n < b.n)"""


@query(_LINKS + """, s AS (SELECT a, b, greatest(experimental, coexpression) AS score, CASE WHEN experimental >= coexpression THEN 'experimental' ELSE 'coexpression' END AS channel FROM links)
  SELECT a, b, score, channel FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, channel DESC) AS r FROM s WHERE score >= 400) WHERE r = 1""")
def ppi_best_channel(spark, d):
    return ingest.interactions(_links(spark, d), ("experimental", "coexpression"), ("experimental", "coexpression", "database"))


@query(_LINKS + ", l AS (UNPIVOT links ON experimental, coexpression, database INTO NAME channel VALUE score) SELECT channel, count(*) AS edges FROM (SELECT DISTINCT a, b, channel FROM l WHERE score >= 400) GROUP BY channel")
def channel_report(spark, d):
    return ingest.channel_report(_links(spark, d), ("experimental", "coexpression", "database"))


@query("""SELECT p_partkey, 'GENE:' || CASE WHEN p_size % 3 = 0 THEN upper(trim(p_name)) ELSE p_size::VARCHAR END AS gene, 'DISEASE:' || CASE WHEN p_size % 4 = 0 THEN upper(trim(p_type)) ELSE p_size::VARCHAR END AS disease, 'DRUG:' || upper(trim(p_brand)) AS drug,
  lower(regexp_replace(p_name, '[\\s\\-_/.]+', '', 'g')) AS tight, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS folded FROM part""")
def canonical_ids(spark, d):
    p = table(spark, d, "part")
    entrez = F.when(F.col("p_size") % 3 == 0, F.lit("nan")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    doid = F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return p.select("p_partkey", ingest.gene_id(entrez, F.col("p_name")).alias("gene"), ingest.named_id("DISEASE", F.col("p_type"), doid).alias("disease"), ingest.named_id("DRUG", F.col("p_brand")).alias("drug"), T.fold_tight(F.col("p_name")).alias("tight"), T.fold_words(F.col("p_brand")).alias("folded"))


@query("""SELECT l_orderkey, l_linenumber, round(least(1, CASE l_linenumber WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 WHEN 4 THEN 0.45 WHEN 5 THEN 0.3 ELSE 0.5 END::DOUBLE * CASE WHEN l_quantity <= 5 THEN 0.85::DOUBLE + 0.06::DOUBLE * l_quantity ELSE 1 END), 6) AS confidence FROM lineitem""")
def evidence_confidence(spark, d):
    level = F.element_at(F.array(*[F.lit(x) for x in "ABCDEFGHIJ"]), F.col("l_linenumber"))
    rating = F.when(F.col("l_quantity") <= 5, F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(ingest.confidence(level, rating), 6).alias("confidence"))


_KINDS = [*ingest.PREDICATES, ("Functional", "Unknown")]


def _evidence(spark, d):
    kind = F.element_at(F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("s")) for a, b in _KINDS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 11 + 1).cast("int"))
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("evidence_id"), F.concat(F.lit("V:"), "l_partkey").alias("subject"), kind["t"].alias("evidence_type"), kind["s"].alias("significance"),
        F.when(F.col("l_returnflag") != "N", F.upper(F.col("p_type"))).alias("disease"), F.when(F.col("l_tax") > 0.02, ingest.values(F.concat_ws(" , ", F.col("p_brand"), F.lit(""), F.concat(F.lit("S"), "l_suppkey")))).otherwise(F.array().cast("array<string>")).alias("therapies"),
        ingest.values(F.when(F.col("l_discount") > 0.08, F.lit("late, nan,"))).alias("phenotypes"), F.when(F.col("l_linestatus") == "O", "Does Not Support").otherwise("Supports").alias("direction"),
    )


@query("""WITH e AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'V:' || l_partkey AS subject, (l_orderkey + l_linenumber) % 11 AS k, CASE WHEN l_returnflag <> 'N' THEN upper(p_type) END AS disease, CASE WHEN l_tax > 0.02 THEN [p_brand, 'S' || l_suppkey] ELSE [] END AS th, l_discount > 0.08 AS late, l_linestatus = 'O' AS negated FROM lineitem JOIN part ON l_partkey = p_partkey),
  k AS (SELECT *, CASE k WHEN 0 THEN 'SENSITIZES_TO' WHEN 1 THEN 'RESISTANT_TO' WHEN 2 THEN 'RESISTANT_TO' WHEN 3 THEN 'RESISTANT_TO' WHEN 4 THEN 'PREDICTS_POOR_OUTCOME' WHEN 5 THEN 'PREDICTS_BETTER_OUTCOME' WHEN 6 THEN 'DIAGNOSTIC_FOR' WHEN 7 THEN 'EXCLUDES_DIAGNOSIS' WHEN 8 THEN 'PREDISPOSES_TO' WHEN 9 THEN 'CAUSES' ELSE 'ASSOCIATED_WITH' END AS p, k < 4 AND len(th) > 0 AS is_t FROM e),
  r AS (SELECT id, subject AS s, p, unnest(th) AS o, negated FROM k WHERE is_t UNION ALL SELECT id, subject, CASE WHEN is_t THEN 'ASSOCIATED_WITH' ELSE p END, disease, negated FROM k WHERE disease IS NOT NULL
    UNION ALL SELECT id, subject, 'PRESENTS_WITH', 'late', negated FROM k WHERE late UNION ALL SELECT id, unnest(th), 'TREATS', disease, negated FROM k WHERE disease IS NOT NULL)
  SELECT p AS predicate, negated, count(DISTINCT (id, p, s, o)) AS relations FROM r GROUP BY p, negated""")
def relation_fan_out(spark, d):
    kinds = F.broadcast(ingest.predicate_table(spark))
    x = _evidence(spark, d).join(kinds, ["evidence_type", "significance"], "left").withColumn("predicate", F.coalesce("predicate", F.lit("ASSOCIATED_WITH"))).withColumn("kind", F.coalesce("target", F.lit("disease")))
    return ingest.fan_out(x).groupBy("predicate", "negated").agg(F.count(F.lit(1)).alias("relations"))


@query("""WITH v AS (SELECT upper(trim(p_brand || ' ' || p_type)) AS key, min('V' || p_partkey) AS variant_id FROM part GROUP BY 1),
  e AS (SELECT o_orderkey AS evidence_id, upper(CASE o_orderkey % 3 WHEN 0 THEN 'brand#' || (o_custkey % 25 + 1) || ' economy' WHEN 1 THEN 'brand#' || (o_custkey % 25 + 1) || ' economy AND brand#' || (o_custkey % 7 + 1) || ' promo' ELSE 'brand#99 economy or brand#' || (o_custkey % 9 + 1) || ' economy' END) AS whole FROM orders),
  h AS (SELECT e.*, variant_id FROM e LEFT JOIN v ON v.key = whole), parts AS (SELECT evidence_id, unnest(regexp_split_to_array(whole, '\\s+(?:AND|OR)\\s+')) AS part FROM h WHERE variant_id IS NULL)
  SELECT evidence_id, variant_id FROM h WHERE variant_id IS NOT NULL UNION ALL SELECT DISTINCT evidence_id, v.variant_id FROM parts JOIN v ON v.key = trim(part)""")
def molecular_profiles(spark, d):
    v = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name"), F.concat(F.lit("V"), "p_partkey").alias("variant_id"))
    b = lambda n: F.concat(F.lit("brand#"), (F.col("o_custkey") % n + 1).cast("string"))
    profile = F.when(F.col("o_orderkey") % 3 == 0, F.concat(b(25), F.lit(" economy"))).when(F.col("o_orderkey") % 3 == 1, F.concat(b(25), F.lit(" economy AND "), b(7), F.lit(" promo"))).otherwise(F.concat(F.lit("brand#99 economy or "), b(9), F.lit(" economy")))
    return ingest.resolve_profiles(table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id"), profile.alias("profile")), v)


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Study ' || o_custkey || ' of 1000 patients, ' || year(o_orderdate) WHEN o_orderkey % 4 = 1 THEN 'Levine et al., ' || year(o_orderdate) || ' cited in 1875' WHEN o_orderkey % 4 = 2 THEN 'no year here' END AS citation FROM orders)
  SELECT o_orderkey, CAST(list_extract(regexp_extract_all(citation, '\\b(19[5-9][0-9]|20[0-4][0-9])\\b', 1), -1) AS INTEGER) AS year FROM x""")
def publication_year(spark, d):
    y = F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    citation = F.when(k == 0, F.concat(F.lit("Study "), F.col("o_custkey").cast("string"), F.lit(" of 1000 patients, "), y)).when(k == 1, F.concat(F.lit("Levine et al., "), y, F.lit(" cited in 1875"))).when(k == 2, "no year here")
    return table(spark, d, "orders").select("o_orderkey", T.publication_year(citation).alias("year"))


def _entities(spark, d):
    """Customers and suppliers as entities; names vary in case and separators, some share identifiers or synonyms."""
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), F.lpad("c_custkey", 8, "0")).alias("id"), F.lit("PERSON").alias("type"), F.concat(F.lit("name-"), F.md5((F.col("c_custkey") % 400).cast("string")), F.when(F.col("c_custkey") % 11 == 0, "x").otherwise("")).alias("name"), F.array(F.concat(F.lit("syn "), F.md5(F.concat(F.lit("s"), F.floor(F.col("c_custkey") / 3).cast("string"))))).alias("synonyms"), F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("X"), (F.col("c_custkey") % 200).cast("string"))).alias("xref"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.lpad("s_suppkey", 8, "0")).alias("id"), F.lit("FIRM").alias("type"), F.concat(F.lit("Name_"), F.md5((F.col("s_suppkey") % 40).cast("string"))).alias("name"), F.array().cast("array<string>").alias("synonyms"), F.lit(None).cast("string").alias("xref"))
    return c.unionByName(s)


_ENT = """ent AS (SELECT 'C' || lpad(c_custkey::VARCHAR, 8, '0') AS id, 'PERSON' AS type, 'name-' || md5((c_custkey % 400)::VARCHAR) || CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END AS name, ['syn ' || md5('s' || (c_custkey // 3))] AS synonyms, CASE WHEN c_custkey % 50 = 0 THEN 'X' || (c_custkey % 200) END AS xref FROM customer
    UNION ALL SELECT 'S' || lpad(s_suppkey::VARCHAR, 8, '0'), 'FIRM', 'Name_' || md5((s_suppkey % 40)::VARCHAR), [], NULL FROM supplier),
  surf AS (SELECT id, type, unnest(list_concat([name], synonyms)) AS s FROM ent), fold AS (SELECT DISTINCT id, type, regexp_replace(lower(s), '[\\s\\-_/.]+', '', 'g') AS k FROM surf),
  nm AS (SELECT id, type, regexp_replace(lower(name), '[\\s\\-_/.]+', '', 'g') AS k FROM ent), rep AS (SELECT type, k, min(id) AS id FROM nm GROUP BY 1, 2),
  e0 AS (SELECT a.id AS a, b.id AS b FROM fold a JOIN fold b ON a.type = b.type AND a.k = b.k AND a.id <> b.id UNION SELECT a.id, b.id FROM ent a JOIN ent b ON a.xref = b.xref AND a.id <> b.id
    UNION SELECT a.id, b.id FROM rep a JOIN rep b ON a.type = b.type AND substr(a.k, 1, 8) = substr(b.k, 1, 8) AND a.id <> b.id AND 1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)) >= 0.9),
  reach AS (SELECT id, id AS r FROM ent UNION SELECT reach.id, e0.b FROM reach JOIN e0 ON e0.a = reach.r), cl AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"""


@query(f"WITH RECURSIVE {_ENT} SELECT id, cluster FROM cl")
def resolve_components(spark, d):
    return resolve.resolve(_entities(spark, d), 0.9, prefix=8)


@query(f"""WITH RECURSIVE {_ENT}, j AS (SELECT ent.*, cluster, row_number() OVER (PARTITION BY cluster ORDER BY xref IS NULL, -len(synonyms), ent.id) AS r FROM ent JOIN cl ON cl.id = ent.id),
  s AS (SELECT cluster, count(DISTINCT s) AS n_surfaces, md5(string_agg(DISTINCT s, '|' ORDER BY s)) AS surfaces FROM (SELECT cluster, unnest(list_concat([name], synonyms)) AS s FROM j) GROUP BY 1), m AS (SELECT cluster, min(xref) AS xref, count(*) AS members FROM j GROUP BY 1)
  SELECT m.cluster, j.id, j.name, j.type, m.xref, m.members, n_surfaces, surfaces FROM m JOIN s USING (cluster) JOIN j ON j.cluster = m.cluster AND j.r = 1""")
def cluster_collapse(spark, d):
    e = _entities(spark, d)
    out = resolve.collapse(e, resolve.resolve(e, 0.9, prefix=8))
    return out.select("cluster", "id", "name", "type", "xref", "members", F.size("surfaces").cast("long").alias("n_surfaces"), F.md5(F.array_join("surfaces", "|")).alias("surfaces"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), x AS (SELECT p_name, regexp_replace(lower(p_name), '[\\s\\-_/.]+', '', 'g') AS k FROM n), r AS (SELECT k, min(p_name) AS id FROM x GROUP BY k)
  SELECT a.id AS a, b.id AS b, round(1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)), 6) AS similarity FROM r a JOIN r b ON substr(a.k, 1, 1) = substr(b.k, 1, 1) AND a.id < b.id WHERE 1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)) >= 0.6""")
def levenshtein_block_join(spark, d):
    e = table(spark, d, "part").select(F.col("p_name").alias("id"), F.lit("PART").alias("type"), F.col("p_name").alias("name")).distinct()
    return resolve.fuzzy_edges(e, 0.6).withColumn("similarity", F.round("similarity", 6))


_MENTIONS = "m AS (SELECT o_custkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE replace(p_name, ' ', '-') END AS text, p_type AS label, 1 - l_discount AS confidence, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


def _mentions(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_linenumber") % 3
    text = F.when(k == 0, F.upper("p_name")).when(k == 1, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return x.select(F.col("o_custkey").alias("doc_id"), text.alias("text"), F.col("p_type").alias("label"), (1 - F.col("l_discount")).alias("confidence"))


@query(f"""WITH {_MENTIONS}, x AS (SELECT doc_id, text, upper(label) AS label, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS folded, confidence FROM m), s AS (SELECT label, folded, text, count(*) AS n FROM x GROUP BY 1, 2, 3),
  b AS (SELECT *, row_number() OVER (PARTITION BY label, folded ORDER BY n DESC, length(text), text) AS r, count(*) OVER (PARTITION BY label, folded) AS n_surfaces FROM s),
  g AS (SELECT label, folded, count(*) AS mentions, count(DISTINCT doc_id) AS documents, round(avg(confidence), 9) AS mean_confidence, max(confidence) AS max_confidence FROM x GROUP BY 1, 2)
  SELECT g.*, b.text AS canonical, n_surfaces, lower(g.label) || '_' || substr(md5(g.label || '|' || g.folded), 1, 12) AS node_id FROM g JOIN b ON b.label = g.label AND b.folded = g.folded AND r = 1""")
def mention_resolution(spark, d):
    return resolve.resolve_mentions(_mentions(spark, d))


@query("""SELECT 'C' || o_custkey AS subject, 'P' || l_partkey AS object, count(*) AS mentions, max(1 - l_discount) AS confidence, min_by(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS predicate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def edge_aggregate(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.select(F.concat(F.lit("C"), "o_custkey").alias("subject"), F.concat(F.lit("P"), "l_partkey").alias("object"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_returnflag").alias("predicate"), F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("pos"))
    return resolve.aggregate_edges(x, ["subject", "object"], ["predicate"], "pos")


@query("""WITH t AS (SELECT p_partkey AS id, p_brand AS ontology, p_name AS name, [p_type || ' ' || (p_partkey % 40)] AS synonyms FROM part),
  x AS (SELECT id, ontology, name AS s, 0 AS rank FROM t UNION ALL SELECT id, ontology, unnest(synonyms), 1 FROM t), k AS (SELECT trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS surface, * FROM x)
  SELECT surface, id FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY rank, ontology, id) AS r FROM k) WHERE r = 1""")
def ontology_surfaces(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("ontology"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_type", (F.col("p_partkey") % 40).cast("string"))).alias("synonyms"))
    return ingest.surfaces(t)
