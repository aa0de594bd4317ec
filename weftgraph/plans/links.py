"""Link prediction on the temporal holdout: split, negatives, predictors, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import checkpointed, release
from ..operators import graph, metrics, predict, sampling, split, walks
from ..sources.tables import CUTOFF, assertions, backbone, main_lines, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def node_type(column: str):
    return F.substring(column, 1, 1)


def split_pairs_frame(spark: SparkSession, d: str) -> DataFrame:
    return split.temporal_split(assertions(spark, d), backbone(spark, d), CUTOFF)


class Holdout:
    """Split, training graph and scored pairs; those that are used many times are written once.

    With ``validation`` the latest training pairs are the tests, and the graph is that of the others.
    """

    def __init__(self, spark: SparkSession, d: str, validation: bool = False):
        self.split = checkpointed(split_pairs_frame(spark, d))
        self.known = self.split.select("u", "v")
        self.train = self.split.filter("role IN ('train', 'backbone')")
        self.test = self.split.filter("role = 'test'").select("u", "v")
        if validation:
            cut = checkpointed(split.validation_slice(self.split.filter("role = 'train'")))
            self.train = cut.filter("slice = 'fit'").select("u", "v").unionByName(self.split.filter("role = 'backbone'").select("u", "v"))
            nodes = self.train.select(F.explode(F.array("u", "v")).alias("n")).distinct()
            late = cut.filter("slice = 'validate'").select("u", "v")
            self.test = late.join(nodes.select(F.col("n").alias("u")), "u", "left_semi").join(nodes.select(F.col("n").alias("v")), "v", "left_semi").select("u", "v")
        release(spark)
        self.adj = checkpointed(graph.adjacency(self.train.select("u", "v")))
        release(spark)

    def pairs(self, degree_matched: bool = True) -> DataFrame:
        neg = sampling.negatives(self.test, self.adj, self.known, node_type, per_positive=2, seed=7, degree_matched=degree_matched)
        out = checkpointed(self.test.withColumn("is_pos", F.lit(True)).unionByName(neg.withColumn("is_pos", F.lit(False))))
        del neg
        release(out.sparkSession)
        return out

    def scores(self, *names: str) -> DataFrame:
        """(u, v, predictor, score, is_pos); predictors of shared neighbours and degrees come from one search."""
        pairs, names = self.pairs(), names or tuple(predict.PREDICTORS)
        near = [n for n in names if n in ("common_neighbours", "adamic_adar", "jaccard", "preferential_attachment")]
        out = None
        if len(near) > 1:
            out = predict.neighbour_scores(pairs, self.adj).select("u", "v", F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), F.col(n).alias("score")) for n in near])).alias("x")).select("u", "v", "x.score", "x.predictor")
        for name in names if out is None else [n for n in names if n not in near]:
            one = predict.PREDICTORS[name](pairs, self.adj).withColumn("predictor", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out.withColumn("score", F.round("score", 9)).join(pairs, ["u", "v"])


#: Oracle building blocks, DuckDB.
MAIN = "(SELECT l_orderkey, max((l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_discount, l_linestatus)) AS m FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey"
ASSERT = f"""assertions AS (SELECT 'C:' || o_custkey AS subject, 'P:' || m[2] AS object, CAST(year(o_orderdate) AS INTEGER) AS year, m[5] AS predicate, 1 - m[6] AS confidence, m[7] = 'O' AS negated FROM {MAIN}),
  pairs AS (SELECT least(subject, object) AS u, greatest(subject, object) AS v, * FROM assertions WHERE subject <> object)"""
SPLIT = f"""WITH {ASSERT},
  first AS (SELECT u, v, min(year) AS first_year FROM pairs GROUP BY u, v),
  fixed AS (SELECT 'P:' || l_partkey AS u, 'S:' || max((n, l_suppkey))[2] AS v FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_partkey),
  known0 AS (SELECT u, v FROM first WHERE first_year < {CUTOFF} UNION SELECT u, v FROM fixed),
  nodes AS (SELECT u AS n FROM known0 UNION SELECT v FROM known0),
  split AS (SELECT coalesce(f.u, x.u) AS u, coalesce(f.v, x.v) AS v, first_year,
      CASE WHEN first_year < {CUTOFF} THEN 'train' WHEN first_year IS NULL THEN 'backbone' WHEN x.u IS NOT NULL THEN 'known'
        WHEN coalesce(f.u, x.u) IN (SELECT n FROM nodes) AND coalesce(f.v, x.v) IN (SELECT n FROM nodes) THEN 'test' ELSE 'cold' END AS role
    FROM first f FULL JOIN fixed x ON f.u = x.u AND f.v = x.v),
  train AS (SELECT u, v FROM split WHERE role IN ('train', 'backbone')),
  adj AS (SELECT u AS node, v AS nbr FROM train UNION ALL SELECT v, u FROM train),
  deg AS (SELECT node, count(*) AS deg FROM adj GROUP BY node),
  test AS (SELECT u, v FROM split WHERE role = 'test')"""
_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
NEGATIVES = f""",
  pool0 AS (SELECT node, substr(node, 1, 1) || '/' || CAST(CAST(floor(log2(deg)) AS INTEGER) + 1 AS VARCHAR) AS pool, CAST('0x' || substr(md5(node), 1, 4) AS INTEGER) % 64 AS part FROM deg),
  pools AS (SELECT node, pool, row_number() OVER (PARTITION BY pool ORDER BY part, node) - 1 AS i, count(*) OVER (PARTITION BY pool) AS size FROM pool0),
  tries AS (SELECT t.u, t.v, j, pu.pool AS pu, pv.pool AS pv, {_DRAW.format("'7|' || t.u || '|' || t.v || '|' || j || '|a'")} % pu.size AS ia, {_DRAW.format("'7|' || t.u || '|' || t.v || '|' || j || '|b'")} % pv.size AS ib
    FROM test t JOIN pools pu ON pu.node = t.u JOIN pools pv ON pv.node = t.v, range(0, 8) r(j)),
  drawn AS (SELECT t.u, t.v, j, least(a.node, b.node) AS nu, greatest(a.node, b.node) AS nv FROM tries t JOIN pools a ON a.pool = t.pu AND a.i = t.ia JOIN pools b ON b.pool = t.pv AND b.i = t.ib WHERE a.node <> b.node),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY nu, nv ORDER BY u, v, j) AS r FROM drawn WHERE (nu, nv) NOT IN (SELECT u, v FROM split)),
  neg AS (SELECT nu AS u, nv AS v FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY j) AS q FROM fresh WHERE r = 1) WHERE q <= 2),
  sample AS (SELECT u, v, TRUE AS is_pos FROM test UNION ALL SELECT u, v, FALSE FROM neg)"""
SHARED = """,
  shared AS (SELECT s.u, s.v, a.nbr AS z, d.deg FROM sample s JOIN adj a ON a.node = s.u JOIN adj b ON b.node = s.v AND b.nbr = a.nbr JOIN deg d ON d.node = a.nbr)"""
_L3 = "SELECT s.u, s.v, sum(1 / sqrt(da.deg * db.deg)) AS score FROM sample s JOIN adj x ON x.node = s.u JOIN adj y ON y.node = x.nbr AND y.nbr <> s.u JOIN adj z ON z.node = y.nbr AND z.nbr = s.v JOIN deg da ON da.node = x.nbr JOIN deg db ON db.node = y.nbr GROUP BY s.u, s.v"
_FORMULA = {
    "common_neighbours": "SELECT u, v, count(*)::DOUBLE AS score FROM shared GROUP BY u, v",
    "adamic_adar": "SELECT u, v, sum(CASE WHEN deg > 1 THEN 1 / ln(deg) ELSE 1 END) AS score FROM shared GROUP BY u, v",
    "jaccard": "SELECT s.u, s.v, s.i / (du.deg + dv.deg - s.i) AS score FROM (SELECT u, v, count(*) AS i FROM shared GROUP BY u, v) s JOIN deg du ON du.node = s.u JOIN deg dv ON dv.node = s.v",
    "preferential_attachment": "SELECT s.u, s.v, (du.deg * dv.deg)::DOUBLE AS score FROM sample s JOIN deg du ON du.node = s.u JOIN deg dv ON dv.node = s.v",
    "l3_paths": _L3,
    "random": f"SELECT u, v, {_DRAW.format("'0|' || u || '|' || v")} / 4294967296.0 AS score FROM sample",
}
SCORED = SPLIT + NEGATIVES + SHARED + ",\n  scored AS (" + " UNION ALL ".join(f"SELECT '{n}' AS predictor, s.u, s.v, s.is_pos, round(coalesce(f.score, 0), 9) AS score FROM sample s LEFT JOIN ({q}) f ON f.u = s.u AND f.v = s.v" for n, q in _FORMULA.items()) + ")"
RANKED = """,
  ranked AS (SELECT *, count(*) FILTER (WHERE NOT is_pos) OVER (PARTITION BY {g} ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) FILTER (WHERE NOT is_pos) OVER (PARTITION BY {g}, score) AS tied, count(*) FILTER (WHERE NOT is_pos) OVER (PARTITION BY {g}) AS n FROM scored)"""
_METRICS = """count(*)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg, round(sum(2 * (upto - tied) + tied) / (2.0 * count(*) * max(n)), 6) AS auc, round(avg(1.0 / (n - upto + tied + 1)), 6) AS mrr,
  round(avg((n - upto + tied + 1 <= 1)::INT), 6) AS hits_1, round(avg((n - upto + tied + 1 <= 5)::INT), 6) AS hits_5, round(avg((n - upto + tied + 1 <= 10)::INT), 6) AS hits_10, round(avg((n - upto + tied + 1 <= 100)::INT), 6) AS hits_100, round(avg((2 * tied > n)::INT), 6) AS indistinct"""


@query(SPLIT + " SELECT role, count(*) AS pairs, min(first_year) AS first, max(first_year) AS last FROM split GROUP BY role")
def temporal_split_summary(spark, d):
    return split_pairs_frame(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("pairs"), F.min("first_year").alias("first"), F.max("first_year").alias("last"))


@query(SPLIT + " SELECT u, v, first_year, role FROM split")
def split_pairs(spark, d):
    return split_pairs_frame(spark, d)


@query(f"""WITH {ASSERT}, p AS (SELECT u, v, predicate, count(*) AS n FROM pairs WHERE year < {CUTOFF} GROUP BY u, v, predicate),
  top AS (SELECT u, v, predicate FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY n DESC, predicate) AS r FROM p) WHERE r = 1),
  e AS (SELECT u, v, count(*) AS support, sum(confidence) AS c, count(*) FILTER (WHERE negated) AS g FROM pairs WHERE year < {CUTOFF} GROUP BY u, v)
  SELECT e.u, e.v, support, round(c, 6) AS total_confidence, g AS negated_count, predicate AS dominant_predicate, round(greatest(0.05, c / support * ln(1 + support) * (1 - 0.5 * g / support)), 6) AS weight FROM e JOIN top ON top.u = e.u AND top.v = e.v""")
def edge_evidence_weights(spark, d):
    return split.evidence(assertions(spark, d), CUTOFF).withColumns({"total_confidence": F.round("total_confidence", 6), "weight": F.round("weight", 6)})


@query(f"WITH {ASSERT}, f AS (SELECT min(year) AS year FROM pairs GROUP BY u, v), c AS (SELECT year, count(*) AS pairs FROM f GROUP BY year) SELECT year, pairs, sum(pairs) OVER (ORDER BY year)::BIGINT AS cumulative FROM c")
def year_distribution(spark, d):
    return split.year_distribution(assertions(spark, d))


@query(SPLIT + NEGATIVES + " SELECT u, v FROM neg")
def hash_negatives(spark, d):
    h = Holdout(spark, d)
    return h.pairs().filter("NOT is_pos").select("u", "v")


def _predictor(name: str):
    def run(spark, d):
        return Holdout(spark, d).scores(name).select("u", "v", "is_pos", F.round("score", 6).alias("score"))

    run.__name__ = f"predict_{name}"
    query(SCORED + f" SELECT u, v, is_pos, round(score, 6) AS score FROM scored WHERE predictor = '{name}'")(run)


for _name in predict.PREDICTORS:
    _predictor(_name)


@query(SCORED.replace(_FORMULA["l3_paths"], _L3) + f""", p AS (SELECT least(subject, object) AS u, greatest(subject, object) AS v, count(*) AS support, sum(confidence) AS c, count(*) FILTER (WHERE negated) AS g FROM assertions WHERE year < {CUTOFF} GROUP BY 1, 2),
  w0 AS (SELECT t.u, t.v, CASE WHEN support IS NULL THEN 1 ELSE greatest(0.05, c / support * ln(1 + support) * (1 - 0.5 * g / support)) END AS w FROM train t LEFT JOIN p ON p.u = t.u AND p.v = t.v),
  wadj AS (SELECT u AS node, v AS nbr, w FROM w0 UNION ALL SELECT v, u, w FROM w0),
  l AS (SELECT s.u, s.v, sum(x.w * y.w * z.w / sqrt(da.deg) / sqrt(db.deg)) AS score FROM sample s JOIN wadj x ON x.node = s.u JOIN wadj y ON y.node = x.nbr AND y.nbr <> s.u JOIN wadj z ON z.node = y.nbr AND z.nbr = s.v JOIN deg da ON da.node = x.nbr JOIN deg db ON db.node = y.nbr GROUP BY s.u, s.v)
  SELECT s.u, s.v, s.is_pos, round(coalesce(score, 0), 6) AS score FROM sample s LEFT JOIN l ON l.u = s.u AND l.v = s.v""")
def predict_weighted_l3(spark, d):
    h = Holdout(spark, d)
    weights = split.evidence(assertions(spark, d), CUTOFF).select("u", "v", F.col("weight").alias("w0"))
    weighted = h.train.select("u", "v").join(weights, ["u", "v"], "left").withColumn("w0", F.coalesce("w0", F.lit(1.0)))
    pairs = h.pairs()
    return predict.l3_paths(pairs, graph.adjacency(weighted, "w0"), weighted=True).join(pairs, ["u", "v"]).select("u", "v", "is_pos", F.round("score", 6).alias("score"))


@query(SPLIT + NEGATIVES + """, m AS (SELECT a.node AS i, a.nbr AS j, 1 / sqrt(da.deg * db.deg) AS m FROM adj a JOIN deg da ON da.node = a.node JOIN deg db ON db.node = a.nbr),
  m2 AS (SELECT a.i, b.j, sum(a.m * b.m) AS m FROM m a JOIN m b ON b.i = a.j GROUP BY a.i, b.j), us AS (SELECT DISTINCT u AS i FROM sample), r2 AS (SELECT m2.* FROM m2 JOIN us USING (i)),
  r3 AS (SELECT a.i, b.j, sum(a.m * b.m) AS m FROM r2 a JOIN m b ON b.i = a.j GROUP BY a.i, b.j),
  p5 AS (SELECT s.u, s.v, sum(a.m * b.m) AS score FROM sample s JOIN r3 a ON a.i = s.u JOIN m2 b ON b.i = a.j AND b.j = s.v GROUP BY s.u, s.v)
  SELECT s.u, s.v, s.is_pos, round(coalesce(score, 0), 6) AS score FROM sample s LEFT JOIN p5 ON p5.u = s.u AND p5.v = s.v""")
def predict_path_power_5(spark, d):
    h = Holdout(spark, d)
    pairs = h.pairs()
    return predict.path_power(pairs, h.adj, 5, keep=("is_pos",)).select("u", "v", "is_pos", F.round("score", 6).alias("score"))


@query(SCORED + RANKED.format(g="predictor") + f" SELECT predictor, {_METRICS} FROM ranked WHERE is_pos GROUP BY predictor")
def link_auc_by_predictor(spark, d):
    return metrics.ranking(Holdout(spark, d).scores(), "predictor")


@query(SCORED + """, l AS (SELECT predictor, score, count(*) FILTER (WHERE is_pos) AS pos, count(*) AS n FROM scored GROUP BY 1, 2),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM l WINDOW w AS (PARTITION BY predictor ORDER BY score DESC)) SELECT predictor, round(sum(pos * tp / seen) / sum(pos), 6) AS ap FROM c GROUP BY predictor""")
def average_precision(spark, d):
    return metrics.average_precision(Holdout(spark, d).scores(), "predictor")


@query(SCORED.replace("scored AS (", "scored0 AS (") + ", scored AS (SELECT *, substr(u, 1, 1) || '-' || substr(v, 1, 1) AS type_pair FROM scored0)" + RANKED.format(g="predictor, type_pair") + f" SELECT predictor, type_pair, {_METRICS} FROM ranked WHERE is_pos AND n > 0 GROUP BY predictor, type_pair")
def auc_by_type_pair(spark, d):
    typed = Holdout(spark, d).scores().withColumn("type_pair", F.concat_ws("-", node_type("u"), node_type("v")))
    return metrics.ranking(typed, "predictor", "type_pair").filter("n_neg > 0")


@query()
def bootstrap_auc(spark, d):
    return metrics.bootstrap(Holdout(spark, d).scores("preferential_attachment", "l3_paths"), "predictor", resamples=200)


_PCT = """, r AS (SELECT predictor, u, v, is_pos, score, count(*) FILTER (WHERE NOT is_pos) OVER (PARTITION BY predictor ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) FILTER (WHERE NOT is_pos) OVER (PARTITION BY predictor, score) AS tied, count(*) FILTER (WHERE NOT is_pos) OVER (PARTITION BY predictor) AS n FROM scored WHERE predictor IN ('preferential_attachment', 'l3_paths')),
  pct AS (SELECT u, v, is_pos, max(CASE WHEN predictor = 'l3_paths' THEN (2 * upto - tied) / (2.0 * n) END) AS a, max(CASE WHEN predictor <> 'l3_paths' THEN (2 * upto - tied) / (2.0 * n) END) AS b FROM r GROUP BY u, v, is_pos)"""


def _blend(spark, d, validation: bool = False):
    scored = checkpointed(Holdout(spark, d, validation).scores("preferential_attachment", "l3_paths"))
    pct = metrics.percentiles(scored, scored.filter("NOT is_pos"), "predictor")
    one = lambda n: F.max(F.when(F.col("predictor") == n, F.col("pct")))
    return pct.groupBy("u", "v", "is_pos").agg(one("l3_paths").alias("a"), one("preferential_attachment").alias("b"))


@query(SCORED + _PCT + " SELECT u, v, is_pos, round(0.6 * a + 0.4 * b, 6) AS score FROM pct")
def percentile_blend(spark, d):
    return _blend(spark, d).select("u", "v", "is_pos", F.round(0.6 * F.col("a") + 0.4 * F.col("b"), 6).alias("score"))


VALIDATION = SPLIT.replace("train AS (SELECT u, v FROM split WHERE role IN ('train', 'backbone'))", """late AS (SELECT u, v, row_number() OVER (ORDER BY first_year DESC, u, v) AS k, count(*) OVER () AS n FROM split WHERE role = 'train'),
  train AS (SELECT u, v FROM late WHERE k > floor(n * 0.15) UNION ALL SELECT u, v FROM split WHERE role = 'backbone')""").replace("test AS (SELECT u, v FROM split WHERE role = 'test')", "test AS (SELECT u, v FROM late WHERE k <= floor(n * 0.15) AND u IN (SELECT node FROM deg) AND v IN (SELECT node FROM deg))")


@query(SCORED.replace(SPLIT, VALIDATION) + _PCT + ", scored2 AS (SELECT u, v, is_pos, weight, round(weight * a + (1 - weight) * b, 9) AS score FROM pct, (SELECT unnest([0.25, 0.4, 0.5, 0.6, 0.75])::DOUBLE AS weight))" + RANKED.format(g="weight").replace("ranked AS", "ranked2 AS").replace("FROM scored)", "FROM scored2)") + " SELECT weight, round(sum(2 * (upto - tied) + tied) / (2.0 * count(*) * max(n)), 6) AS auc FROM ranked2 WHERE is_pos GROUP BY weight")
def blend_weight_search(spark, d):
    """AUC of each weight on the latest training pairs; the test pairs take no part."""
    grid = F.explode(F.array(*[F.lit(w) for w in (0.25, 0.4, 0.5, 0.6, 0.75)])).alias("weight")
    x = _blend(spark, d, validation=True).select("u", "v", "is_pos", "a", "b", grid)
    x = x.withColumn("score", F.round(F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b"), 9))
    return metrics.ranking(x, "weight").select("weight", "auc")


_CAND = SPLIT + """, two AS (SELECT DISTINCT a.node AS u, b.nbr AS b FROM adj a JOIN adj b ON b.node = a.nbr WHERE b.nbr <> a.node),
  cand AS (SELECT DISTINCT t.u, c.nbr AS v FROM two t JOIN adj c ON c.node = t.b WHERE t.u < c.nbr AND substr(t.u, 1, 1) = 'C' AND substr(c.nbr, 1, 1) = 'P' AND (t.u, c.nbr) NOT IN (SELECT u, v FROM train))"""


def _candidates(spark, h: Holdout) -> DataFrame:
    wanted = spark.createDataFrame([("C", "P")], "t1 string, t2 string")
    return graph.candidates(h.adj, wanted, node_type)  # the training pairs are the graph's edges


@query(_CAND + " SELECT u, v FROM cand")
def candidate_pairs(spark, d):
    return _candidates(spark, Holdout(spark, d))


@query(_CAND + """, s AS (SELECT c.u, c.v, round(sum(1 / sqrt(da.deg * db.deg)), 9) AS score FROM cand c JOIN adj x ON x.node = c.u JOIN adj y ON y.node = x.nbr AND y.nbr <> c.u JOIN adj z ON z.node = y.nbr AND z.nbr = c.v JOIN deg da ON da.node = x.nbr JOIN deg db ON db.node = y.nbr GROUP BY c.u, c.v),
  r AS (SELECT row_number() OVER (ORDER BY score DESC, u, v) AS rank, (u, v) IN (SELECT u, v FROM test) AS hit FROM s), b AS (SELECT avg(hit::INT) AS base, count(*) AS n FROM r)
  SELECT k::INTEGER AS depth, count(*) FILTER (WHERE hit)::BIGINT AS hits, round(count(*) FILTER (WHERE hit) / least(k, n), 6) AS precision, round(count(*) FILTER (WHERE hit) / least(k, n) / base, 6) AS lift FROM (SELECT unnest([10, 50, 100, 500, 1000]) AS k), b, r WHERE rank <= k GROUP BY k, n, base""")
def precision_at_depth(spark, d):
    h = Holdout(spark, d)
    # only the report's depth is ranked; the base rate is that of all candidates
    top, totals = walks.ranked(h.adj, [("C", "P")], node_type, None, h.test, 1000)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "x", "y"))).select("rank", "hit")
    base = totals.select((F.col("hits") / F.nullif("n", F.lit(0))).alias("base"), "n")
    depths = ranked.withColumn("depth", F.explode(F.array(*[F.lit(k) for k in (10, 50, 100, 500, 1000)]))).filter("rank <= depth")
    x = depths.groupBy("depth").agg(F.sum(F.col("hit").cast("long")).alias("hits")).join(F.broadcast(base))
    p = F.col("hits") / F.least("depth", "n")
    return x.select("depth", "hits", F.round(p, 6).alias("precision"), F.round(F.try_divide(p, F.col("base")), 6).alias("lift"))


@query(SPLIT + " SELECT coalesce(type_pair, '*') AS type_pair, coalesce(role, '*') AS predicate, edges FROM (SELECT substr(u, 1, 1) || '-' || substr(v, 1, 1) AS type_pair, role, count(*) AS edges FROM split GROUP BY CUBE (1, 2))")
def graph_statistics(spark, d):
    return graph.statistics(split_pairs_frame(spark, d), "role", node_type)


@query(SPLIT + """, cc AS (SELECT DISTINCT o_custkey, m[2] AS l_partkey, m[3] AS l_suppkey FROM """ + MAIN + """), e0 AS (SELECT 'C' || o_custkey AS u, 'P' || l_partkey AS v FROM cc UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM cc UNION SELECT 'C' || o_custkey, 'S' || l_suppkey FROM cc),
  a2 AS (SELECT u AS node, v AS nbr FROM e0 UNION SELECT v, u FROM e0), d2 AS (SELECT node, count(*) AS deg FROM a2 GROUP BY node), t AS (SELECT a.node, count(*) AS t FROM a2 a JOIN a2 b ON a.node = b.node AND a.nbr < b.nbr JOIN a2 c ON c.node = a.nbr AND c.nbr = b.nbr GROUP BY a.node)
  SELECT count(*) AS nodes, sum(coalesce(t, 0))::BIGINT AS corners, round(avg(CASE WHEN deg > 1 THEN 2.0 * coalesce(t, 0) / (deg * (deg - 1)) ELSE 0 END), 6) AS average FROM d2 LEFT JOIN t USING (node)""")
def avg_clustering(spark, d):
    x = main_lines(spark, d)
    c, p, s = (F.concat(F.lit(k), col) for k, col in (("C", "o_custkey"), ("P", "m.l_partkey"), ("S", "m.l_suppkey")))
    edges = x.select(F.explode(F.array(F.struct(c.alias("u"), p.alias("v")), F.struct(p.alias("u"), s.alias("v")), F.struct(c.alias("u"), s.alias("v")))).alias("e")).select("e.*")
    k = graph.clustering(graph.adjacency(edges))
    return k.agg(F.count(F.lit(1)).alias("nodes"), F.sum("triangles").alias("corners"), F.round(F.avg("coefficient"), 6).alias("average"))


@query(SPLIT + NEGATIVES + SHARED + " SELECT is_pos, count(*) AS pairs, round(avg(((u, v) IN (SELECT u, v FROM shared))::INT), 6) AS coverage FROM sample GROUP BY is_pos")
def structural_coverage(spark, d):
    h = Holdout(spark, d)
    pairs = h.pairs()
    near = graph.shared_neighbours(pairs, h.adj).select("u", "v").distinct().withColumn("near", F.lit(1.0))
    return pairs.join(near, ["u", "v"], "left").groupBy("is_pos").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.coalesce("near", F.lit(0.0))), 6).alias("coverage"))


@query(SPLIT + " SELECT round(avg(same) FILTER (WHERE role IN ('train', 'backbone')), 6) AS same_type_edges, round(1 - avg(same) FILTER (WHERE role = 'test'), 6) AS cross_type_tests, coalesce(avg(same) FILTER (WHERE role IN ('train', 'backbone')) < 0.05 AND 1 - avg(same) FILTER (WHERE role = 'test') > 0.9, FALSE) AS multipartite FROM (SELECT role, (substr(u, 1, 1) = substr(v, 1, 1))::INT AS same FROM split)")
def edge_type_diagnostics(spark, d):
    x = split_pairs_frame(spark, d).withColumn("same", (node_type("u") == node_type("v")).cast("double"))
    edges, tests = F.avg(F.when(F.col("role").isin("train", "backbone"), F.col("same"))), 1 - F.avg(F.when(F.col("role") == "test", F.col("same")))
    return x.agg(F.round(edges, 6).alias("same_type_edges"), F.round(tests, 6).alias("cross_type_tests"), F.coalesce((edges < 0.05) & (tests > 0.9), F.lit(False)).alias("multipartite"))


@query(SPLIT + ", e AS (SELECT DISTINCT 'C:' || o_custkey AS u, 'P:' || l_partkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT u, v, (u, v) IN (SELECT u, v FROM test) AS leaked FROM e")
def leakage_guard(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    reversed_ = x.select(F.concat(F.lit("P:"), "l_partkey").alias("u"), F.concat(F.lit("C:"), "o_custkey").alias("v"))
    return split.drop_leaked(reversed_, Holdout(spark, d).test)


@query(SPLIT + """, r AS (SELECT u, v, seed, row_number() OVER (PARTITION BY seed ORDER BY substr(md5(seed || '|' || u || '|' || v), 1, 8) DESC, u, v) AS pos FROM test, range(0, 3) t(seed))
  SELECT u, v, sum(pos)::BIGINT AS positions FROM r GROUP BY u, v""")
def consensus_rank(spark, d):
    """Sum of per-seed positions; each seed's ranking is sorted by range, not in one task."""
    x = Holdout(spark, d).test.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = F.concat(F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), "u", "v")), 1, 8))
    x = x.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 2))
    sizes = x.groupBy("seed", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("seed", "bucket", (F.sum("n").over(Window.partitionBy("seed").orderBy(F.desc("bucket"))) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("seed", "bucket").orderBy(F.desc("key"), "u", "v"))
    return x.withColumn("rank", rank).join(sizes, ["seed", "bucket"]).groupBy("u", "v").agg(F.sum(F.col("rank") + F.col("before")).alias("positions"))


@query(SPLIT + f""", t AS (SELECT u, v, first_year FROM split WHERE role = 'train'), r AS (SELECT *, row_number() OVER (ORDER BY first_year DESC, u, v) AS k, count(*) OVER () AS n FROM t) SELECT u, v, first_year, CASE WHEN k <= floor(n * 0.15) THEN 'validate' ELSE 'fit' END AS slice FROM r""")
def temporal_validation_slice(spark, d):
    return split.validation_slice(split_pairs_frame(spark, d).filter("role = 'train'"))


@query(SPLIT + " SELECT node, substr(node, 1, 1) AS type, deg, round(ln(1 + deg), 6) AS log_degree, CAST(floor(log2(deg)) AS INTEGER) + 1 AS bucket, (substr(node, 1, 1) = 'C')::INT AS is_c, (substr(node, 1, 1) = 'P')::INT AS is_p, (substr(node, 1, 1) = 'S')::INT AS is_s FROM deg")
def node_features(spark, d):
    t = node_type("node")
    return graph.degrees(Holdout(spark, d).adj).select("node", t.alias("type"), "deg", F.round(F.log1p("deg"), 6).alias("log_degree"), sampling.degree_bucket(F.col("deg")).alias("bucket"), *[(t == k).cast("int").alias(f"is_{k.lower()}") for k in "CPS"])


@query(SPLIT + " SELECT n AS node, sum(w)::BIGINT AS priority FROM (SELECT u AS n, 1000 AS w FROM test UNION ALL SELECT v, 1000 FROM test UNION ALL SELECT u, 1 FROM train UNION ALL SELECT v, 1 FROM train) GROUP BY n")
def fetch_priority(spark, d):
    h = Holdout(spark, d)
    ends = lambda df, w: df.select(F.explode(F.array("u", "v")).alias("node"), F.lit(w).cast("long").alias("w"))
    return ends(h.test, 1000).unionByName(ends(h.train, 1)).groupBy("node").agg(F.sum("w").alias("priority"))


@query(SPLIT + """, w AS (SELECT a.node AS u, b.node AS v, sum(CASE WHEN deg > 1 THEN 1 / ln(deg) ELSE 1 END) AS raw, count(*) AS n_shared FROM adj a JOIN adj b ON a.nbr = b.nbr AND a.node < b.node JOIN deg d ON d.node = a.nbr GROUP BY 1, 2),
  o AS (SELECT * FROM w WHERE (u, v) NOT IN (SELECT u, v FROM train)) SELECT u, v, round(raw / (SELECT max(raw) FROM o), 9) AS score, n_shared FROM o WHERE round(raw / (SELECT max(raw) FROM o), 9) >= 0.7 ORDER BY score DESC, u, v LIMIT 100""")
def predict_non_edges(spark, d):
    return graph.non_edges_by_adamic_adar(Holdout(spark, d).adj)
