"""Mentions, relations and links in text, as span frames (doc_id, start, end, ...), 0-based, ends exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import checkpointed
from ..functions.text import NEGATIONS, NOT_GENES, TRIGGERS, WORD


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, i, token, start, end) of the words of each text.

    Starts are found by the lengths of what lies between words, in one pass over the text.
    """
    between = F.split(F.col("text"), WORD)
    found = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    pieces = docs.select("doc_id", found.alias("w"), F.transform(between, lambda x: F.length(x)).alias("g")).filter(F.size("w") > 0)
    rows = pieces.select("doc_id", F.posexplode(F.arrays_zip("w", "g")).alias("i", "x"))
    width = F.length("x.w") + F.col("x.g")
    w = Window.partitionBy("doc_id").orderBy("i")
    end = F.sum(width).over(w)
    return rows.filter("x.w IS NOT NULL").select("doc_id", "i", F.col("x.w").alias("token"), (end - F.length("x.w")).cast("int").alias("start"), end.cast("int").alias("end"))


def gene_mentions(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, text): words of capitals and digits, 3 to 11 long, that are in the vocabulary if there is one."""
    x = tokens(docs).filter(F.col("token").rlike("^[A-Z][A-Z0-9]{2,10}$") & (F.length("token") <= 10) & ~F.col("token").isin(*NOT_GENES))
    if vocabulary is not None:
        x = x.join(vocabulary.select(F.upper("token").alias("token")).distinct(), "token", "left_semi")
    return x.select("doc_id", "start", "end", F.col("token").alias("text"))


def alias_mentions(docs: DataFrame, aliases: DataFrame, longest: int = 4) -> DataFrame:
    """(doc_id, start, end, node_id): leftmost, longest aliases of up to ``longest`` words, whole words, any case.

    Texts are cut into word n-grams that meet the aliases in an equi-join; within a
    document, a mention that overlaps one before it, or a longer one at its start, goes.
    Aliases under 3 characters don't count; an alias of several nodes gives each.
    """
    t = tokens(docs).withColumn("low", F.lower("token"))
    w = Window.partitionBy("doc_id").orderBy("i")
    keyed = aliases.filter(F.length("alias") >= 3).select(F.array_join(F.regexp_extract_all(F.lower("alias"), F.lit(f"({WORD})"), 1), " ").alias("key"), "node_id").distinct()
    grams = None
    for n in range(1, longest + 1):
        words = [F.lead("low", k).over(w) for k in range(n)]
        one = t.select("doc_id", "i", F.lit(n).alias("n"), "start", F.lead("end", n - 1).over(w).alias("end"), F.when(words[-1].isNotNull(), F.concat_ws(" ", *words)).alias("key")).filter("key IS NOT NULL")
        grams = one if grams is None else grams.unionByName(one)
    hit = grams.join(keyed.select("key").distinct(), "key", "left_semi")
    best = hit.groupBy("doc_id", "i").agg(F.max(F.struct("n", "start", "end", "key")).alias("b")).select("doc_id", "i", "b.*")
    runs = best.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "n", "start", "end", "key"))).alias("xs"))
    begin = F.expr("struct(0 AS free, CAST(array() AS array<struct<i:int,n:int,start:int,end:int,key:string>>) AS kept)")
    kept = F.aggregate("xs", begin, lambda a, x: F.when(x["i"] < a["free"], a).otherwise(F.struct((x["i"] + x["n"]).alias("free"), F.concat(a["kept"], F.array(x)).alias("kept"))), lambda a: a["kept"])
    return runs.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.start", "x.end", "x.key").join(keyed, "key").select("doc_id", "start", "end", "node_id")


def trigger_relations(sentences: DataFrame, mentions: DataFrame, pairs: int = 60, gap: int = 120) -> DataFrame:
    """(doc_id, sentence, subject, predicate, object, confidence) of mention pairs in a sentence.

    Ordered pairs, the first ``pairs`` of a sentence; the lower-case text between them must not be
    blank, exceed ``gap`` characters, or hold a negation; the longest trigger in it wins. Gaps
    up to 40 characters give 0.75, longer ones 0.55. Sentences are (doc_id, sentence, text); mentions
    (doc_id, sentence, start, end, text) lie in them.
    """
    m = mentions.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "sentence").orderBy("start", "end", "text"))).filter(F.col("k") <= pairs + 1)
    a, b = m.alias("a"), m.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.sentence") == F.col("b.sentence")) & (F.col("a.k") < F.col("b.k"))
    two = a.join(b, same).select("a.doc_id", "a.sentence", F.col("a.text").alias("x"), F.col("b.text").alias("y"), F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), F.col("a.end").alias("end"), F.col("b.start").alias("start"))
    two = two.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "sentence").orderBy("ka", "kb"))).filter(F.col("r") <= pairs)
    two = two.filter((F.lower("x") != F.lower("y")) & (F.col("start") > F.col("end")))
    between = two.join(sentences, ["doc_id", "sentence"]).withColumn("gap", F.lower(F.substr("text", F.col("end") + 1, F.col("start") - F.col("end"))))
    plain = between.filter((F.trim("gap") != "") & (F.length("gap") <= gap) & ~F.exists(F.array(*[F.lit(n) for n in NEGATIONS]), lambda n: F.contains(F.col("gap"), n)))
    rules = F.array(*[F.struct(F.lit(len(t)).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(r).alias("r")) for i, (t, p, r) in enumerate(TRIGGERS)])
    found = plain.withColumn("rule", F.array_max(F.filter(rules, lambda r: F.contains(F.col("gap"), r["t"])))).filter("rule IS NOT NULL")
    swap = F.col("rule.r")
    return found.select("doc_id", "sentence", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("subject"), F.col("rule.p").alias("predicate"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("object"), F.when(F.length("gap") <= 40, 0.75).otherwise(0.55).alias("confidence"))


def dedupe_mentions(mentions: DataFrame) -> DataFrame:
    """One mention per (doc_id, lower text, start, end, label), the most confident."""
    best = mentions.groupBy("doc_id", F.lower("text").alias("low"), "start", "end", "label").agg(F.max(F.struct("confidence", "text")).alias("b"))
    return best.select("doc_id", "b.text", "start", "end", "label", "b.confidence")


def cooccurrence(mentions: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, weight): pairs of terms in one document, every pair of mentions counted, a term with itself too.

    Mentions are counted by document and term before terms meet, so a repeated term costs one row.
    """
    n = mentions.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.term") <= F.col("b.term")))
    count = F.when(F.col("a.term") == F.col("b.term"), F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    x = pairs.groupBy(F.col("a.term").alias("a"), F.col("b.term").alias("b")).agg(F.sum(count).cast("long").alias("n"))
    return x.filter(F.col("n") >= least).withColumn("weight", F.least(F.col("n") / 10, F.lit(1.0)))


def tfidf_cosine(pairs: DataFrame) -> DataFrame:
    """(pair, cosine) of (pair, a, b): TF-IDF of words and word pairs, with idf ln(3 / (1 + df)) + 1 over the two texts."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]{2,})"), 1)
    grams = lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>")))
    x = pairs.select("pair", words(F.col("a")).alias("wa"), words(F.col("b")).alias("wb"))
    t = x.select("pair", F.explode(grams(F.col("wa"))).alias("t"), F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(x.select("pair", F.explode(grams(F.col("wb"))).alias("t"), F.lit(0).alias("na"), F.lit(1).alias("nb")))
    tf = t.groupBy("pair", "t").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    idf = F.log(3 / (1 + (F.col("na") > 0).cast("int") + (F.col("nb") > 0).cast("int"))) + 1
    v = tf.withColumn("x", F.col("na") * idf).withColumn("y", F.col("nb") * idf)
    dot = v.groupBy("pair").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"))
    scored = dot.select("pair", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("d") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0).alias("cosine"))
    return pairs.select("pair").join(scored, "pair", "left").select("pair", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def _subsets(terms):
    """All subsets of an array but the empty one, each in the array's order."""
    none = F.expr("array(CAST(array() AS array<string>))")
    return F.filter(F.aggregate(terms, none, lambda a, x: F.concat(a, F.transform(a, lambda s: F.concat(s, F.array(x))))), lambda s: F.size(s) > 0)


def shared_context_patterns(terms: DataFrame, least: int = 2, widest: int = 10) -> DataFrame:
    """(context, n_pairs, strength): pairs of entities of (entity, term) by the identical set of terms they share.

    Entities of one set of terms are counted as one. Pairs that share at least a set follow from
    its number of entities; those that share exactly it, by inclusion and exclusion over the sets
    around it. So no pair is formed among sets of up to ``widest`` terms; wider ones meet all
    others in a join. Strength is min(n / 3, 1).
    """
    t = terms.filter((F.length("term") > 2) & F.col("entity").isNotNull()).select("entity", "term").distinct()
    sets = t.groupBy("entity").agg(F.sort_array(F.collect_list("term")).alias("terms")).groupBy("terms").agg(F.count(F.lit(1)).alias("n"))
    sets = checkpointed(sets.withColumn("id", F.monotonically_increasing_id()))
    wide = F.size("terms") > widest
    within = sets.filter(~wide).select(F.explode(_subsets(F.col("terms"))).alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n")).filter("n > 1")
    sign = F.when((F.size("t") - F.size("s")) % 2 == 0, 1).otherwise(-1)
    split = within.select(F.col("s").alias("t"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n")).select("t", "n", F.explode(_subsets(F.col("t"))).alias("s"))
    exact = split.groupBy("s").agg(F.sum(F.col("n") * sign).alias("n"))
    if not sets.filter(wide).isEmpty():
        own = sets.filter(wide).select(F.col("terms").alias("s"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"))
        a = sets.filter(wide).select("id", "n", F.explode("terms").alias("term")).alias("a")
        b = sets.select("id", "n", wide.alias("wide"), F.explode("terms").alias("term")).alias("b")
        met = a.join(b, (F.col("a.term") == F.col("b.term")) & (~F.col("b.wide") | (F.col("a.id") < F.col("b.id"))))
        two = met.groupBy("a.id", "b.id").agg(F.sort_array(F.collect_list("a.term")).alias("s"), F.max(F.col("a.n") * F.col("b.n")).alias("n")).select("s", "n")
        exact = exact.unionByName(own).unionByName(two)
    x = exact.groupBy(F.array_join("s", " ").alias("context")).agg(F.sum("n").alias("n_pairs"))
    return x.filter(F.col("n_pairs") >= least).withColumn("strength", F.round(F.least(F.col("n_pairs") / 3, F.lit(1.0)), 6))


def missing_links(members: DataFrame, edges: DataFrame, least: int = 3, first: int = 10) -> DataFrame:
    """(pathway, a, b): member pairs without a directed edge, the first ``first`` of each pathway of ``least`` members or more.

    A member's open pairs are those with later members less its edges among them, so pairs are formed
    only for the at most ``first`` members that give the result. They are sought among the first
    members of each pathway, and among more as long as a pathway has too few open pairs there.
    """
    m = members.distinct()
    big = m.groupBy("pathway").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    m = checkpointed(m.filter("member IS NOT NULL").join(big.select("pathway"), "pathway", "left_semi"))
    sizes = m.groupBy("pathway").agg(F.count(F.lit(1)).alias("n"))
    order, among = Window.partitionBy("pathway").orderBy("member"), 2 * first
    while True:
        head = m.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= among)
        head = checkpointed(head.join(sizes, "pathway").select("pathway", F.col("member").alias("a"), "r", "n"))
        of = head.select(F.col("a").alias("u")).distinct()
        out = edges.select("u", "v").join(F.broadcast(of) if head.count() <= 1 << 17 else of, "u", "left_semi").distinct()
        pair = out.join(head.select("pathway", "a"), F.col("u") == F.col("a")).filter("v > a").select("pathway", "a", F.col("v").alias("b"))
        linked = checkpointed(pair.join(m.select("pathway", F.col("member").alias("b")), ["pathway", "b"], "left_semi"))
        taken = linked.groupBy("pathway", "a").agg(F.count(F.lit(1)).alias("k"))
        left = head.join(taken, ["pathway", "a"], "left").withColumn("open", F.col("n") - F.col("r") - F.coalesce("k", F.lit(0)))
        if left.groupBy("pathway", "n").agg(F.sum("open").alias("open")).filter((F.col("open") < first) & (F.col("n") > among)).isEmpty():
            break
        among *= 4
    before = F.sum("open").over(Window.partitionBy("pathway").orderBy("a")) - F.col("open")
    need = left.withColumn("before", before).filter((F.col("open") > 0) & (F.col("before") < first)).select("pathway", "a")
    pairs = m.select("pathway", F.col("member").alias("b")).join(need, "pathway").filter("a < b")
    open_ = pairs.join(linked, ["pathway", "a", "b"], "left_anti")
    return open_.withColumn("r", F.row_number().over(Window.partitionBy("pathway").orderBy("a", "b"))).filter(F.col("r") <= first).select("pathway", "a", "b")


def sections(docs: DataFrame, headers: tuple[str, ...]) -> DataFrame:
    """(doc_id, pos, line, section): lines under the last line that began with a header, as written; null before the first."""
    names = "|".join(sorted(headers, key=len, reverse=True))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = F.lower(F.regexp_extract("line", f"^\\s*({names})", 1))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(found != "", found), ignorenulls=True).over(w))


def _window(w, k: int):
    """The hash of k words of the array ``w`` from a place on."""
    return lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def _windows(text, k: int):
    """Hashes of all windows of k words; an array of one binds the split text, so that it isn't split again for each."""
    words = F.array(F.struct(F.split(text, "\\s+").alias("w")))
    each = lambda z: F.when(F.size(z["w"]) >= k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(z["w"]) - k), _window(z["w"], k))))
    return F.transform(words, each)[0]


def containing(docs: DataFrame, needles: DataFrame, words: int = 3) -> DataFrame:
    """(query_id, doc_id) of documents (doc_id, text) that hold a needle (query_id, needle) as it is.

    The first ``words`` whole words inside a needle meet, by hash, the windows of so many words of
    every text; the texts are then compared. A needle of fewer words meets shorter windows, and one
    without a whole word inside has no hash and raises.
    """
    split = lambda c: F.split(F.col(c), "\\s+")
    keyed = needles.select("query_id", "needle", split("needle").alias("w")).withColumn("k", F.least(F.lit(words), F.size("w") - 2))
    sizes = [r[0] for r in keyed.filter("needle IS NOT NULL").select("k").distinct().collect()]
    if any(k < 1 for k in sizes):
        raise ValueError("a needle needs a whole word inside")
    out = None
    for k in sizes:
        heads = keyed.filter(F.col("k") == k).select("query_id", "needle", _window(F.col("w"), k)(F.lit(1)).alias("h"))
        each = docs.select("doc_id", F.explode(_windows(F.col("text"), k)).alias("h"))
        met = each.join(heads, "h").select("query_id", "needle", "doc_id").distinct()
        found = met.join(docs, "doc_id").filter(F.contains("text", F.col("needle"))).select("query_id", "doc_id")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "query_id long, doc_id long")
