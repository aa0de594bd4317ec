"""Personal data: base patterns, and terms that reveal a protected entity.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each distinct value
is a protected entity. The words of the documents that hold it, outside any span, are its
terms; over the whole corpus, texts that hold the term, the entity, or both are counted.
With p the shares of texts, a term's disclosure of an entity is
PMI(term, entity) / IC(entity) = log(p(t, e) / (p(t) p(e))) / -log p(e): the part of the
information of the entity that the term gives away. Equal texts count once, and a term
must be in several different texts, so that copies of a text don't count as evidence.
A pair that meets in one text only must reach ``remove``.
Terms from ``remove`` on are removed, those from ``generalise`` on generalised.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, stored

#: The kinds of base spans in their order, then that of added spans.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where its digits begin and takes all of them, so nothing is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[@0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]{3,}")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base spans, by start and kind."""
    if not _HINT.search(text):
        return []
    out = []
    at = floor = 0
    while (at := text.find("@", at)) >= 0:  # the local part reaches back from each @ to the last match at most
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > floor and text[start - 1] in _LOCAL_CHARS:
                start -= 1
        if m and start < at:
            out.append((start, 0, m.end(), text[start : m.end()].lower()))
            at = floor = m.end()
        else:
            at += 1
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    for m in _PHONE.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 10 <= len(digits) <= 15:
            out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def _terms(text: str, spans: list[tuple[int, int, int, str]], keys: dict[str, int]) -> list[tuple[int, int, int]]:
    """(term, start, end) of every word of a text that has spans; words that touch any span don't count."""
    out, at, reach = [], 0, 0
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if m.start() >= reach:
            word = m[0].lower()
            if (key := keys.get(word)) is None:
                if len(keys) > 1 << 18:
                    keys.clear()
                key = keys[word] = _key(word)
            out.append((key, m.start(), m.end()))
    return out


def _key(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans, entities and terms of every row: (doc_id, dh, th, n_email .. n_phone, base, base_sha256, entities, terms, held).

    Terms, and the text itself as ``held``, are those of texts with spans only.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text_ = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dh"), F.xxhash64(text_).alias("th"), text_.alias("text"))
    base_type = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, base, sha, entities, terms, held = [], [], [], [], [], []
                for value in part.column(3):
                    text = value.as_py() or ""
                    spans = base_spans(text)
                    n = [0, 0, 0, 0]
                    for x in spans:
                        n[x[1]] += 1
                    counts.append(n)
                    base.append([{"s": s, "k": k, "e": e} for s, k, e, _ in spans])
                    sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans).encode()).hexdigest())
                    entities.append(sorted({_key(f"{k}:{v}") for _, k, _, v in spans}))
                    terms.append(sorted({t for t, _, _ in _terms(text, spans, keys)}) if spans else [])
                    held.append(text if spans else None)
                n = np.array(counts, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), *[pa.array(n[:, i]) for i in range(4)], pa.array(base, base_type), pa.array(sha), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64())), pa.array(held, pa.string())],
                    ["doc_id", "dh", "th", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "entities", "terms", "held"],
                )

    spans = "base array<struct<s:int,k:int,e:int>>, base_sha256 string, entities array<bigint>, terms array<bigint>, held string"
    return rows.mapInArrow(run, f"doc_id {kind}, dh long, th long, n_email long, n_ip long, n_card long, n_phone long, {spans}")


def _term_texts(docs: DataFrame, copies: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """(term, n_t): different texts that hold each of ``terms``, counted over every whole text.

    ``copies`` has (th, m), the texts that m > 1 rows share; each of them counts 1 / m. Up to
    ``limit`` terms and copies are broadcast as hashes; with more they are joined.
    """
    n = terms.count()
    wanted = terms.toArrow()["term"].to_numpy() if n <= limit else None
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("th")).filter("text IS NOT NULL")
    if copies.count() <= limit:
        x = copies.toArrow()
        times = dict(zip(x["th"].to_pylist(), x["m"].to_pylist(), strict=True))
        rows = rows.withColumn("m", F.lit(None).cast("long"))
    else:
        times = {}
        rows = rows.join(copies, "th", "left").select("text", "th", "m")
    shared = docs.sparkSession.sparkContext.broadcast((wanted, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, m = shared.value
        only = None if only is None else set(only.tolist())
        known: dict[str, int] = {}
        counts: dict[int, float] = {}

        def rows_() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.float64())], ["term", "n"])

        for batch in batches:
            for value, th, joined in zip(batch.column("text"), batch.column("th").to_pylist(), batch.column("m").to_pylist(), strict=True):
                share = 1.0 / (joined or m.get(th, 1))
                for word in {w.lower() for w in _WORD.findall(value.as_py())}:
                    if (key := known.get(word)) is None:
                        if len(known) > 1 << 20:
                            known.clear()
                        key = known[word] = _key(word)
                    if only is None or key in only:
                        counts[key] = counts.get(key, 0.0) + share
            if len(counts) > 1 << 18:
                yield rows_()
                counts.clear()
        yield rows_()

    counted = rows.mapInArrow(run, "term long, n double").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n_t"))
    return counted if wanted is not None else counted.join(terms, "term")


def disclosing_terms(scan: DataFrame, docs: DataFrame, generalise: float, remove: float, texts: int, limit: int = 1 << 20) -> DataFrame | None:
    """(th, term, action): terms above the threshold for an entity of that text; None without entities."""
    m = checkpointed(scan.groupBy("th").agg(F.count(F.lit(1)).alias("m")))
    total = m.count()
    copies = checkpointed(m.filter("m > 1"))
    held = scan.filter(F.size("entities") > 0).join(copies, "th", "left").withColumn("share", 1 / F.coalesce("m", F.lit(1)))
    n_e = checkpointed(held.select(F.explode("entities").alias("entity"), "share").groupBy("entity").agg(F.round(F.sum("share")).cast("long").alias("n_e")))
    most = n_e.agg(F.max("n_e")).first()[0]
    if most is None:
        return None
    terms = checkpointed(scan.filter(F.size("entities") > 0).select(F.explode("terms").alias("term")).distinct())
    n_t = _term_texts(docs, copies, terms, limit)
    # no more than n_e texts hold both, so a term in more texts than this can't reach the threshold of any entity
    reach = lambda n, level: F.pow(n, F.lit(level)) * total ** (1 - level) * (1 + 1e-9)
    n_t = checkpointed(n_t.filter((F.col("n_t") >= texts) & (F.col("n_t") <= reach(F.lit(float(most)), generalise))))
    some = F.broadcast(n_t) if n_t.count() <= limit else n_t
    entities = F.broadcast(n_e) if n_e.count() <= limit else n_e
    rare = held.select("th", "share", "entities", F.explode("terms").alias("term")).join(some, "term")
    pairs = rare.select("th", "share", "term", "n_t", F.explode("entities").alias("entity")).join(entities, "entity")
    pairs = pairs.filter(F.col("n_t") <= F.when(F.col("n_e") > 1, reach(F.col("n_e").cast("double"), generalise)).otherwise(reach(F.col("n_e").cast("double"), remove)))
    found = pairs.groupBy("entity", "term").agg(F.round(F.sum("share")).cast("long").alias("n_et"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    found = found.withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(0.0))
    # a meeting in one text may be chance: it counts if the term gives away nearly all
    found = found.filter((F.col("disclosure") >= generalise) & ((F.col("n_et") > 1) | (F.col("disclosure") >= remove)))
    found = checkpointed(found.select("entity", "term", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action")))
    return checkpointed(pairs.select("th", "entity", "term").join(found, ["entity", "term"]).groupBy("th", "term").agg(F.max("action").alias("action")))


def _occurrences(rows: DataFrame) -> DataFrame:
    """(dh, added): where the terms of (dh, held, found) occur; a text's spans are found again, so that words in them don't count."""
    added = "array<struct<s:int,k:int,e:int,kind:string,action:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    action = {x["term"]: x["action"] for x in found}
                    out.append([{"s": s, "k": len(KINDS), "e": e, "kind": TERM, "action": action[t]} for t, s, e in _terms(text, base_spans(text), keys) if t in action])
                kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("action", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["dh", "added"])

    return rows.select("dh", "held", "found").mapInArrow(run, f"dh long, added {added}")


def find_pii(docs: DataFrame, generalise: float = 0.5, remove: float = 0.8, texts: int = 2) -> DataFrame:
    """Base spans and spans of disclosing terms of every document.

    Returns doc_id, n_email, n_ip, n_card, n_phone (long), base_sha256, spans (string),
    n_terms (long) and cuts (array of (s, e, kind, action)), one row per input row. Offsets
    are in code points, ends exclusive. A null text is empty and has no spans; null ids stay
    null; rows alike in text count as one text in the statistics and all get the same
    spans. Other columns are ignored. A term must be in ``texts`` different texts; its spans
    are all its occurrences in the documents that hold the entity.
    """
    scan = stored(_scan(docs))
    found = disclosing_terms(scan, docs, generalise, remove, texts)
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1).alias("kind"), F.lit("remove").alias("action")))
    empty = F.expr("CAST(array() AS array<struct<s:int,k:int,e:int,kind:string,action:string>>)")
    rows = scan.drop("terms", "held")
    if found is None:
        rows = rows.withColumn("added", empty)
    else:
        by_text = found.groupBy("th").agg(F.collect_list(F.struct("term", "action")).alias("found"))
        hits = stored(_occurrences(scan.filter(F.size("entities") > 0).select("dh", "th", "held").dropDuplicates(["dh"]).join(by_text, "th")))
        holds = F.size("entities") > 0
        some = rows.filter(holds).join(hits, "dh", "left").withColumn("added", F.coalesce("added", empty))
        rows = some.unionByName(rows.filter(~holds).withColumn("added", empty))
    rows = rows.withColumn("cuts", F.sort_array(F.concat(base, "added")))
    text = F.array_join(F.transform("cuts", lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    cuts = F.transform("cuts", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["action"].alias("action")))
    return rows.select("doc_id", "dh", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size("added").cast("long").alias("n_terms"), cuts.alias("cuts"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each base span replaced by its kind in brackets, removed terms cut, generalised ones replaced by [term].

    All columns stay; a null text stays null. Of overlapping spans the earlier, then the longer, is replaced.
    """
    cuts = find_pii(docs, **options).filter(F.size("cuts") > 0).select(F.col("doc_id").alias("__weft_id"), F.col("dh").alias("__weft_dh"), "cuts").dropDuplicates(["__weft_id", "__weft_dh"])
    key = F.xxhash64("doc_id", "text")
    joined = docs.withColumn("__weft_key", key).join(cuts, F.col("doc_id").eqNullSafe(F.col("__weft_id")) & (F.col("__weft_key") == F.col("__weft_dh")), "left")
    order = F.sort_array(F.transform("cuts", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"), x["action"].alias("action"))))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    label = lambda x: F.when((x["kind"] == TERM) & (x["action"] == "remove"), F.lit("")).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))
    step = lambda a, x: F.when(x["s"] < a["at"], a).otherwise(F.struct(F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), label(x)).alias("done"), (-x["e"]).alias("at")))
    clean = F.aggregate(order, begin, step, lambda a: F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("cuts").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)
