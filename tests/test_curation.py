"""Curated sources, ontologies, interactions, resolution and files."""

import gzip

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import ingest, resolve
from weftgraph.sources import files, tables


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return row.select(expr.alias("x")).first()["x"]


def test_ids_prefer_numbers_and_fall_back_to_names(spark):
    gene = ingest.gene_id(F.col("e"), F.col("s"))
    assert [one(spark, gene, e=e, s="braf ") for e in ("673.0", "nan", "", "0", None)] == ["GENE:673", "GENE:BRAF", "GENE:BRAF", "GENE:BRAF", "GENE:BRAF"]
    assert one(spark, ingest.named_id("DISEASE", F.col("n"), F.col("d")), n="Melanoma", d="8923.0") == "DISEASE:8923"


def test_values_are_split_and_blanks_dropped(spark):
    assert one(spark, ingest.values(F.col("c")), c=" A, nan,, B ") == ["A", "B"]
    assert one(spark, ingest.values(F.col("c")), c=None) == []


@pytest.mark.parametrize(("citation", "year"), [("Levine et al., 2005", 2005), ("Study 2 of 1000 patients, 2015", 2015), (None, None), ("no year here", None), ("1975 reissued 2003", 2003)])
def test_publication_year_is_the_last_one(spark, citation, year):
    assert one(spark, T.publication_year(F.col("c")), c=citation) == year


def test_profiles_resolve_whole_then_parts(spark):
    v = spark.createDataFrame([("V1", "BRAF V600E"), ("V2", "EGFR T790M"), ("V0", "braf v600e")], "variant_id string, name string")
    e = spark.createDataFrame([("1", "BRAF V600E"), ("2", "BRAF V600E AND EGFR T790M"), ("3", "KRAS G12D")], "evidence_id string, profile string")
    assert sorted(map(tuple, ingest.resolve_profiles(e, v).collect())) == [("1", "V0"), ("2", "V0"), ("2", "V2")]


def test_fan_out_by_kind(spark):
    e = spark.createDataFrame(
        [("1", "V", "therapy", "RESISTANT_TO", "D", ["T1", "T2"], [], "Supports"), ("2", "V", "disease", "POOR_PROGNOSIS", "D", [], ["P"], "Does Not Support")],
        "evidence_id string, subject string, kind string, predicate string, disease string, therapies array<string>, phenotypes array<string>, direction string",
    )
    got = sorted((r["subject"], r["predicate"], r["object"], r["negated"]) for r in ingest.fan_out(e).collect())
    assert got == [("T1", "TREATS", "D", False), ("T2", "TREATS", "D", False), ("V", "ASSOCIATED_WITH", "D", False), ("V", "POOR_PROGNOSIS", "D", True), ("V", "PRESENTS_WITH", "P", True), ("V", "RESISTANT_TO", "T1", False), ("V", "RESISTANT_TO", "T2", False)]


def test_enrichment_is_one_when_counts_follow_length(spark):
    m = spark.createDataFrame([("A", "p", 10), ("B", "p", 30), ("X", "p", 99), ("A", "q", 5)], "symbol string, project string, occurrences long")
    g = spark.createDataFrame([("A", 100), ("B", 300), ("X", None)], "symbol string, length long")
    c = spark.createDataFrame([("p", 50), ("q", 0)], "project string, cases long")
    assert sorted((r["symbol"], r["enrichment"]) for r in ingest.enrichment(m, g, c).collect()) == [("A", 1.0), ("B", 1.0)]


def test_interactions_refuse_literature_and_unknown_channels(spark):
    links = spark.createDataFrame([("A", "B", 800, 900), ("B", "A", 500, 100), ("A", "A", 999, 999), ("A", "C", 300, 900)], "a string, b string, experimental int, textmining int")
    known = ("experimental", "textmining")
    assert [tuple(r) for r in ingest.interactions(links, ("experimental",), known).collect()] == [("A", "B", 800, "experimental")]
    with pytest.raises(ValueError, match="allow_literature"):
        ingest.interactions(links, known, known)
    with pytest.raises(ValueError, match="unknown"):
        ingest.interactions(links, ("nope",), known)
    assert ingest.interactions(links, known, known, allow_literature=True).count() == 2


def test_resolution_is_transitive_and_keeps_types_apart(spark):
    rows = [("1", "GENE", "BRAF", ["B-raf 1"], None), ("2", "GENE", "b-raf-1", ["RAFB"], None), ("3", "GENE", "rafb", [], None), ("4", "DRUG", "BRAF", [], None), ("5", "DRUG", "other", [], "X9"), ("6", "DRUG", "unlike", [], "X9"), ("7", "DRUG", "", [], None), ("8", "DRUG", "", [], None)]
    e = spark.createDataFrame(rows, "id string, type string, name string, synonyms array<string>, xref string")
    clusters = resolve.resolve(e)
    got = {r["id"]: r["cluster"] for r in clusters.collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "5", "6": "5", "7": "7", "8": "8"}
    top = {r["cluster"]: r for r in resolve.collapse(e, clusters).collect()}
    assert top["1"]["id"] == "1" and top["1"]["members"] == 3 and top["5"]["xref"] == "X9"
    rel = spark.createDataFrame([("1", "R", "4"), ("2", "R", "4"), ("2", "R", "3")], "subject string, predicate string, object string")
    assert [tuple(r) for r in resolve.repoint(rel, clusters).collect()] == [("1", "R", "4")]


def test_mentions_choose_the_most_frequent_surface(spark):
    m = spark.createDataFrame([(1, "TP53", "gene", 0.9), (2, "Tp53", "GENE", 0.7), (2, "TP53", "Gene", 0.8), (3, "TP53", "DRUG", 0.5)], "doc_id long, text string, label string, confidence double")
    got = {r["label"]: r for r in resolve.resolve_mentions(m).collect()}
    assert (got["GENE"]["canonical"], got["GENE"]["mentions"], got["GENE"]["documents"], got["GENE"]["n_surfaces"]) == ("TP53", 3, 2, 2)
    assert got["DRUG"]["node_id"] != got["GENE"]["node_id"]


def test_obo_stanzas(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1.2\n\n[Term]\nid: D:1\nname: disease\n\n[Term]\nid: D:2\nname: cancer\nsynonym: "malignant tumor" EXACT []\nis_a: D:1 ! disease\n\n[Typedef]\nid: part_of\nname: part of\n')
    t = files.ontology_terms(spark, str(tmp_path / "x.obo"))
    assert sorted(r["id"] for r in t.collect()) == ["D:1", "D:2"]
    assert [tuple(r) for r in files.is_a(t).collect()] == [("D:2", "D:1")]
    assert {r["surface"]: r["id"] for r in files.surface_index(t).collect()}["malignant tumor"] == "D:2"


def test_tables_need_their_columns_and_null_out_nan(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("name\tentrez_id\tfeature_type\nBRAF\t673.0\tGene\nX::Y\tnan\tFusion\nnan\t1\tGene\nQ\t\tOdd\n")
    got = sorted((r["id"], r["type"]) for r in files.features(files.read_tsv(spark, str(tmp_path / "f.tsv"), "features")).collect())
    assert got == [("GENE:673", "GENE"), ("GENE:Q", "GENE"), ("GENE:X::Y", "FUSION")]
    with pytest.raises(ValueError, match="variant_id"):
        files.read_tsv(spark, str(tmp_path / "f.tsv"), "variants")
    with pytest.raises(ValueError, match="missing"):
        tables.require_columns(spark.range(1), "id", "other")


def test_link_files(spark, tmp_path):
    with gzip.open(tmp_path / "info.gz", "wt") as f:
        f.write("#string_protein_id\tpreferred_name\np1\tA\np2\tB\np3\tC\n")
    with gzip.open(tmp_path / "links.gz", "wt") as f:
        f.write("protein1 protein2 experimental textmining\np1 p2 800 0\np2 p1 700 0\np1 p3 100 900\np1 p1 999 0\n")
    s = files.protein_symbols(spark, str(tmp_path / "info.gz"))
    assert [tuple(r) for r in files.protein_links(spark, str(tmp_path / "links.gz"), s, ("experimental",)).collect()] == [("A", "B", 800, "experimental")]


def test_json_graphs_documents_and_facets(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}, {"name": "b"}, {}], "links": [{"src": "a", "to": "b", "type": "R"}, {"src": "a"}]}')
    nodes, edges = files.graph_json(spark, str(tmp_path / "g.json"))
    assert sorted(r["id"] for r in nodes.collect()) == ["a", "b", "node"] and [tuple(r) for r in edges.collect()] == [("a", "b", "R")]
    (tmp_path / "d.json").write_text('{"results": [{"pmid": "1", "title": "T"}, {"pmid": "2", "title": " "}]}')
    good, bad = files.valid_documents(files.documents_json(spark, str(tmp_path / "d.json")))
    assert [r["pmid"] for r in good.collect()] == ["1"] and [r["pmid"] for r in bad.collect()] == ["2"]
    (tmp_path / "m.json").write_text('{"A": {"p": 3, "_missing": 9}}')
    assert [tuple(r) for r in files.facet_counts(spark, str(tmp_path / "m.json")).collect()] == [("A", "p", 3)]
    with pytest.raises(Exception, match="truncated"):
        files.facet_counts(spark, str(tmp_path / "m.json"), limit=2).collect()


def test_graph_round_trip_and_caches(spark, tmp_path):
    e, r = spark.createDataFrame([("a", "x")], "id string, name string"), spark.createDataFrame([("a", "R", "b")], "subject string, predicate string, object string")
    assert files.write_graph(e, r, str(tmp_path / "g")) == {"entities": 1, "relations": {"R": 1}}
    e2, r2 = files.read_graph(spark, str(tmp_path / "g"))
    assert e2.collect() == e.collect() and r2.collect() == r.collect()
    files.write_cache(e, str(tmp_path / "c"), "46.0", "P")
    assert files.read_cache(spark, str(tmp_path / "c"), "46.0", "P").count() == 1 and files.read_cache(spark, str(tmp_path / "c"), "45.0", "P").count() == 0
    assert "id  name" in files.format_report(e)
