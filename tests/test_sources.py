import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from papyra.functions import text
from papyra.sources import biology, papers

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# preprint snapshot

SNAPSHOT = [
    {"id": "0704.0001", "title": "A title\n  folded", "abstract": " An abstract\nof lines ", "categories": "cs.CL q-bio.MN", "authors_parsed": [["Holm", "Rosa", ""], ["Solo", "", ""], ["", "", ""]], "versions": [{"created": "Mon, 2 Apr 2007 19:18:42 GMT"}, {"created": "Tue, 3 Apr 2008 19:18:42 GMT"}], "update_date": "2008-11-26", "doi": "", "journal-ref": "J. 1", "comments": None},
    {"id": "0704.0002", "title": "T2", "abstract": "x", "categories": "csx.AI", "authors_parsed": [], "versions": [], "update_date": "bad"},
    {"id": "0704.0003", "title": "T3", "abstract": "x", "categories": "cs", "authors_parsed": None, "versions": [{"created": "Wed, 1 Jan 2020 00:00:00 GMT"}]},
]


@pytest.fixture()
def snapshot(tmp_path):
    path = tmp_path / "snapshot.json.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n\n".join(json.dumps(x) for x in SNAPSHOT) + "\n")
    return str(path)


def test_snapshot_record(spark, snapshot):
    r = {x.arxiv_id: x for x in papers.snapshot_papers(spark, snapshot).collect()}
    a = r["0704.0001"]
    assert (a.title, a.abstract, a.authors, a.categories, a.primary_category) == ("A title   folded", "An abstract of lines", ["Rosa Holm", "Solo"], ["arxiv:cs.CL", "arxiv:q-bio.MN"], "arxiv:cs.CL")
    assert (a.published_date, a.updated_date, a.doi, a.journal_ref, a.source) == (D(2007, 4, 2), D(2008, 11, 26), None, "J. 1", "kaggle")
    assert r["0704.0002"].published_date is None and r["0704.0002"].updated_date is None and len(r) == 3


def test_snapshot_filters(spark, snapshot):
    ids = lambda **kw: {x.arxiv_id for x in papers.snapshot_papers(spark, snapshot, **kw).collect()}
    assert ids(categories=["cs"]) == {"0704.0001", "0704.0003"}  # not csx
    assert ids(start=D(2000, 1, 1)) == {"0704.0001", "0704.0003"}  # a missing date fails any bound
    assert ids(start=D(2007, 4, 2), end=D(2007, 4, 2)) == {"0704.0001"}
    assert len(ids(categories=["cs"], limit=1)) == 1


# article XML

XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><DateRevised><Year>2021</Year><Month>3</Month><Day>09</Day></DateRevised>
<Article><Journal><Title>Long Name</Title><ISOAbbreviation>J Abbr</ISOAbbreviation><JournalIssue><Volume>12</Volume><Issue>3</Issue><PubDate><Year>2020</Year><Month>Feb</Month><Day>30</Day></PubDate></JournalIssue></Journal>
<ArticleTitle>On <i>Oryza</i> &amp; H<sub>2</sub>O</ArticleTitle><Pagination><MedlinePgn>7-9</MedlinePgn></Pagination><ELocationID EIdType="pii">x</ELocationID><ELocationID EIdType="doi">10.1/e</ELocationID>
<Abstract><AbstractText Label="A">Part <b>one</b>.</AbstractText><AbstractText>Part two.</AbstractText></Abstract>
<AuthorList><Author><LastName>Holm</LastName><ForeName>Rosa</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="N">Minor</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D2" MajorTopicYN="Y">Major Thing</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="" MajorTopicYN="Y">No id</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><Title>Only Title</Title><JournalIssue><PubDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>Second</ArticleTitle></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="N">Minor</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D3" MajorTopicYN="N">Other</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">12</ArticleId><ArticleId IdType="doi">10.2/f</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID></PMID><Article><ArticleTitle>No id</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


@pytest.fixture()
def articles(tmp_path):
    with gzip.open(tmp_path / "pubmed1.xml.gz", "wt") as f:
        f.write(XML)
    return str(tmp_path)


def test_article_record(spark, articles):
    r = {x.pmid: x for x in papers.article_papers(spark, articles).collect()}
    assert set(r) == {"11", "12"}
    a, b = r["11"], r["12"]
    assert (a.title, a.abstract, a.authors) == ("On Oryza & H2O", "Part one. Part two.", ["Rosa Holm", "The Group"])
    assert (a.categories, a.primary_category, b.categories) == (["mesh:D2"], "mesh:D2", ["mesh:D1", "mesh:D3"])
    assert (a.published_date, b.published_date, a.updated_date) == (D(2020, 1, 1), D(1998, 1, 1), D(2021, 3, 9))
    assert (a.doi, b.doi, a.journal_ref, b.journal_ref) == ("10.1/e", "10.2/f", "J Abbr. 2020;12(3):7-9", "Only Title")


def test_article_filters(spark, articles):
    ids = lambda **kw: {x.pmid for x in papers.article_papers(spark, articles, **kw).collect()}
    assert ids(mesh_terms=["major thing"]) == {"11"} and ids(mesh_terms=["minor"]) == {"12"}  # selected headings only
    assert ids(start=D(2000, 1, 1)) == {"11"} and len(ids(limit=1)) == 1


# API replies


def test_new_preprints(spark):
    rows = spark.createDataFrame([("2101.1v2", dt.datetime(2021, 1, 3)), ("2101.2", dt.datetime(2021, 1, 1)), ("2101.3v1", dt.datetime(2021, 1, 2))], "id string, published timestamp")
    assert [r.arxiv_id for r in papers.new_preprints(rows, "2021-01-01").collect()] == ["2101.1", "2101.3"]


def test_replies_are_matched_by_identifier(spark):
    asked = spark.createDataFrame([("arxiv:1", "1"), ("arxiv:2", "2"), ("arxiv:3", "3")], "id string, identifier string")
    replies = spark.createDataFrame([("S2", {"ArXiv": "2"}, 5, 6), (None, None, None, None), ("S9", {"DOI": "x"}, 1, 1)], "paperId string, externalIds map<string,string>, citationCount int, referenceCount int")
    assert {r.id: (r.s2_paper_id, r.citation_count, r.found) for r in papers.match_citation_results(asked, replies, "ArXiv").collect()} == {"arxiv:1": (None, None, False), "arxiv:2": ("S2", 5, True), "arxiv:3": (None, None, False)}


def test_stubs_without_identity_are_dropped(spark):
    schema = "refs array<struct<paperId:string,title:string,externalIds:map<string,string>>>"
    df = spark.createDataFrame([([("S", "a", None), (None, "b", {"DOI": "x"}), (None, "c", {"PubMed": "5"})],)], schema)
    assert [s.title for s in df.select(papers.usable_stubs(F.col("refs")).alias("s")).first().s] == ["a", "c"]


# ontologies

GO = """format-version: 1.2
data-version: releases/2024-01-17

[Term]
id: GO:1
name: old name
name: process one
namespace: biological_process

[Term]
id: GO:2
name: gone
namespace: biological_process
is_obsolete: true

[Term]
id: GO:3
name: part
namespace: cellular_component

[Typedef]
id: part_of
name: part of
"""
DO = """[Term]
id: DOID:2
name: two
xref: MESH:D1
xref: ICD:9
is_a: DOID:9 ! unmapped

[Term]
id: DOID:10
name: ten
xref: MESH:D1

[Term]
id: DOID:9
name: nine
is_a: DOID:4 {x="y"} ! top

[Term]
id: DOID:4
name: four
xref: MESH:D4

[Term]
id: DOID:1
name: dead
is_obsolete: true
xref: MESH:D1
"""


def put(tmp_path, name, body):
    path = tmp_path / name
    if name.endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(body)
    else:
        path.write_text(body)
    return str(path)


def test_process_ontology(spark, tmp_path):
    path = put(tmp_path, "go.obo", GO)
    assert [tuple(r) for r in biology.process_pathways(biology.ontology_terms(spark, path)).collect()] == [("GO:1", "process one", "GO")]
    assert biology.ontology_version(spark, path) == "releases/2024-01-17"


def test_disease_ontology(spark, tmp_path):
    terms = biology.ontology_terms(spark, put(tmp_path, "do.obo", DO.replace(' {x="y"}', "")))
    by = {r.id: r for r in terms.collect()}
    assert by["DOID:2"].xrefs == ["MESH:D1", "ICD:9"] and by["DOID:2"].parents == ["DOID:9"] and by["DOID:1"].is_obsolete
    from papyra.operators.crosswalk import disease_xrefs

    assert {tuple(r) for r in disease_xrefs(terms).collect()} == {("mesh:D1", "DOID:10", "ten"), ("mesh:D4", "DOID:4", "four")}  # the smallest as text, the dead one left out


# tables


def test_pathway_tables(spark, tmp_path):
    listed = put(tmp_path, "p.txt", "R-1\tone\tHomo sapiens\nR-2\ttwo\tMus musculus\nbad row\n")
    assert [tuple(r) for r in biology.listed_pathways(spark, listed).collect()] == [("R-1", "one", "Reactome")]
    row = lambda g, p, e, s="Homo sapiens": "\t".join([g, p, "u", "n", e, s])
    rows = put(tmp_path, "g.txt", "\n".join([row("1", "R-1", "IEA"), row("1", "R-1", "TAS"), row("1", "R-1", "XXX"), row("2", "R-1", "A"), row("2", "R-1", "B"), row("3", "R-1", "TAS", "Mus musculus"), "1\tR-1\tshort"]))
    got, facts = biology.gene_memberships(spark, rows)
    assert {tuple(r) for r in got.collect()} == {("ncbigene:1", "R-1", "TAS"), ("ncbigene:2", "R-1", "A")}
    assert facts.first().asDict() == {"rows_considered": 5, "dropped_unresolved": 0, "dropped_duplicate": 3}
    walk = spark.createDataFrame([("CHEBI:1", "mesh:D1")], "accession string, mesh string")
    made, facts = biology.produced_compounds(spark, rows, walk)
    assert {tuple(r) for r in made.collect()} == {("R-1", "mesh:D1", "TAS")} and facts.first().asDict() == {"rows_considered": 5, "dropped_unresolved": 2, "dropped_duplicate": 2}
    maps = put(tmp_path, "m.txt", "Identifier\tName\tGO_Term\nR-1\ta\tGO:1\nR-2\tb\tGO:1\n")
    assert {tuple(r) for r in biology.pathway_mappings(spark, maps).collect()} == {("R-1", "GO:1"), ("R-2", "GO:1")}


def test_gene_table(spark, tmp_path):
    body = "#tax_id\tGeneID\tLocusTag\n9\t5\tT1\n9\t6\t-\n9\t7\tT1\n9\t8\n"
    for name in ("g.tsv", "g2.tsv.gz"):
        assert [tuple(r) for r in biology.gene_tags(spark, put(tmp_path, name, body)).collect()] == [("T1", "ncbigene:7")]


def test_compound_crosswalk_files(spark, tmp_path):
    compounds = put(tmp_path, "c.tsv.gz", "id\tstatus\tchebi_accession\n1\tC\tCHEBI:1\n2\tC\tCHEBI:2\n3\tC\tCHEBI:3\n")
    numbers = put(tmp_path, "a.tsv.gz", "id\tcompound_id\taccession_number\ttype\n1\t1\t50-00-0\tCAS\n2\t2\tC01\tKEGG\n3\t3\t64-17-5\tCAS\n")
    heads = put(tmp_path, "d.bin", "*NEWRECORD\nRECTYPE = D\nRR = 50-00-0 (note)\nRR = EC 1.1\nUI = D1\nRR = 64-17-5\n\n*NEWRECORD\nRR = 64-17-5\nUI = D3\n")
    curated = put(tmp_path, "b.sssom.tsv", "# a: b\n#  c\nsubject_id\tsubject_label\tpredicate_id\tobject_id\nchebi:2\tx\teq\tmesh:D2\nmesh:C9\ty\teq\tchebi:3\n")
    got = biology.compound_crosswalk_from_files(spark, compounds, numbers, [heads], curated)
    assert {tuple(r) for r in got.collect()} == {("CHEBI:1", "mesh:D1"), ("CHEBI:2", "mesh:D2"), ("CHEBI:3", "mesh:C9")}


def note(kind, ident=None, norm=None, base=None, valid=True, name=None, words="w"):
    return {"infons": {"type": kind, "identifier": ident, "normalized_id": norm, "database": base, "valid": valid, "name": name}, "text": words}


def test_annotations(spark, tmp_path):
    notes = [note("Gene", "5", None, "ncbi_gene", name="G"), note("Gene", "5", None, "ncbi_gene", name="again"), note("Gene", "9", "0", "ncbi_gene", name="zero"), note("Chemical", "D1", None, "ncbi_mesh"), note("Species", "4530", None, "ncbi_taxonomy", name="Oryza", words="rice"), note("Disease", "D2", None, "other", name="d"), note("Gene", "6", None, "ncbi_gene", valid=False), note("Strain", "7"), note("Gene", None, None, "ncbi_gene")]
    path = put(tmp_path, "a.json", json.dumps({"documents": [{"pmid": "1", "passages": [{"annotations": notes[:4]}, {"annotations": notes[4:]}, {"annotations": None}]}, {"pmid": "2", "passages": []}]}))
    got = {tuple(r) for r in biology.annotation_mentions(spark, path).collect()}
    assert got == {("1", "Gene", "ncbigene:5", "G"), ("1", "Gene", "ncbigene:0", "zero"), ("1", "Compound", "mesh:D1", "w"), ("1", "Organism", "4530", "rice"), ("1", "Disease", "other:D2", "d")}


# scalars


def test_identity(spark):
    c = lambda *v: one(spark, text.canonical_id(*[F.lit(x).cast("string") for x in v]))
    assert (c("1", "2", "3"), c(None, "2", "3"), c("", "", "3"), c(None, None, None)) == ("arxiv:1", "pmid:2", "s2:3", None)


def test_dates(spark):
    p = lambda *v: one(spark, text.published_date(*[F.lit(x).cast("string") for x in v]))
    assert p("2020", "Feb", "3", None) == D(2020, 2, 3) and p("2020", "02", None, None) == D(2020, 2, 1) and p("2020", "Feb", "31", None) == D(2020, 1, 1)
    assert p(None, None, None, "1999 Spring") == D(1999, 1, 1) and p(None, "Feb", "1", None) is None and p("2020", "Nope", "1", None) == D(2020, 1, 1)
    assert one(spark, text.rfc_date(F.lit("Mon, 2 Apr 2007 19:18:42 GMT"))) == D(2007, 4, 2) and one(spark, text.rfc_date(F.lit("soon"))) is None


def test_texts(spark):
    j = lambda *v: one(spark, text.journal_reference(*[F.lit(x).cast("string") for x in v]))
    assert j("J", "2020", "1", "2", "3-4") == "J. 2020;1(2):3-4" and j("J", None, None, None, None) == "J" and j(None, "2020", None, None, None) == "2020" and j(None, None, None, None, None) is None
    assert one(spark, text.snippet(F.lit("one two three"), 9)) == "one two…" and one(spark, text.snippet(F.lit("short"), 9)) == "short"
    assert one(spark, text.without_comment(F.lit("DOID:4 ! disease"))) == "DOID:4" and one(spark, text.without_version(F.lit("2101.00001v12"))) == "2101.00001"
    assert [one(spark, text.is_cas(F.lit(x))) for x in ("50-00-0", "1-00-0", "EC 1.1")] == [True, False, False]
    assert one(spark, text.week_start(F.lit("2026-11-26").cast("timestamp"))) == dt.datetime(2026, 11, 23)
    assert text.search_terms('+gene AND "Gene" (x:y)') == ["gene", "and", "x", "y"]
    assert one(spark, text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
