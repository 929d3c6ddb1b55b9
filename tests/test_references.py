import datetime as dt

from papyra.operators.references import literature_orphans, monthly_report, plain_identifier, plain_key
from pyspark.sql import functions as F

D = lambda m, d=1: dt.datetime(2026, m, d)


def orphans(spark, stubs=(), is_a=(), part=(), papers=(), diseases=(), pathways=(), removals=()):
    mk = spark.createDataFrame
    return literature_orphans(
        mk(list(stubs), "stub_id long, enriched_at timestamp, identifiers map<string,string>"), mk(list(is_a), "edge_id long, parent_id string, loaded_at timestamp"),
        mk(list(part), "row_id long, pathway_id string, loaded_at timestamp"), mk(list(papers), "id string, arxiv_id string, pmid string, s2_paper_id string, fetched_at timestamp"),
        mk(list(diseases), "disease_id string, fetched_at timestamp"), mk(list(pathways), "pathway_id string, loaded_at timestamp"), mk(list(removals), "record_id string, record_type string, removed_at timestamp"),
    )


def found(df):
    return {(r.source_table, r.row_id, r.reason) for r in df.collect()}


PAPER = ("arxiv:2101.00001", "2101.00001", "77", None, D(3))


def test_missing_late_deleted_and_present(spark):
    papers = [PAPER, ("arxiv:2101.00001", "2101.00001", "77", None, D(2))]  # the earliest delivery counts
    stubs = [(1, D(2), {"arxiv": "2101.00001"}), (2, D(1), {"pmid": "77"}), (3, D(5), {"pmid": "77"}), (4, D(4), {"pmid": "78"}), (5, D(4, 30), {"pmid": "77"})]
    got = found(orphans(spark, stubs, papers=papers, removals=[("arxiv:2101.00001", "Paper", D(5))]))
    assert got == {("citation_stubs", 2, "late"), ("citation_stubs", 3, "deleted"), ("citation_stubs", 4, "missing")}


def test_identifiers_are_compared_apart_from_their_spelling(spark):
    stubs = [(1, D(4), {"arxiv": " arXiv:2101.00001v3 "}), (2, D(4), {"pmid": "PMID: 77"}), (3, D(4), {"arxiv": "nope", "pmid": "77"})]
    assert found(orphans(spark, stubs, papers=[PAPER])) == set()


def test_empty_identifiers_and_other_namespaces_say_nothing(spark):
    stubs = [(1, D(4), {}), (2, D(4), None), (3, D(4), {"doi": "x"}), (4, D(4), {"arxiv": "", "pmid": None}), (5, None, {"pmid": "1"})]
    assert found(orphans(spark, stubs, papers=[PAPER])) == set()


def test_null_references_are_no_cases_and_ids_ignore_case(spark):
    got = found(orphans(spark, is_a=[(1, " MESH:d1 ", D(4)), (2, None, D(4)), (3, "mesh:D2", D(4)), (3, "mesh:D2", D(4))], part=[(7, "go:1", D(4)), (8, "GO:9", D(4))], diseases=[("mesh:D1", D(1))], pathways=[("GO:1", D(1))]))
    assert got == {("disease_is_a", 3, "missing"), ("participates_in", 8, "missing")}


def test_removal_of_another_type_does_not_count(spark):
    assert found(orphans(spark, is_a=[(1, "mesh:D1", D(4))], diseases=[("mesh:D1", D(1))], removals=[("mesh:D1", "Paper", D(2))])) == set()


def test_empty_tables(spark):
    assert found(orphans(spark)) == set()


def test_hot_target(spark):
    stubs = [(i, D(4), {"pmid": "77"}) for i in range(400)] + [(1000 + i, D(1), {"pmid": "77"}) for i in range(200)]
    assert len(found(orphans(spark, stubs, papers=[PAPER]))) == 200


def test_monthly_report(spark):
    rows = monthly_report(orphans(spark, is_a=[(1, "x", D(4)), (2, "x", D(4, 9)), (3, "x", D(5))])).collect()
    assert {(r.month, r.n_orphans) for r in rows} == {("2026-04", 2), ("2026-05", 1)}


def test_plain_forms(spark):
    row = spark.range(1).select(plain_key(F.lit(" Ab ")).alias("a"), plain_key(F.lit("  ")).alias("b"), plain_identifier(F.lit("arxiv"), F.lit("hep-th/9901001V2")).alias("c"), plain_identifier(F.lit("s2"), F.lit("S2: abv2")).alias("d")).first()
    assert tuple(row) == ("ab", None, "hep-th/9901001", "abv2")
