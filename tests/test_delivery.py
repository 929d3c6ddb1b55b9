"""Nothing delivered gets lost: text between signs, all properties, the last delivery, several files, crashes and concurrent writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from papyra import cli, console, jobs as whole, stats
from papyra.registry import DEFAULT
from papyra.sources import biology, papers
from papyra.store import StaleTable, Store
from papyra.streaming import jobs

D = dt.date
PAPER = "arxiv_id string, pmid string, s2_paper_id string, title string, abstract string, authors array<string>, categories array<string>, primary_category string, published_date date, updated_date date, doi string, journal_ref string, comments string, source string"


def paper(arxiv, title="t", authors=("Rosa Holm",), categories=("arxiv:cs.CL",), day=D(2026, 3, 4)):
    return (arxiv, None, None, title, "abstract", list(authors), list(categories), categories[0] if categories else None, day, D(2026, 5, 6), "10.1/x", "J. 1", "two pages", "kaggle")


def test_signs_in_titles_and_abstracts_are_no_tags(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article>
<ArticleTitle>Effect <i>in vivo</i> with p &lt; 0.05 and q &gt; 0.1 of x<sub>2</sub></ArticleTitle><Abstract><AbstractText Label="A">n&lt;5 &amp;amp; m&gt;3</AbstractText>
<AbstractText>one <mml:math xmlns:mml="u"><mml:mi>a</mml:mi></mml:math> &lt;two, three&gt;</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>""")
    r = papers.article_papers(spark, str(tmp_path / "a.xml")).first()
    assert r.title == "Effect in vivo with p < 0.05 and q > 0.1 of x2" and r.abstract == "n<5 &amp; m>3 one a <two, three>"


def test_every_file_loses_its_header_only_and_positions_follow_the_names(spark, tmp_path):
    for name, rows in (("b.tsv", "x\t2\ny\t3\n"), ("a.tsv", "x\t1\n")):
        (tmp_path / name).write_text("#id\tv\n" + rows)
    rows = biology.headed_tsv(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.id, r.v) for r in rows] == [("x", "1"), ("x", "2"), ("y", "3")]


def test_long_values_are_kept_whole(spark, tmp_path):
    long = "MESH:" + "D" * 1500
    (tmp_path / "d.obo").write_text(f"format-version: 1.2\n\n[Term]\nid: DOID:1\nname: n\nxref: {long}\n")
    from papyra.operators.crosswalk import disease_xrefs

    assert disease_xrefs(biology.ontology_terms(spark, str(tmp_path / "d.obo"))).first().mesh == "mesh:" + "D" * 1500


# the store


@pytest.mark.parametrize("step", ["data", "pointer", "rename", "forget"])
def test_a_crash_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    s = Store(spark, str(tmp_path))
    for i in range(3):
        s.write("t", spark.createDataFrame([(i,)], "a int"))

    def crash(*_):
        raise KeyboardInterrupt

    if step == "data":
        with pytest.raises(Exception):
            s.write("t", spark.range(3).select(F.raise_error(F.lit("x")).alias("a")))
    else:
        monkeypatch.setattr(Store, {"pointer": "_point", "rename": "_pointers", "forget": "_forget"}[step], crash)
        with pytest.raises(KeyboardInterrupt):
            s.write("t", spark.createDataFrame([(9,)], "a int"))
        monkeypatch.undo()
    want = 9 if step == "forget" else 2
    again = Store(spark, str(tmp_path))
    assert again.read("t").first().a == want
    again.write("t", spark.createDataFrame([(10,)], "a int"))
    assert again.read("t").first().a == 10 and s.read("t").first().a == 10


def test_of_two_writers_none_is_undone(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.write("t", spark.createDataFrame([(0,)], "a int"))
    mine, theirs = a.read("t"), b.read("t")
    a.write("t", mine.unionByName(spark.createDataFrame([(1,)], "a int")))
    with pytest.raises(StaleTable):
        b.write("t", theirs.unionByName(spark.createDataFrame([(2,)], "a int")))
    b.write("t", b.read("t").unionByName(spark.createDataFrame([(2,)], "a int")))
    assert sorted(r.a for r in a.read("t").collect()) == [0, 1, 2]


def test_a_first_write_that_crashed_is_no_table_but_a_lost_pointer_is_an_error(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with pytest.raises(Exception):
        s.write("t", spark.range(3).select(F.raise_error(F.lit("x")).alias("a")))
    assert s.read("t", "a int").count() == 0 and s.tables() == []
    s.write("t", spark.range(1))
    for f in (tmp_path / "t").glob("_current-*"):
        f.unlink()
    with pytest.raises(OSError):
        s.read("t", "a int")


# loads


def test_every_property_is_read_back_and_the_last_delivery_wins(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = [paper("1", "old"), paper("2"), paper("1", "new")]
    whole.load_papers(s, spark.createDataFrame(rows, PAPER).repartition(1), "j")
    got = {r.id: r for r in s.read("Paper").collect()}
    assert got["arxiv:1"].title == "new" and len(got) == 2
    assert (got["arxiv:1"].updated_date, got["arxiv:1"].doi, got["arxiv:1"].journal_ref, got["arxiv:1"].comments) == (D(2026, 5, 6), "10.1/x", "J. 1", "two pages") and got["arxiv:1"].fetched_at is not None
    assert {(r.code, r.vocabulary, r.name, r.paper_count) for r in s.read("Category").collect()} == {("arxiv:cs.CL", "arxiv", "cs.CL", 2)}
    assert set(s.tables()) == {"Paper", "Category", "IN_CATEGORY", "Author", "AUTHORED", "GraphStats"}


def test_counters_by_delta_equal_a_rebuild(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    first = [paper("1", categories=("arxiv:a", "arxiv:b")), paper("2", authors=("X", "Y", ""), categories=())]
    again = [paper("2", "changed", authors=("Y", "Z"), categories=("arxiv:b",), day=D(2020, 1, 1)), paper("3", categories=("arxiv:b", "arxiv:b"), day=D(2027, 1, 1))]
    for batch in (first, first, again):
        whole.load_papers(s, spark.createDataFrame(batch, PAPER), "j")
    reply = lambda i, refs: {"paperId": f"s{i}", "externalIds": {"ArXiv": str(i)}, "citationCount": 3, "referenceCount": len(refs), "references": [{"paperId": r, "externalIds": {"ArXiv": r} if r.isdigit() else {}, "title": r} for r in refs], "citations": []}
    (tmp_path / "replies.json").write_text("\n".join(json.dumps(reply(i, refs)) for i, refs in ((1, ["2", "zz", "7"]), (2, ["zz"]))))
    done = whole.enrich(s, cli.stored_replies(spark, str(tmp_path / "replies.json")), batch=2)
    assert done == {"papers": 3, "found": 2, "stubs": 2, "edges": 4}
    whole.load_papers(s, spark.createDataFrame([paper("7", "was a stub")], PAPER), "j")
    kept = stats.counters(s).select(*stats.SUMS, "earliest", "latest").first().asDict()
    assert kept == stats.measure(s).first().asDict() and kept["citation_edges"] == 4 and kept["stubs"] == 1 and kept["papers"] == 4
    counts = {r.code: r.paper_count for r in s.read("Category").collect()}
    stats.rebuild(s)
    assert counts == {r.code: r.paper_count for r in s.read("Category").collect()}
    assert {r.what: r.value for r in stats.overview(s, True).collect()}["enriched"] == "2 (50%)"


def test_daily_cursor_starts_with_the_week_and_future_days_do_not_move_it(spark, tmp_path):
    s, today = Store(spark, str(tmp_path)), D(2026, 3, 5)  # a Thursday
    rows = spark.createDataFrame([paper("1", day=D(2026, 3, 1)), paper("2", day=D(2026, 3, 2)), paper("3", day=D(2026, 9, 1))], PAPER)
    out = whole.fetch_daily(s, rows, "d", today, guarded=True)
    assert (out["since"], out["count"], out["created"]) == (D(2026, 3, 2), 2, 2) and jobs.get_checkpoint(s, "d") == D(2026, 3, 2)
    assert whole.fetch_daily(s, rows, "other", today)["latest"] == D(2026, 9, 1) == jobs.get_checkpoint(s, "other")


def test_history_ends_at_a_window_and_goes_on_there(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([paper(str(i), day=D(2026, 1, 1) + dt.timedelta(days=i)) for i in range(8)], PAPER)
    run = lambda limit: whole.backload_windows(s, rows, "h", D(2026, 1, 1), D(2026, 1, 8), most=2, limit=limit)
    first = run(3)
    assert first == {"count": 4, "resume_before": D(2026, 1, 4)} and run(None)["count"] == 4 and s.read("Paper").count() == 8 and run(None)["count"] == 0


def test_failed_papers_are_counted_and_stay_candidates(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    whole.load_papers(s, spark.createDataFrame([paper("1"), paper("2", "bad"), paper("3")], PAPER).repartition(1), "j")

    def read(pdf):
        import pandas as pd

        if (pdf["title"] == "bad").any():
            raise ValueError("no")
        return pd.DataFrame({"paper_id": pdf["id"], "vertex_type": "Gene", "entity_id": "g1", "name": "G"})

    assert whole.extract_mentions(s, read, "x") == {"mentions": 2, "checked": 2, "failed": 1}
    assert whole.extract_mentions(s, read, "x") == {"mentions": 0, "checked": 0, "failed": 1} and s.read("Gene").first().name == "G"


def test_drain_tells_that_work_is_left(spark):
    left = [9]
    with pytest.raises(RuntimeError):
        jobs.drain(lambda: spark.range(left[0]), lambda df: left.__setitem__(0, left[0] - 1), 3)


def test_console_keeps_literals(spark):
    assert console.run_sql(spark, "SELECT 'a--b' AS a, 'insert into x' AS b -- note").first() == ("a--b", "insert into x")
    assert console.run_sql(spark, "/* c */ SELECT '/* kept */' AS a;").first().a == "/* kept */"
    with pytest.raises(ValueError):
        console.run_sql(spark, "WITH a AS (SELECT '--') INSERT INTO x SELECT * FROM a")


def test_commands(spark, tmp_path, capsys):
    call = lambda *a: cli.main(["--store", str(tmp_path / "s"), *a], spark) or capsys.readouterr().out
    assert "papers" in call("stats", "overview") and "endpoints" in call("stats", "cache") and "papers" in call("stats", "rebuild")
    (tmp_path / "go.obo").write_text("data-version: 1\n\n[Term]\nid: GO:1\nname: n\nnamespace: biological_process\n")
    assert "['go']" in call("bio-check-releases", f"go=1={tmp_path}/go.obo") and "[]" in call("bio-check-releases", f"go=1={tmp_path}/go.obo")
    (tmp_path / "m.tsv").write_text("Identifier\tName\tGO_Term\nGO:1\tn\tGO:1\n")
    assert call("bio-reactome-maps-to", str(tmp_path / "m.tsv")).strip() == "1"
    (tmp_path / "p.json").write_text(json.dumps({"id": "0704.1", "title": "T", "categories": "cs.CL", "versions": [{"created": "Wed, 4 Mar 2026 19:18:42 GMT"}]}))
    (tmp_path / "r.json").write_text(json.dumps({"paperId": "s", "externalIds": {"ArXiv": "0704.1"}, "citationCount": 1, "referenceCount": 0, "references": [], "citations": []}))
    out = call("daily", "--arxiv", str(tmp_path / "p.json"), "--replies", str(tmp_path / "r.json"), "--today", "2026-03-05")
    assert "'created': 1" in out and "'found': 1" in out
    assert DEFAULT.node("Paper").schema["doi"] is not None
