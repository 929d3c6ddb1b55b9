import datetime as dt
import gzip
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from papyra import cli, console, jobs as whole
from papyra.functions import encoder
from papyra.registry import DEFAULT, EdgeType, NodeType, Prop, PropType, Registry
from papyra.store import Store
from papyra.streaming import events, jobs

D = dt.date


# registry


def test_registry_conflicts_and_ends():
    r = Registry()
    r.register(NodeType("A", "id"), NodeType("A", "id"))
    with pytest.raises(ValueError):
        r.register(NodeType("A", "key"))
    r.register(EdgeType("E", "A", ("A", "B")))
    with pytest.raises(ValueError):
        r.validate()
    r.register(NodeType("B", "id", (Prop("x", PropType.DATE, True),), ("x",), "v"))
    r.validate()
    assert r.edges["E"].end_type("src") == "A" and r.edges["E"].end_type("dst", "B") == "B"
    for bad in (None, "C"):
        with pytest.raises(ValueError):
            r.edges["E"].end_type("dst", bad)
    with pytest.raises(KeyError):
        r.node("C")
    assert r.node("B").indexed_props == ["id", "x"] and r.node("B").schema["v"].dataType.simpleString() == "array<float>"
    assert r.node("B").schema["id"].metadata["key"] and not r.node("B").schema["id"].nullable
    assert r.searchable({"A": 3, "B": 1}) == []


def test_tables_are_created_once(spark):
    statements = DEFAULT.ddl("papers_test")
    assert len(statements) == 1 + 10 + 8 and all("IF NOT EXISTS" in s for s in statements) and "PARTITIONED BY (dst_type)" in next(s for s in statements if ".mentions " in s)
    for _ in range(2):
        whole.ensure_tables(spark, "papers_test")
    assert "papers_test" in console.list_databases(spark)
    rows = console.describe_tables(spark, "papers_test").where("name = 'pathway'").collect()
    assert {(r.column, r.type) for r in rows} == {("pathway_id", "string"), ("name", "string"), ("source_db", "string")}
    assert DEFAULT.searchable({"Gene": 1, "Paper": 1, "Pathway": 2}, hidden=("Pathway",)) == ["Gene"]


# console


def test_console_only_reads_unless_told(spark):
    assert console.run_sql(spark, "-- x\nSELECT 1 AS a;").first().a == 1 and console.run_sql(spark, "SHOW DATABASES").count() > 0
    assert console.run_sql(spark, "SELECT id FROM range(50)", limit=7).count() == 7 and console.run_sql(spark, "SELECT id FROM range(50)", limit=None).count() == 50
    assert console.run_sql(spark, "SELECT :x AS a", args={"x": 5}).first().a == 5
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "", " -- nothing"):
        with pytest.raises(ValueError):
            console.run_sql(spark, bad)
    console.run_sql(spark, "CREATE OR REPLACE TEMP VIEW made AS SELECT 3 AS a", read_only=False)
    assert spark.table("made").first().a == 3


# store


def test_store_versions_and_failed_writes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.tables() == [] and s.read("t", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        s.read("t")
    for i in range(4):
        s.write("t", s.read("t", "a int").unionByName(spark.createDataFrame([(i,)], "a int")))
    assert sorted(r.a for r in s.read("t").collect()) == [0, 1, 2, 3]
    before = s.current("t")
    with pytest.raises(Exception):
        s.write("t", s.read("t").select(F.raise_error(F.lit("broken")).alias("a")))
    assert s.current("t") == before and s.read("t").count() == 4
    s.register_views()
    assert spark.table("t").count() == 4 and s.tables() == ["t"]


# incremental jobs


def test_stream_is_upserted_in_micro_batches(spark, tmp_path):
    src, s = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    schema = "id string, v int, pos int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: jobs.ingest_stream(events.stream_of(spark, src, schema), s, "t", "id", str(tmp_path / "log"), "pos").awaitTermination()
    put([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)])
    run()
    put([("b", 9, 4), (None, 1, 5), ("c", 1, 6)])
    run()
    run()  # nothing new
    assert {(r.id, r.v) for r in s.read("t").collect()} == {("a", 2), ("b", 9), ("c", 1)}


def test_windowed_stream_equals_batch(spark, tmp_path):
    rng, t = random.Random(1), dt.datetime(2026, 1, 1)
    rows = [(t + dt.timedelta(minutes=rng.randrange(600)), rng.choice("ab"), float(rng.randrange(9))) for _ in range(200)] + [(None, "a", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    q = events.hourly_counts(events.stream_of(spark, str(tmp_path / "e"), df.schema), "1 day").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("hours").collect()} == {tuple(r) for r in events.hourly_counts(df).collect()}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), max_size=15), st.integers(1, 12))
def test_windows_cover_every_record_once_newest_first(days, most):
    start, end = D(2026, 1, 1), D(2026, 2, 10)
    count = lambda a, b: sum(n for i, n in days.items() if a <= start + dt.timedelta(days=i) <= b)
    got = list(jobs.date_windows(count, start, end, most))
    assert sum(n for _, _, n in got) == sum(days.values()) and all(n == count(a, b) > 0 and (n <= most or a == b) for a, b, n in got)
    assert all(a > d for (a, _, _), (_, d, _) in zip(got, got[1:]))


def test_windows_edge_cases(spark):
    assert list(jobs.date_windows(lambda a, b: 5, D(2026, 1, 2), D(2026, 1, 1), 9)) == []
    df = spark.createDataFrame([(D(2026, 1, 1),), (D(2026, 1, 1),), (None,)], "d date")
    assert list(jobs.date_windows(jobs.daily_counter(df, "d"), D(2025, 12, 1), D(2026, 1, 5), 1)) == [(D(2026, 1, 1), D(2026, 1, 1), 2)]


def test_cursors(spark, tmp_path):
    rows, d = spark.createDataFrame([(D(2026, 1, 1),), (D(2026, 9, 9),), (None,)], "d date"), F.col("d")
    assert jobs.forward_cursor(None, rows, d, None) == D(2026, 9, 9) and jobs.forward_cursor(None, rows, d, D(2026, 2, 2)) == D(2026, 1, 1)
    assert jobs.forward_cursor(D(2026, 3, 3), rows, d, D(2026, 2, 2)) == D(2026, 3, 3) and jobs.forward_cursor(None, rows.limit(0), d, None) is None
    assert tuple(jobs.consume_report(rows, d, d < "2026-05-05").first()) == (3, D(2026, 1, 1), D(2026, 1, 1))
    s = Store(spark, str(tmp_path))
    assert jobs.get_checkpoint(s, "j") is None
    for day in (D(2026, 1, 1), D(2026, 1, 2)):
        jobs.set_checkpoint(s, "j", day, "now")
    assert jobs.get_checkpoint(s, "j") == D(2026, 1, 2) and s.read("ingest_state").count() == 1


def test_backward_job_commits_after_writing():
    log = []

    def run(a, b):
        if a == D(2026, 1, 1):
            raise RuntimeError
        log.append(("run", a))

    with pytest.raises(RuntimeError):
        jobs.backward_job(iter([(D(2026, 1, 5), D(2026, 1, 9), 3), (D(2026, 1, 1), D(2026, 1, 4), 2)]), run, lambda d: log.append(("commit", d)))
    assert log == [("run", D(2026, 1, 5)), ("commit", D(2026, 1, 4))]


def test_drain_stops_when_done_or_stuck(spark):
    left = [3]
    todo = lambda: spark.range(left[0])
    assert jobs.drain(todo, lambda df: left.__setitem__(0, left[0] - 1)) == 3 and left == [0]
    left[0] = 2
    assert jobs.drain(todo, lambda df: None) == 1


def test_extraction(spark):
    papers = spark.createDataFrame([("p1", "1"), ("p2", None), ("p3", "3")], "id string, pmid string")
    marks = jobs.check_marks(papers.where("id = 'p3'"), "x")
    assert {r.id for r in jobs.candidates(papers, marks, "x", "pmid").collect()} == {"p1"}
    assert {r.id for r in jobs.candidates(papers, marks, "other").collect()} == {"p1", "p2", "p3"}

    def read(pdf):
        import pandas as pd

        if "p2" in set(pdf["id"]):
            raise RuntimeError
        return pd.DataFrame({"paper_id": [*pdf["id"], "stranger"], "vertex_type": "Gene", "entity_id": "g", "name": None})

    assert {r.paper_id for r in jobs.extract(papers.repartition(3, "id"), read).collect()} <= {"p1", "p3"}


def test_releases(spark):
    now, saved = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "source string, version string"), spark.createDataFrame([("a", "1"), ("b", "1")], "source string, version string")
    assert {tuple(r) for r in jobs.changed_releases(now, saved).collect()} == {("a", "1", "2"), ("c", None, "1")}


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(3):
        jobs.log_run(spark, path, job="j" if i else "k", started_at=f"2026-01-0{i + 1}", count=i, earliest=D(2026, 1, 1), latest=D(2026, 1, 1 + i))
    assert [(r.started_at, r.date_range) for r in jobs.read_runs(spark, path, "j", 1).collect()] == [("2026-01-03", "2026-01-01 to 2026-01-03")]
    assert [r.date_range for r in jobs.read_runs(spark, path, "k").collect()] == ["2026-01-01"] and jobs.read_runs(spark, path).count() == 3


# encoder


def test_encoder(spark):
    df = spark.createDataFrame([("a b",), ("b a",), (None,), ("",)], "t string")
    v = [r.embedding for r in encoder.encode_texts(df, F.col("t")).collect()]
    assert v[0] == v[1] and v[2] is None and all(abs(np.linalg.norm(x) - 1) < 1e-6 for x in (v[0], v[3]))

    def broken(texts):
        raise OSError

    assert {r.embedding for r in encoder.encode_texts(df, F.col("t"), broken).collect()} == {None}


# whole jobs and command line


def test_jobs_and_command_line(spark, tmp_path, capsys):
    rows = [{"id": f"070{i}.1", "title": f"Gene title {i}", "abstract": "expression of a gene", "categories": "cs.CL", "authors_parsed": [["Holm", "Rosa"]], "versions": [{"created": f"Mon, {i + 1} Apr 2007 19:18:42 GMT"}]} for i in range(3)]
    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    base = ["--store", str(tmp_path / "store"), "--log", str(tmp_path / "runs")]
    call = lambda *a: cli.main([*base, *a], spark) or capsys.readouterr().out
    assert "'created': 3" in call("backload", str(tmp_path / "s.json.gz"), "--only", "cs") and "'created': 0" in call("backload", str(tmp_path / "s.json.gz"))
    assert "backload" in call("runs") and "Gene title 2" in call("stats", "latest", "--limit", "1") and "Rosa Holm" in call("stats", "top-authors")
    assert "arxiv:0700.1" in call("search-keyword", "gene expression") and "arxiv:070" in call("search-semantic", "gene title") and "Gene title" in call("sql", "SELECT title FROM Paper")
    assert call("backfill-embeddings").strip() == "0" and call("citations", "nothing") == ""
    s = Store(spark, str(tmp_path / "store"))
    assert {tuple(r) for r in s.read("Category").select("code", "vocabulary", "paper_count").collect()} == {("arxiv:cs.CL", "arxiv", 3)} and s.read("AUTHORED").count() == 3


def test_reference_files_into_the_graph(spark, tmp_path):
    from tests.test_sources import DO, GO, note, put

    s = Store(spark, str(tmp_path / "store"))
    assert whole.load_process_ontology(s, put(tmp_path, "go.obo", GO)) == 1
    assert whole.load_disease_ontology(s, put(tmp_path, "do.obo", DO.replace(' {x="y"}', ""))) == {"diseases": 2, "edges": 1}
    assert {tuple(r) for r in s.read("IS_A").collect()} == {("mesh:D1", "mesh:D4")}
    listed = put(tmp_path, "p.txt", "R-1\tone\tHomo sapiens\n")
    rows = put(tmp_path, "g.txt", "1\tR-1\tu\tn\tTAS\tHomo sapiens\n2\tR-9\tu\tn\tTAS\tHomo sapiens\n")
    maps = put(tmp_path, "m.txt", "Identifier\tName\tGO_Term\nR-1\ta\tGO:1\nR-1\ta\tGO:77\n")
    walk = spark.createDataFrame([("CHEBI:1", "mesh:C1")], "accession string, mesh string")
    out = whole.load_pathways(s, listed, rows, rows, walk, maps)
    assert (out["participates"], out["produces"], out["mapped"]) == (1, 1, 1) and {r.gene_id for r in s.read("Gene").collect()} == {"ncbigene:1"} and s.read("Compound").count() == 1
    papers = spark.createDataFrame([("pmid:1", "1"), ("arxiv:1", "1"), ("pmid:2", "2"), ("arxiv:9", None)], "id string, pmid string")
    whole._nodes(s, "Paper", papers, True)
    path = put(tmp_path, "a.json", json.dumps({"documents": [{"pmid": "1", "passages": [{"annotations": [note("Gene", "1", None, "ncbi_gene", name="G")]}]}]}))
    assert whole.load_mentions(s, path) == {"mentions": 1, "checked": 3} and whole.load_mentions(s, path) == {"mentions": 0, "checked": 0}
    assert {tuple(r) for r in s.read("Gene").collect()} == {("ncbigene:1", "G")} and s.read("MENTIONS").first().src == "pmid:1"


# stored counters


def test_counters_hints_and_endpoints(spark, tmp_path):
    from papyra import stats

    s = Store(spark, str(tmp_path / "store"))
    assert stats.counters(s).first().papers == 0 and stats.hints(s) == []
    papers = spark.createDataFrame([("a", False, 3, [1.0], D(2020, 1, 1)), ("b", False, None, None, D(2021, 1, 1)), ("s", True, None, None, D(1999, 1, 1))], "id string, is_stub boolean, citation_count long, embedding array<float>, published_date date")
    whole._nodes(s, "Paper", papers, True)
    whole._nodes(s, "Gene", spark.createDataFrame([("g", "GEN1"), ("h", "GEN2")], "gene_id string, name string"), True)
    whole._nodes(s, "Category", spark.createDataFrame([("c",), ("d",)], "code string"), True)
    whole._edges(s, "IN_CATEGORY", spark.createDataFrame([("a", "c"), ("b", "c")], "src string, dst string"), whole.CreateMissing.NONE, False)
    s.write("MENTIONS", spark.createDataFrame([("a", "h", "Gene", "x"), ("b", "h", "Gene", "x"), ("a", "g", "Gene", "x")], "src string, dst string, dst_type string, source string"))
    r = stats.rebuild(s).first()
    assert (r.papers, r.enriched, r.embedded, r.stubs, r.authors, r.categories, r.earliest, r.latest) == (2, 1, 1, 1, 0, 2, D(2020, 1, 1), D(2021, 1, 1))
    assert r.hints == ["GEN2"] and stats.placeholder(r.hints) == "e.g. GEN2" and r.endpoints["MENTIONS"] == [("Paper", "Gene")] and r.endpoints["IS_A"] == []
    assert {(c.code, c.paper_count) for c in s.read("Category").collect()} == {("c", 2), ("d", 0)}
    delta = spark.createDataFrame([(1, None, 1, -1, 0, 0, 4, None, 2, D(2019, 1, 1), None)], stats.COUNTERS)
    r = stats.apply_delta(s, delta).first()
    assert (r.papers, r.enriched, r.embedded, r.stubs, r.earliest, r.latest, r.hints) == (3, 1, 2, 0, D(2019, 1, 1), D(2021, 1, 1), ["GEN2"]) and (r.authored_edges, r.category_edges, r.citation_edges) == (4, 2, 2)


def test_changed_sources_are_loaded_and_saved_after_the_load(spark, tmp_path):
    from papyra import stats

    s, ran = Store(spark, str(tmp_path / "store")), []
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("z", "1")], "source string, version string")

    def fails():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        stats.reingest_changed(s, now, {"a": lambda: ran.append("a"), "b": fails})
    assert ran == ["a"] and stats.reingest_changed(s, now, {"a": lambda: ran.append("a"), "b": lambda: ran.append("b")}) == ["b"] and ran == ["a", "b"]
