import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from papyra.operators import crosswalk, dedupe, graph, search, upsert
from papyra.operators.upsert import CreateMissing

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# traversals


def trails(edges, seed, depth):
    once, out = set(edges), set()

    def walk(at, used):
        for e in once - used:
            for a, b in {(e[0], e[1]), (e[1], e[0])}:
                if a == at:
                    out.add(b)
                    if len(used) + 1 < depth:
                        walk(b, used | {e})

    walk(seed, frozenset())
    return out


@FEW
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), min_size=1, max_size=9), st.integers(1, 3))
def test_neighbourhood_follows_trails(spark, edges, depth):
    df = spark.createDataFrame(edges + edges[:1], "src string, dst string")
    assert {r.id for r in graph.neighbourhood(df, "a", depth).collect()} == trails(edges, "a", depth)


@pytest.mark.parametrize("edges,depth,seed_in", [([("a", "a")], 1, True), ([("a", "b"), ("b", "a")], 2, True), ([("a", "b"), ("b", "a")], 1, False), ([("a", "b")], 3, False), ([("a", "b"), ("b", "c"), ("c", "a")], 3, True), ([("a", "b"), ("b", "b"), ("b", "a")], 3, True)])
def test_seed_of_a_neighbourhood(spark, edges, depth, seed_in):
    got = {r.id for r in graph.neighbourhood(spark.createDataFrame(edges, "src string, dst string"), "a", depth).collect()}
    assert ("a" in got) == seed_in and got == trails(edges, "a", depth)


def test_neighbourhood_depth_is_clamped_and_empty_edges_give_nothing(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {r.id for r in graph.neighbourhood(df, "a", 9).collect()} == {"b", "c", "d"}
    assert graph.neighbourhood(df.limit(0), "a", 2).count() == 0


@FEW
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=14), st.sets(st.sampled_from("abcdefgh")))
def test_nearest_mapped_ancestors_equal_depth_first_search(spark, links, mapped):
    up = defaultdict(set)
    for c, p in links:
        up[c].add(p)
    want = set()
    for n in up:
        seen, todo = set(), list(up[n])
        while todo:
            x = todo.pop()
            if x in mapped:
                want.add((n, x))
            elif x not in seen:
                seen.add(x)
                todo += up.get(x, ())
    got = graph.nearest_mapped_ancestors(spark.createDataFrame(links, "child string, parent string"), spark.createDataFrame([(m,) for m in mapped], "id string"))
    assert {tuple(r) for r in got.collect()} == want


def test_projection_drops_self_edges_and_pairs_all_keys(spark):
    links = spark.createDataFrame([("x", "m"), ("m", "y"), ("s", "y")], "child string, parent string")
    keys = spark.createDataFrame([("x", "K1"), ("x", "K2"), ("y", "K3"), ("y", "K4"), ("s", "K3")], "id string, key string")
    assert {tuple(r) for r in graph.project_is_a(links, keys).collect()} == {("K1", "K3"), ("K1", "K4"), ("K2", "K3"), ("K2", "K4"), ("K3", "K4")}


def test_shared_neighbours_count_distinct_papers(spark):
    e = spark.createDataFrame([("p", "g"), ("p", "h"), ("p", "h"), ("q", "g"), ("q", "h"), ("r", "h")], "src string, dst string")
    assert [tuple(r) for r in graph.shared_neighbours(e, "g").collect()] == [("h", 2)]


def test_result_graph_resolves_ends_and_counts_hidden_edges(spark):
    v = spark.createDataFrame([("a", "A")], "id string, label string")
    e = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    nodes, inside, counts = graph.result_graph(v, e, 2)
    assert {tuple(r) for r in nodes.collect()} == {("a", "A"), ("b", "b")} and inside.count() == 1 and tuple(counts.first()) == (1, 1)


# evidence and crosswalks


@FEW
@given(st.permutations([("g", "p", "other", 0), ("g", "p", "IEA", 1), ("g", "p", "TAS", 2), ("g", "q", "x", 3), ("g", "q", "y", 4), ("h", "p", None, 5)]))
def test_best_evidence_takes_rank_then_first_row(spark, rows):
    rows = [(g, p, c, i) for i, (g, p, c, _) in enumerate(rows)]
    want = {}
    for g, p, c, i in rows:
        r = {"TAS": 0, "IEA": 1}.get(c, 99)
        if (g, p) not in want or r < want[g, p][0]:
            want[g, p] = (r, c)
    got = dedupe.best_evidence(spark.createDataFrame(rows, "g string, p string, c string, pos int"), ["g", "p"], "c", "pos")
    assert {(r.g, r.p): r.c for r in got.collect()} == {k: v[1] for k, v in want.items()}


def test_accounting_decides_unresolved_before_duplicate(spark):
    rows = spark.createDataFrame([("p", "m"), ("p", "m"), ("p", None), ("p", None), ("q", "m")], "pathway string, mesh string")
    assert dedupe.evidence_accounting(rows, ["pathway", "mesh"], "mesh").first().asDict() == {"rows_considered": 5, "dropped_unresolved": 2, "dropped_duplicate": 1}
    assert dedupe.evidence_accounting(rows.limit(0), ["pathway", "mesh"], "mesh").first().asDict() == {"rows_considered": 0, "dropped_unresolved": 0, "dropped_duplicate": 0}


def test_compound_crosswalk_conflicts(spark):
    mk = spark.createDataFrame
    acc = mk([("1", "CHEBI:1"), ("2", "CHEBI:2"), ("3", "CHEBI:3"), ("4", "CHEBI:4")], "compound_id string, accession string")
    reg = mk([("1", "50-00-0"), ("2", "64-17-5"), ("2", "64-17-6"), ("4", "67-56-1")], "compound_id string, cas string")
    heads = mk([("50-00-0", "D1"), ("64-17-5", "D2"), ("64-17-6", "D3"), ("67-56-1", "D4")], "cas string, ui string")
    cur = mk([("CHEBI:1", "D9"), ("CHEBI:3", "D7"), ("CHEBI:4", "D5"), ("CHEBI:4", "D6")], "accession string, ui string")
    got = {tuple(r) for r in crosswalk.compound_crosswalk(acc, reg, heads, cur).collect()}
    assert got == {("CHEBI:1", "mesh:D9"), ("CHEBI:3", "mesh:D7"), ("CHEBI:4", "mesh:D4")}  # 2 is ambiguous; the curated pairs of 4 are too


def test_tag_crosswalk_last_row_wins(spark):
    rows = spark.createDataFrame([("t", "g1", 0), ("t", "g2", 1), ("-", "g3", 2), ("", "g4", 3), (None, "g5", 4)], "tag string, g string, pos int")
    assert [tuple(r) for r in crosswalk.tag_crosswalk(rows, "tag", "g", [F.desc("pos")]).collect()] == [("t", "g2")]


# upserts

NODE = "id string, name string, n int"


def merged(old, new, update):
    out = {k: (a, b) for k, a, b in old}
    for k, a, b in new:
        if k is not None and (update or k not in {o[0] for o in old}):
            out[k] = (a, b)
    return out


@FEW
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, "x", "y"]), st.integers(0, 3)), max_size=8), st.booleans())
def test_node_upsert_equals_a_dictionary_and_is_idempotent(spark, new, update):
    old = [("a", "old", 1), ("z", None, None)]
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(new)], NODE + ", pos int")
    up = upsert.upsert_nodes(spark.createDataFrame(old, NODE), rows, "id", update, position="pos")
    state = {r.id: (r.name, r.n) for r in up.state.collect()}
    assert state == merged(old, new, update)
    assert {r.id for r in up.created.collect()} == set(state) - {"a", "z"}
    again = upsert.upsert_nodes(up.state, rows, "id", update, position="pos")
    assert {r.id: (r.name, r.n) for r in again.state.collect()} == state and again.created.count() == 0


def test_node_upsert_writes_only_declared_and_given_properties(spark):
    old = spark.createDataFrame([("a", "old", 1)], NODE)
    up = upsert.upsert_nodes(old, spark.createDataFrame([("a", "new", "junk"), ("b", "x", "junk")], "id string, name string, junk string"), "id", True, ["name", "n"])
    assert {tuple(r) for r in up.state.collect()} == {("a", "new", 1), ("b", "x", None)}


@pytest.mark.parametrize("create,kept", [(CreateMissing.NONE, {("s", "d")}), (CreateMissing.SRC, {("s", "d"), ("new", "d")}), (CreateMissing.DST, {("s", "d"), ("s", "new")}), (CreateMissing.BOTH, {("s", "d"), ("new", "d"), ("s", "new"), ("u", "v")})])
def test_edge_upsert_end_points(spark, create, kept):
    mk = spark.createDataFrame
    rows = mk([("s", "d", "1"), ("s", "d", "1"), ("new", "d", "1"), ("s", "new", "1"), ("u", "v", "1"), (None, "d", "1")], "src string, dst string, e string")
    up = upsert.upsert_edges(mk([], "src string, dst string, e string"), rows, mk([("s", "S")], "id string, name string"), mk([("d",)], "key string"), "id", "key", create)
    assert {(r.src, r.dst) for r in up.state.collect()} == kept == {(r.src, r.dst) for r in up.created.collect()}
    assert {r.id for r in up.src_nodes.collect()} >= {s for s, _ in kept} and {r.key for r in up.dst_nodes.collect()} >= {d for _, d in kept}


def test_edge_upsert_update_and_bootstrap_guard(spark):
    mk = spark.createDataFrame
    ends, old, new = mk([("a",)], "id string"), mk([("a", "a", "first")], "src string, dst string, e string"), mk([("a", "a", "x", 1), ("a", "a", "last", 2)], "src string, dst string, e string, pos int")
    assert [r.e for r in upsert.upsert_edges(old, new, ends, ends, "id", "id", update=True, position="pos").state.collect()] == ["last"]
    assert [r.e for r in upsert.upsert_edges(old, new, ends, ends, "id", "id", position="pos").state.collect()] == ["first"]
    with pytest.raises(ValueError):
        upsert.upsert_edges(old, new, ends, ends, "id", "id", CreateMissing.DST, bootstrappable=(True, False), position="pos")


PAPER = "id string, title string, published_date date, embedding array<float>"


@FEW
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.booleans(), st.integers(1, 20)), max_size=7))
def test_paper_delta_equals_the_difference_of_rebuilds(spark, new):
    old = spark.createDataFrame([("a", None, dt.date(2020, 1, 9), [1.0], False), ("b", None, None, None, True)], PAPER + ", is_stub boolean")
    rows = spark.createDataFrame([(k, "t", dt.date(2020, 1, d), [1.0] if e else None, i) for i, (k, e, d) in enumerate(new)], PAPER + ", pos int")
    count = lambda df: df.where("not is_stub").agg(F.count(F.lit(1)), F.count("embedding")).first()
    state = upsert.upsert_papers(old, rows, "pos").state
    d = upsert.paper_delta(old, rows, "pos").first()
    a, b = count(old), count(state)
    assert (b[0] - a[0], b[1] - a[1]) == (d.new_papers + d.upgraded_stubs, d.embedded_delta)
    kept = upsert.upsert_papers(old, rows, "pos", preserve_embedding=True).state
    assert kept.where("id = 'a' and embedding is null").count() == 0


def test_enrichment_stamps_papers_that_were_not_found(spark):
    mk, t = spark.createDataFrame, dt.datetime(2026, 1, 1)
    cols = "id string, s2_paper_id string, title string, is_stub boolean, citation_count long, reference_count long, enriched_at timestamp"
    papers = mk([("a", "S", "A", False, 5, 5, t), ("b", None, "B", False, None, None, None)], cols)
    results = mk([("a", None, None, None, t), ("b", "T", 1, 2, t)], "id string, s2_paper_id string, citation_count long, reference_count long, enriched_at timestamp")
    stubs = mk([("b", "references", "a", None), ("b", "references", "s", "S"), ("b", "citations", "q", None), ("b", "references", None, "x")], "paper_id string, direction string, id string, title string")
    state, edges, delta = upsert.apply_enrichment(papers, results, stubs)
    by = {r.id: r for r in state.collect()}
    assert by["a"].citation_count is None and by["a"].s2_paper_id is None and by["a"].enriched_at == t and by["b"].citation_count == 1
    assert by["s"].is_stub and by["s"].title == "S" and not by["a"].is_stub and by["a"].title == "A"
    assert {tuple(r) for r in edges.collect()} == {("b", "a"), ("b", "s"), ("q", "b")} and delta.first().newly_enriched == 1


def test_mentions_first_source_and_last_name(spark):
    mk = spark.createDataFrame
    nodes, edges = mk([("Gene", "g", None)], "vertex_type string, entity_id string, name string"), mk([("p", "Gene", "g", "one")], "paper_id string, vertex_type string, entity_id string, source string")
    rows = mk([("p", "Gene", "g", "n1", "two", 1), ("p", "Gene", "g", "n2", "two", 2), ("q", "Gene", "h", None, "two", 3), ("q", "Gene", None, "x", "two", 4)], "paper_id string, vertex_type string, entity_id string, name string, source string, pos int")
    up, created, all_ = upsert.upsert_mentions(nodes, edges, rows, "pos")
    assert {tuple(r) for r in up.state.select("entity_id", "name").collect()} == {("g", "n2"), ("h", None)}
    assert {(r.paper_id, r.source) for r in all_.collect()} == {("p", "one"), ("q", "two")} and created.count() == 1


def test_backfill_fills_only_missing_names(spark):
    nodes, names = spark.createDataFrame([("a", None), ("b", "B")], "k string, name string"), spark.createDataFrame([("a", "A"), ("b", "X"), ("a", None)], "k string, name string")
    assert {tuple(r) for r in upsert.backfill_names(nodes, names, "k").collect()} == {("a", "A", True), ("b", "B", False)}


# search


def bm25(docs, terms, need):
    toks = {k: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()] for k, t in docs}
    toks = {k: w for k, w in toks.items() if w}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {t: sum(t in w for w in toks.values()) for t in terms}
    out = {}
    for k, w in toks.items():
        c = Counter(w)
        if sum(t in c for t in terms) >= need:
            out[k] = round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in terms), 6)
    return out


def test_keyword_search_and_then_or(spark):
    docs = [(1, "Gene expression, gene!"), (2, "expression of cells"), (3, "a gene's cell"), (4, None), (5, ""), (6, "genes (no match)"), (7, "Выражение gene")]
    df = spark.createDataFrame(docs, "id int, t string")
    got = lambda q, **kw: {r.id: r.score for r in search.keyword_search(df, q, "id", F.col("t"), **kw).collect()}
    assert got('+gene AND "expression'.replace("AND ", "")) == pytest.approx(bm25(docs, ["gene", "expression"], 2))
    assert got("gene nowhere") == pytest.approx(bm25(docs, ["gene", "nowhere"], 1))
    assert got("gene nowhere", fallback=False) == {} and got("+-!") == {} and set(got("выражение")) == {7}
    assert set(got("gene expression", keep=F.col("id") != 1)) == {2, 3, 7}  # the only full match is filtered before the fallback is decided


def test_semantic_search_filters_after_or_before(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)] + [(9, [0.0, 0.0]), (10, None), (11, [1.0])], "id int, v array<float>")
    run = lambda **kw: [r.id for r in search.semantic_search(df, [1.0, 0.0], "id", "v", 3, F.col("id") % 2 == 1, **kw).collect()]
    assert run() == [1] and run(filter_first=True) == [1, 3, 5]


def test_entity_search_orders_by_length_then_key(spark):
    df = spark.createDataFrame([("k2", "Abc"), ("k1", "xABc"), ("k0", "abC"), ("abc", None), ("k9", "zzz")], "id string, name string")
    assert [r.id for r in search.search_entities(df, "aBc", "id", ["name", "id"]).collect()] == ["k0", "k2", "k1", "abc"]


def test_resolve_paper_precedence(spark):
    p = spark.createDataFrame([("arxiv:1", "5", "1"), ("pmid:2", "2", "5"), ("5", None, None)], "id string, pmid string, arxiv_id string")
    asked = spark.createDataFrame([("5",), ("2",), ("1",), ("s2x",)], "asked string")
    assert {r.asked: r.id for r in search.resolve_paper(p, asked).collect()} == {"5": "5", "2": "pmid:2", "1": "arxiv:1", "s2x": None}
