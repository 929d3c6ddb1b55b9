"""Whole jobs over a store: load papers, reference files and mentions; each is idempotent and returns what it did."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyra.functions.encoder import embedding_text, encode_texts, hashing_encoder
from papyra.functions.text import canonical_id
from papyra.operators import upsert
from papyra.operators.crosswalk import disease_xrefs
from papyra.operators.graph import project_is_a
from papyra.operators.upsert import CreateMissing
from papyra.registry import DEFAULT
from papyra import stats
from papyra.session import Cut
from papyra.sources import biology
from papyra.sources.papers import match_citation_results, usable_stubs
from papyra.store import Store
from papyra.streaming import jobs


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _nodes(store: Store, kind: str, rows: DataFrame, update: bool, position: str | None = None) -> int:
    t = DEFAULT.node(kind)
    up = upsert.upsert_nodes(store.read(kind, t.schema), rows, t.key, update, upsert.written_props([p.name for p in t.all_props if p.name != t.key], rows), position)
    created = up.created.count()
    store.write(kind, up.state)
    return created


def _new_edges(store: Store, kind: str, rows: DataFrame, create: CreateMissing, update: bool, position: str | None = None) -> DataFrame:
    """Upserts edges and returns those created, written before the state changes."""
    e = DEFAULT.edges[kind]
    a, b = DEFAULT.node(e.end_type("src")), DEFAULT.node(e.end_type("dst"))
    up = upsert.upsert_edges(store.read(kind, e.schema), rows, store.read(a.name, a.schema), store.read(b.name, b.schema), a.key, b.key, create, update, (a.bootstrappable, b.bootstrappable), position)
    created = Cut(store.spark, "created")(up.created)
    for make, node, grown in ((CreateMissing.SRC, a, up.src_nodes), (CreateMissing.DST, b, up.dst_nodes)):
        if create in (make, CreateMissing.BOTH):
            store.write(node.name, grown)
    store.write(kind, up.state)
    return created


def _edges(store: Store, kind: str, rows: DataFrame, create: CreateMissing, update: bool, position: str | None = None) -> int:
    return _new_edges(store, kind, rows, create, update, position).count()


def load_papers(store: Store, papers: DataFrame, job: str, log: str | None = None, encoder=hashing_encoder, tracked: date | None = None) -> dict:
    """Papers of any source into the graph: embedded, upserted whole, with categories, authors, their edges and the counters.

    Papers without identifier are dropped; of a repeated id the last delivery counts, by the column ``delivered`` where the
    source gives it, else by the order of the rows. If the encoder fails the papers are written without vectors.
    ``heading_names``, if there, names the categories; others are their own name. Counters are raised by what the batch
    changes, so a batch that is loaded again changes none. ``tracked``: dates after it don't move the reported range.
    """
    started, cut = now(), Cut(store.spark, job)
    stats.counters(store)
    rows = papers.withColumn("id", canonical_id(F.col("arxiv_id"), F.col("pmid"), F.col("s2_paper_id"))).where("id is not null")
    rows = upsert.last_wins(rows, ["id"], "delivered" if "delivered" in papers.columns else None)
    rows = encode_texts(rows.withColumn("__text", embedding_text(F.col("title"), F.col("abstract"))), F.col("__text"), encoder).drop("__text")
    rows = rows if "fetched_at" in rows.columns else rows.withColumn("fetched_at", F.lit(started))
    rows = cut(rows.withColumn("embedded_at", F.when(F.col("embedding").isNotNull(), F.lit(started))).withColumn("is_stub", F.lit(False)))  # encoded once
    change = upsert.paper_delta(stats.node(store, "Paper"), rows).first()
    _nodes(store, "Paper", rows, True)

    names = F.col("heading_names") if "heading_names" in rows.columns else F.array().cast("array<string>")
    named = rows.select(F.col("id").alias("src"), F.explode(F.arrays_zip(F.col("categories").alias("code"), names.alias("name"))).alias("c")).select("src", F.col("c.code").alias("dst"), F.col("c.name").alias("name")).where("dst is not null")
    fresh = named.groupBy(F.col("dst").alias("code")).agg(F.max("name").alias("name")).select("code", F.substring_index("code", ":", 1).alias("vocabulary"), F.coalesce("name", F.expr("substring(code, locate(':', code) + 1)")).alias("name"))
    categories = _nodes(store, "Category", fresh, True)
    filed = _new_edges(store, "IN_CATEGORY", named.select("src", "dst").distinct(), CreateMissing.NONE, False)
    stored = stats.node(store, "Category")
    store.write("Category", upsert.count_new_edges(filed, "dst", stored, "code", "paper_count").select(*stored.columns))

    people = rows.select(F.explode("authors").alias("src"), F.col("id").alias("dst")).where("src is not null and src != ''").distinct()
    authors = _nodes(store, "Author", people.select(F.col("src").alias("name")).distinct(), False)
    wrote = _edges(store, "AUTHORED", people, CreateMissing.NONE, False)
    stats.raise_counters(
        store, papers=change.new_papers + change.upgraded_stubs, stubs=-change.upgraded_stubs, embedded=change.embedded_delta, authors=authors, categories=categories,
        authored_edges=wrote, category_edges=filed.count(), earliest=change.earliest, latest=change.latest,
    )
    dated = F.col("published_date")
    report = jobs.consume_report(rows, dated, dated <= F.lit(tracked) if tracked else None).first()
    if log:
        jobs.log_run(store.spark, log, job=job, started_at=started.isoformat(), count=report.n, earliest=report.earliest, latest=report.latest)
    return {"count": report.n, "created": change.new_papers, "earliest": report.earliest, "latest": report.latest}


def week_start(day: date) -> date:
    return day - timedelta(days=day.weekday())


def fetch_daily(store: Store, records: DataFrame, job: str, today: date, log: str | None = None, guarded: bool = False, encoder=hashing_encoder) -> dict:
    """Records published since the job's cursor, or since the start of the week where there is none; the cursor then moves to the newest day seen.

    ``guarded``: days after ``today`` are loaded but don't move the cursor, as some journals date their issues ahead.
    """
    since = jobs.get_checkpoint(store, job) or week_start(today)
    out = load_papers(store, records.where(F.col("published_date") >= F.lit(since)), job, log, encoder, today if guarded else None)
    newest = max(since, out["latest"]) if out["latest"] else None
    if newest:
        jobs.set_checkpoint(store, job, newest, now().isoformat())
    return out | {"since": since}


def backload_windows(store: Store, records: DataFrame, job: str, start: date, end: date, most: int = 9500, limit: int | None = None, log: str | None = None, encoder=hashing_encoder) -> dict:
    """History from ``end`` back to ``start`` in windows of at most ``most`` records, the newest first.

    A run that was stopped goes on before the last window it finished. ``limit`` ends a run at the boundary of the window in
    which so many records were reached, so it may overshoot; the next run resumes there.
    """
    resumed = jobs.get_checkpoint(store, job)
    end = min(end, resumed) if resumed else end
    windows = jobs.until(jobs.date_windows(jobs.daily_counter(records, "published_date"), start, end, most), limit)
    run = lambda a, b: load_papers(store, records.where(F.col("published_date").between(F.lit(a), F.lit(b))), job, log, encoder)
    total = jobs.backward_job(windows, run, lambda day: jobs.set_checkpoint(store, job, day, now().isoformat(), forward=False))
    return {"count": total, "resume_before": jobs.get_checkpoint(store, job)}


def enrich(store: Store, fetch: Callable[[DataFrame, str], DataFrame], batch: int = 500, limit: int | None = None, log: str | None = None) -> dict:
    """Citation data for papers that have none yet, a batch at a time until nothing is left, or ``limit`` papers are done.

    ``fetch(asked, namespace)`` gives the replies to ``asked(id, identifier)``: paperId, externalIds, citationCount, referenceCount, and
    ``references`` and ``citations``, arrays of (paperId, externalIds, title). Papers go by their arXiv id, else by their PubMed id.
    Every asked paper is stamped, found or not. References and citations become stub papers and CITES edges; counters are
    raised by what is new.
    """
    started, done = now(), {"papers": 0, "found": 0, "stubs": 0, "edges": 0}
    stats.counters(store)

    def todo() -> DataFrame:
        rows = stats.node(store, "Paper").where("enriched_at is null and not is_stub and (arxiv_id is not null or pmid is not null)").select("id", "arxiv_id", "pmid")
        return rows.limit(0) if limit is not None and done["papers"] >= limit else rows

    def work(rows: DataFrame) -> None:
        cut = Cut(store.spark, "enrich")
        asked = cut(rows.orderBy("id").limit(batch if limit is None else min(batch, limit - done["papers"])))
        results = stubs = None
        for namespace, mine in (("ArXiv", asked.where("arxiv_id is not null").select("id", F.col("arxiv_id").alias("identifier"))), ("PubMed", asked.where("arxiv_id is null").select("id", F.col("pmid").alias("identifier")))):
            replies = cut(fetch(mine, namespace))
            got = match_citation_results(mine, replies, namespace)
            by = replies.where("externalIds is not null").select(F.try_element_at("externalIds", F.lit(namespace)).alias("identifier"), "references", "citations").join(mine, "identifier")
            for direction in ("references", "citations"):
                s = by.select(F.col("id").alias("paper_id"), F.lit(direction).alias("direction"), F.explode(usable_stubs(F.col(direction))).alias("s"))
                s = s.select("paper_id", "direction", "s.*", canonical_id(F.col("s.arxiv_id"), F.col("s.pmid"), F.col("s.s2_paper_id")).alias("id"))
                stubs = s if stubs is None else stubs.unionByName(s)
            results = got if results is None else results.unionByName(got)
        results, stubs = cut(results.withColumn("enriched_at", F.lit(started))), cut(stubs)
        papers, edges, delta = upsert.apply_enrichment(stats.node(store, "Paper"), results.drop("found"), stubs)
        before = stats.node(store, "Paper").select("id")
        made = cut(papers.where("is_stub").select("id").join(before, "id", "left_anti")).count()
        newly = delta.first().newly_enriched
        edges = cut(edges)
        store.write("Paper", papers)
        linked = _edges(store, "CITES", edges, CreateMissing.NONE, False)
        stats.raise_counters(store, enriched=newly, stubs=made, citation_edges=linked)
        for k, n in (("papers", asked.count()), ("found", results.where("found").count()), ("stubs", made), ("edges", linked)):
            done[k] += n

    jobs.drain(todo, work, 1_000_000)
    if log:
        jobs.log_run(store.spark, log, job="enrich", started_at=started.isoformat(), count=done["papers"])
    return done


def run_daily(store: Store, steps: list[tuple[str, Callable[[], object]]], log: str | None = None) -> dict:
    """The steps of a day in their order: sources first, then enrichment, then extraction. A step that fails ends the day; what was done before it stays."""
    out = {}
    for name, step in steps:
        out[name] = step()
    return out


def load_process_ontology(store: Store, path: str) -> int:
    return _nodes(store, "Pathway", biology.process_pathways(biology.ontology_terms(store.spark, path)), True)


def load_disease_ontology(store: Store, path: str) -> dict:
    """Disease names and DOIDs first, then the subtype edges between diseases that are there."""
    terms = biology.ontology_terms(store.spark, path)
    xrefs = disease_xrefs(terms)
    created = _nodes(store, "Disease", xrefs.select(F.col("mesh").alias("disease_id"), "name", "doid"), True)
    live = terms.where("not is_obsolete")
    keys = live.select("id", F.explode("xrefs").alias("x")).where(F.col("x").startswith("MESH:")).select("id", F.concat(F.lit("mesh:"), F.substr("x", F.lit(6))).alias("key"))
    links = live.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
    return {"diseases": created, "edges": _edges(store, "IS_A", project_is_a(links, keys), CreateMissing.NONE, False)}


def load_pathway_mappings(store: Store, path: str) -> int:
    """Only the mappings of pathways to processes, where both are there already."""
    return _edges(store, "MAPS_TO", biology.pathway_mappings(store.spark, path), CreateMissing.NONE, False)


def load_pathways(store: Store, listed: str, memberships: str, compounds: str | None = None, crosswalk: DataFrame | None = None, mappings: str | None = None) -> dict:
    """Pathways, gene memberships (genes created as needed), produced compounds (created as needed) and mappings to processes."""
    out = {"pathways": _nodes(store, "Pathway", biology.listed_pathways(store.spark, listed), True)}
    rows, facts = biology.gene_memberships(store.spark, memberships)
    out["participates"] = _edges(store, "PARTICIPATES_IN", rows.select(F.col("gene_id").alias("src"), F.col("pathway_id").alias("dst"), "evidence_code"), CreateMissing.SRC, True)
    out["participates_rows"] = facts.first().asDict()
    if compounds:
        rows, facts = biology.produced_compounds(store.spark, compounds, crosswalk)
        out["produces"] = _edges(store, "PRODUCES", rows.select(F.col("pathway_id").alias("src"), F.col("compound_id").alias("dst"), "evidence_code"), CreateMissing.DST, True)
        out["produces_rows"] = facts.first().asDict()
    if mappings:
        out["mapped"] = load_pathway_mappings(store, mappings)
    return out


def write_mentions(store: Store, mentions: DataFrame) -> int:
    """Mentions ``paper_id, vertex_type, entity_id, name, source, pos`` into the four node types and MENTIONS, see ``upsert_mentions``. Returns the number of new edges."""
    cut = Cut(store.spark, "mentions")
    old = stats.edge(store, "MENTIONS")
    nodes = None
    for kind in DEFAULT.edges["MENTIONS"].ends[1]:
        mine = stats.node(store, kind).select(F.lit(kind).alias("vertex_type"), F.col(DEFAULT.node(kind).key).alias("entity_id"), "name")
        nodes = mine if nodes is None else nodes.unionByName(mine)
    edges = old.select(F.col("src").alias("paper_id"), F.col("dst_type").alias("vertex_type"), F.col("dst").alias("entity_id"), "source")
    up, created, every = upsert.upsert_mentions(nodes, edges, cut(mentions), "pos")
    state, created = cut(up.state), cut(created)
    for kind in DEFAULT.edges["MENTIONS"].ends[1]:
        key = DEFAULT.node(kind).key
        named = state.where(F.col("vertex_type") == kind).select(F.col("entity_id").alias(key), "name")
        _nodes(store, kind, named, True)
    new = created.select(F.col("paper_id").alias("src"), F.col("entity_id").alias("dst"), F.col("vertex_type").alias("dst_type"), "source")
    store.write("MENTIONS", old.unionByName(new.select(*old.columns)))
    return new.count()


def extract_mentions(store: Store, function, extractor: str, requires: str | None = None, batch: int | None = None) -> dict:
    """Runs a table function over the papers this extractor hasn't checked, writes its mentions and marks the papers it didn't fail on.

    ``function(pandas id, title, abstract, pmid)`` gives paper_id, vertex_type, entity_id, name. Failed papers are counted and stay candidates.
    """
    todo = jobs.candidates(stats.node(store, "Paper").where("not is_stub").select("id", "title", "abstract", "pmid"), stats.node(store, "ExtractionChecked"), extractor, requires)
    cut = Cut(store.spark, "extract")
    todo = cut(todo if batch is None else todo.orderBy("id").limit(batch))
    got = cut(jobs.attempts(todo, function))
    made = write_mentions(store, jobs.found(got).withColumn("source", F.lit(extractor)))
    failed = jobs.failures(got)
    checked = _nodes(store, "ExtractionChecked", jobs.check_marks(todo, extractor, failed).withColumn("checked_at", F.lit(now())), False)
    return {"mentions": made, "checked": checked, "failed": failed.count()}


def load_mentions(store: Store, annotations: str, extractor: str = "pubtator") -> dict:
    """Mentions of the annotated papers that this extractor has not checked; every candidate with a PubMed id is marked.

    Two papers of one PubMed id share its annotations with the one of the larger id; the other is marked all the same.
    """
    todo = Cut(store.spark, "todo")(jobs.candidates(stats.node(store, "Paper").select("id", "pmid"), stats.node(store, "ExtractionChecked"), extractor, "pmid"))
    by = todo.groupBy("pmid").agg(F.max("id").alias("paper_id"))
    found = biology.annotation_mentions(store.spark, annotations).join(by, "pmid").select("paper_id", "vertex_type", "entity_id", "name")
    total = write_mentions(store, found.withColumn("source", F.lit(extractor)).withColumn("pos", F.monotonically_increasing_id()))
    marks = jobs.check_marks(todo, extractor).withColumn("checked_at", F.lit(now()))
    checked = _nodes(store, "ExtractionChecked", marks, False)
    return {"mentions": total, "checked": checked}


def backfill_embeddings(store: Store, encoder=hashing_encoder) -> int:
    """Vectors for full papers without one."""
    papers = store.read("Paper", DEFAULT.node("Paper").schema)
    todo = papers.where("embedding is null and not is_stub and (title is not null or abstract is not null)").select("id", embedding_text(F.col("title"), F.col("abstract")).alias("__text"))
    done = encode_texts(todo, F.col("__text"), encoder).where("embedding is not null").select("id", "embedding", F.lit(now()).alias("embedded_at"))
    done = Cut(store.spark, "embeddings")(done)
    n = done.count()
    if n:
        stats.counters(store)
        store.write("Paper", upsert.set_embeddings(papers, done))
        stats.raise_counters(store, embedded=n)
    return n


def ensure_tables(spark: SparkSession, schema: str) -> None:
    DEFAULT.ensure(spark, schema)
