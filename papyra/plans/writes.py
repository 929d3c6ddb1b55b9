"""Queries of upserts, extraction and incremental jobs: what they change, on the delivered tables; with their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyra.functions import encoder, text
from papyra.operators import upsert
from papyra.operators.dedupe import one_per_key
from papyra.operators.references import plain_key
from papyra.operators.upsert import CreateMissing
from papyra.plans.views import WITH_VIEWS, Views
from papyra.session import shared_dir
from papyra.sources.biology import normalise_annotations
from papyra.sources.papers import match_citation_results
from papyra.streaming import events, jobs

# What was there before counts as the old state, the rest as a batch of deliveries.
SPLIT = "2025-12-01"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Views(spark, d))
        if sql:
            ORACLE[f.__name__] = (WITH_VIEWS if views else "") + sql
        return f

    return register


def before(df: DataFrame, at: str) -> DataFrame:
    return df.where(F.col(at) < F.lit(SPLIT).cast("timestamp"))


def after(df: DataFrame, at: str) -> DataFrame:
    return df.where(F.col(at) >= F.lit(SPLIT).cast("timestamp"))


def _diseases(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = v.raw("diseases").select("disease_id", "name", "doid", "fetched_at")
    old = one_per_key(before(rows, "fetched_at"), ["disease_id"], F.desc("fetched_at"), F.asc_nulls_last("name"))
    return old.drop("fetched_at"), after(rows, "fetched_at").withColumn("pos", F.struct("fetched_at", F.coalesce("name", F.lit(""))))


_NODES = f""", old AS (SELECT disease_id, name, doid FROM (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY fetched_at DESC, name NULLS LAST) AS rn FROM diseases WHERE fetched_at < TIMESTAMP '{SPLIT}') WHERE rn = 1),
new AS (SELECT disease_id, name, doid FROM (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY fetched_at DESC, coalesce(name, '') DESC) AS rn FROM diseases WHERE fetched_at >= TIMESTAMP '{SPLIT}' AND disease_id IS NOT NULL) WHERE rn = 1)
SELECT coalesce(o.disease_id, n.disease_id) AS disease_id, CASE WHEN {{take}} THEN n.name ELSE o.name END AS name, CASE WHEN {{take}} THEN n.doid ELSE o.doid END AS doid FROM old o FULL JOIN new n ON n.disease_id = o.disease_id"""


@query(_NODES.format(take="n.disease_id IS NOT NULL"))
def upsert_nodes_update(v: Views) -> DataFrame:
    return upsert.upsert_nodes(*_diseases(v), "disease_id", True, ["name", "doid"], "pos").state


@query(_NODES.format(take="o.disease_id IS NULL"))
def upsert_nodes_insert_only(v: Views) -> DataFrame:
    return upsert.upsert_nodes(*_diseases(v), "disease_id", False, ["name", "doid"], "pos").state


@query(f"SELECT DISTINCT disease_id FROM diseases WHERE fetched_at >= TIMESTAMP '{SPLIT}' AND disease_id NOT IN (SELECT disease_id FROM diseases WHERE fetched_at < TIMESTAMP '{SPLIT}')", views=False)
def upsert_nodes_created(v: Views) -> DataFrame:
    return upsert.upsert_nodes(*_diseases(v), "disease_id", True, ["name", "doid"], "pos").created


def _edges(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = v.membership.select(F.col("gene").alias("src"), F.col("pathway").alias("dst"), "evidence_code", "loaded_at", F.col("row_id").alias("pos"))
    old = one_per_key(before(rows, "loaded_at"), ["src", "dst"], F.desc("pos")).drop("loaded_at", "pos")
    return old, after(rows, "loaded_at").drop("loaded_at")


def _genes(v: Views) -> DataFrame:
    return v.raw("entity_mentions").where("vertex_type = 'Gene' and entity_id is not null").select(F.col("entity_id").alias("gene_id")).distinct()


_EDGES = f""", old AS (SELECT gene, pathway, evidence_code FROM (SELECT *, row_number() OVER (PARTITION BY gene, pathway ORDER BY row_id DESC) AS rn FROM membership WHERE loaded_at < TIMESTAMP '{SPLIT}') WHERE rn = 1),
new AS (SELECT gene, pathway, evidence_code FROM (SELECT *, row_number() OVER (PARTITION BY gene, pathway ORDER BY row_id DESC) AS rn FROM membership WHERE loaded_at >= TIMESTAMP '{SPLIT}') WHERE rn = 1 {{ends}})
SELECT coalesce(o.gene, n.gene) AS src, coalesce(o.pathway, n.pathway) AS dst, CASE WHEN {{take}} THEN n.evidence_code ELSE o.evidence_code END AS evidence_code FROM old o FULL JOIN new n ON n.gene = o.gene AND n.pathway = o.pathway"""
_GENE_ENDS = "AND gene IN (SELECT entity_id FROM entity_mentions WHERE vertex_type = 'Gene')"
_PATHWAY_ENDS = "AND pathway IN (SELECT pathway_id FROM pathway)"


@query(_EDGES.format(take="n.gene IS NOT NULL", ends=_PATHWAY_ENDS))
def upsert_edges_src(v: Views) -> DataFrame:
    """Memberships: genes are created as needed, pathways are not, the last evidence wins."""
    return upsert.upsert_edges(*_edges(v), _genes(v), v.pathway, "gene_id", "pathway_id", CreateMissing.SRC, True, position="pos").state


@query(_EDGES.format(take="o.gene IS NULL", ends=_GENE_ENDS + " " + _PATHWAY_ENDS))
def upsert_edges_none(v: Views) -> DataFrame:
    return upsert.upsert_edges(*_edges(v), _genes(v), v.pathway, "gene_id", "pathway_id", CreateMissing.NONE, False, position="pos").state


@query(_EDGES.format(take="n.gene IS NOT NULL", ends=_GENE_ENDS))
def upsert_edges_dst(v: Views) -> DataFrame:
    return upsert.upsert_edges(*_edges(v), _genes(v), v.pathway, "gene_id", "pathway_id", CreateMissing.DST, True, position="pos").state


@query(f"SELECT DISTINCT entity_id AS gene_id FROM entity_mentions WHERE vertex_type = 'Gene' AND entity_id IS NOT NULL UNION SELECT gene FROM membership WHERE loaded_at >= TIMESTAMP '{SPLIT}' {_PATHWAY_ENDS}")
def upsert_edges_bootstrapped(v: Views) -> DataFrame:
    return upsert.upsert_edges(*_edges(v), _genes(v), v.pathway, "gene_id", "pathway_id", CreateMissing.SRC, True, position="pos").src_nodes


def _papers(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = v.raw("papers").select("id", "title", "published_date", "source", "embedding", "embedded_at", "authors", "categories", "fetched_at")
    old = one_per_key(before(rows, "fetched_at"), ["id"], F.desc("fetched_at")).drop("fetched_at").withColumn("is_stub", F.lit(False))
    stubs = v.stub.where("sid is not null").select(F.col("sid").alias("id")).distinct().join(old.select("id"), "id", "left_anti").withColumn("is_stub", F.lit(True))
    return old.unionByName(stubs, allowMissingColumns=True), after(rows, "fetched_at").withColumnRenamed("fetched_at", "pos")


_OLD_NEW = f""", old0 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC) AS rn FROM papers WHERE fetched_at < TIMESTAMP '{SPLIT}') WHERE rn = 1),
old AS (SELECT id, title, published_date, source, embedding IS NOT NULL AS e, authors, categories, false AS is_stub FROM old0
  UNION ALL SELECT DISTINCT sid, NULL, NULL, NULL, false, NULL, NULL, true FROM stub WHERE sid IS NOT NULL AND sid NOT IN (SELECT id FROM old0)),
new AS (SELECT id, title, published_date, source, embedding IS NOT NULL AS e, authors, categories FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC) AS rn FROM papers WHERE fetched_at >= TIMESTAMP '{SPLIT}') WHERE rn = 1)"""


@query(_OLD_NEW + """SELECT count(*) FILTER (o.id IS NULL) AS new_papers, count(*) FILTER (coalesce(o.is_stub, false)) AS upgraded_stubs,
CAST(coalesce(sum(CAST(n.e AS INT) - CAST(coalesce(o.e, false) AS INT)), 0) AS BIGINT) AS embedded_delta, min(n.published_date) AS earliest, max(n.published_date) AS latest FROM new n LEFT JOIN old o ON o.id = n.id""".replace("SELECT count", " SELECT count", 1))
def upsert_papers_delta(v: Views) -> DataFrame:
    return upsert.paper_delta(*_papers(v), position="pos")


@query(_OLD_NEW + " SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN o.e ELSE n.e END AS embedded, CASE WHEN n.id IS NULL THEN o.is_stub ELSE false END AS is_stub FROM old o FULL JOIN new n ON n.id = o.id")
def upsert_papers_state(v: Views) -> DataFrame:
    """The papers after the batch; a delivery without vector has taken an older one away."""
    state = upsert.upsert_papers(*_papers(v), position="pos").state
    return state.select("id", "title", F.col("embedding").isNotNull().alias("embedded"), "is_stub")


@query(_OLD_NEW + " SELECT coalesce(n.id, o.id) AS id, coalesce(o.e, false) OR coalesce(n.e, false) AS embedded FROM old o FULL JOIN new n ON n.id = o.id")
def upsert_papers_preserving(v: Views) -> DataFrame:
    state = upsert.upsert_papers(*_papers(v), position="pos", preserve_embedding=True).state
    return state.select("id", F.col("embedding").isNotNull().alias("embedded"))


def _exploded_sql(table: str, column: str) -> str:
    return f"(SELECT DISTINCT id AS paper, unnest({column}) AS x FROM {table})"


@query(_OLD_NEW + f""", was AS (SELECT * FROM {_exploded_sql('old', 'categories')} WHERE x IS NOT NULL), more AS (SELECT * FROM {_exploded_sql('new', 'categories')} WHERE x IS NOT NULL)
SELECT coalesce(a.x, b.x) AS code, coalesce(a.n, 0) + coalesce(b.n, 0) AS paper_count FROM (SELECT x, count(*) AS n FROM was GROUP BY 1) a
FULL JOIN (SELECT x, count(*) AS n FROM (SELECT * FROM more EXCEPT SELECT * FROM was) GROUP BY 1) b ON b.x = a.x""")
def category_delta(v: Views) -> DataFrame:
    """Category counts raised by new IN_CATEGORY edges only."""
    old, new = _papers(v)
    latest = upsert.last_wins(new, ["id"], "pos")
    edges = lambda df: df.select(F.col("id").alias("paper"), F.explode("categories").alias("code")).where("code is not null").distinct()
    was, more = edges(old), edges(latest)
    counts = was.groupBy("code").agg(F.count(F.lit(1)).alias("paper_count"))
    return upsert.count_new_edges(more.join(was, ["paper", "code"], "left_anti"), "code", counts, "code", "paper_count")


@query(_OLD_NEW + f""" SELECT count(DISTINCT author) AS new_authors, count(*) AS new_edges FROM (SELECT x AS author, paper FROM {_exploded_sql('new', 'authors')} WHERE x IS NOT NULL AND x <> ''
EXCEPT SELECT x, paper FROM {_exploded_sql('old', 'authors')})""")
def author_delta(v: Views) -> DataFrame:
    old, new = _papers(v)
    edges = lambda df: df.select(F.explode("authors").alias("author"), F.col("id").alias("paper")).where("author is not null and author != ''").distinct()
    created = edges(upsert.last_wins(new, ["id"], "pos")).join(edges(old), ["author", "paper"], "left_anti")
    return created.agg(F.count_distinct("author").alias("new_authors"), F.count(F.lit(1)).alias("new_edges"))


@query(""", s AS (SELECT sid, title FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY stub_id DESC) AS rn FROM stub WHERE sid IS NOT NULL) WHERE rn = 1)
SELECT id, title, false AS is_stub FROM paper UNION ALL SELECT sid, title, true FROM s WHERE sid NOT IN (SELECT id FROM paper)""")
def stub_upsert(v: Views) -> DataFrame:
    """Stubs are only inserted, never written over papers; of a repeated stub the last counts."""
    old = v.paper.select("id", "title", F.lit(False).alias("is_stub"))
    new = v.stub.select(F.col("sid").alias("id"), "title", F.lit(True).alias("is_stub"), F.col("stub_id").alias("pos"))
    return upsert.upsert_nodes(old, new, "id", False, position="pos").state


@query("SELECT DISTINCT c.src, c.dst FROM cites c JOIN paper a ON a.id = c.src JOIN paper b ON b.id = c.dst")
def citation_edges(v: Views) -> DataFrame:
    """Citation edges whose ends are both known papers."""
    ends = v.raw("papers").select("id").distinct()
    none = v.spark.createDataFrame([], "src string, dst string")
    return upsert.upsert_edges(none, v.cites, ends, ends, "id", "id").state


_RESULTS = "(SELECT id, enriched_at, reference_count, citation_count FROM enrichment)"


@query(f"""SELECT a.id, CASE WHEN e.id IS NOT NULL THEN e.citation_count END AS citation_count, CASE WHEN e.id IS NOT NULL THEN e.reference_count END AS reference_count FROM
(SELECT id FROM paper UNION SELECT sid FROM stub WHERE sid IS NOT NULL AND paper_id IS NOT NULL) a LEFT JOIN {_RESULTS} e ON e.id = a.id""")
def enrichment_state(v: Views) -> DataFrame:
    papers, _, _ = _enriched(v)
    return papers.select("id", "citation_count", "reference_count")


def _enriched(v: Views):
    bare = v.paper.select("id", "s2_paper_id", "title", F.lit(False).alias("is_stub"), F.lit(None).cast("long").alias("citation_count"), F.lit(None).cast("long").alias("reference_count"), F.lit(None).cast("timestamp").alias("enriched_at"))
    results = v.enrichment.withColumn("s2_paper_id", F.lit(None).cast("string")).withColumn("enriched_at", F.col("enriched_at").cast("timestamp"))
    stubs = v.stub.where("paper_id is not null").select("paper_id", "direction", F.col("sid").alias("id"), "title")
    return upsert.apply_enrichment(bare, results, stubs)


@query("SELECT count(*) AS newly_enriched FROM paper p JOIN enrichment e ON e.id = p.id")
def enrichment_delta(v: Views) -> DataFrame:
    return _enriched(v)[2]


@query(f"SELECT p.id, o.id IS NOT NULL OR p.embedding IS NOT NULL AS embedded FROM paper p LEFT JOIN (SELECT DISTINCT id FROM papers WHERE fetched_at >= TIMESTAMP '{SPLIT}' AND embedding IS NOT NULL) o ON o.id = p.id")
def embedding_update(v: Views) -> DataFrame:
    new = one_per_key(after(v.raw("papers"), "fetched_at").where("embedding is not null").select("id", "embedding", "embedded_at", "fetched_at"), ["id"], F.desc("fetched_at"))
    return upsert.set_embeddings(v.paper.select("id", "embedding", "embedded_at"), new).select("id", F.col("embedding").isNotNull().alias("embedded"))


@query(_OLD_NEW + """ SELECT CAST(sum(papers) AS BIGINT) AS papers, CAST(sum(embedded) AS BIGINT) AS embedded, min(earliest) AS earliest, max(latest) AS latest FROM (
SELECT count(*) AS papers, count(*) FILTER (e) AS embedded, min(published_date) AS earliest, max(published_date) AS latest FROM old WHERE NOT is_stub
UNION ALL SELECT count(*) FILTER (o.id IS NULL OR o.is_stub), sum(CAST(n.e AS INT) - CAST(coalesce(o.e, false) AS INT)), min(n.published_date), max(n.published_date) FROM new n LEFT JOIN old o ON o.id = n.id)""")
def stats_fold(v: Views) -> DataFrame:
    """The counters after the batch, by its delta alone."""
    old, new = _papers(v)
    had = old.where("not is_stub").agg(F.count(F.lit(1)).alias("papers"), F.count("embedding").alias("embedded"), F.min("published_date").alias("earliest"), F.max("published_date").alias("latest"))
    d = upsert.paper_delta(old, new, "pos")
    delta = d.select((F.col("new_papers") + F.col("upgraded_stubs")).alias("papers"), F.col("embedded_delta").alias("embedded"), "earliest", "latest")
    return upsert.fold_stats(had, delta, ["papers", "embedded"], ["earliest"], ["latest"])


@query("""SELECT g.gene_id, CASE WHEN g.blank THEN n.name ELSE g.name END AS name, g.blank AND n.name IS NOT NULL AS filled FROM
(SELECT id AS gene_id, name, row_number() OVER (ORDER BY id) % 2 = 0 OR name IS NULL AS blank FROM entity WHERE type = 'Gene') g
LEFT JOIN (SELECT entity_id, min(name) AS name FROM entity_mentions WHERE vertex_type = 'Gene' AND name IS NOT NULL GROUP BY 1) n ON n.entity_id = g.gene_id""".replace("row_number() OVER (ORDER BY id) % 2 = 0", "length(id) % 2 = 0 AND id LIKE '%1'"))
def gene_name_backfill(v: Views) -> DataFrame:
    genes = v.typed("Gene", "gene_id").withColumn("name", F.when((F.length("gene_id") % 2 == 0) & F.col("gene_id").endswith("1"), None).otherwise(F.col("name")))
    names = v.raw("entity_mentions").where("vertex_type = 'Gene'").select(F.col("entity_id").alias("gene_id"), "name")
    return upsert.backfill_names(genes, names, "gene_id")


def _mention_batches(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = v.raw("entity_mentions").where("entity_id is not null and paper_id is not null").select("paper_id", "vertex_type", "entity_id", "name", "source", "extracted_at", F.col("mention_id").alias("pos"))
    old = before(rows, "extracted_at")
    nodes = old.groupBy("vertex_type", "entity_id").agg(F.min("name").alias("name"))
    edges = one_per_key(old, ["paper_id", "vertex_type", "entity_id"], F.asc("pos")).select("paper_id", "vertex_type", "entity_id", "source")
    return nodes, edges, after(rows, "extracted_at").drop("extracted_at")


_MENTIONS = f""", rows AS (SELECT paper_id, vertex_type, entity_id, name, source, extracted_at, mention_id FROM entity_mentions WHERE entity_id IS NOT NULL AND paper_id IS NOT NULL),
old AS (SELECT * FROM rows WHERE extracted_at < TIMESTAMP '{SPLIT}'), new AS (SELECT * FROM rows WHERE extracted_at >= TIMESTAMP '{SPLIT}')"""


@query(_MENTIONS + """ SELECT coalesce(o.vertex_type, n.vertex_type) AS vertex_type, coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(o.name, n.name) AS name FROM
(SELECT vertex_type, entity_id, min(name) AS name FROM old GROUP BY 1, 2) o FULL JOIN (SELECT vertex_type, entity_id, arg_max(name, mention_id) FILTER (name IS NOT NULL) AS name FROM new GROUP BY 1, 2) n
ON n.vertex_type = o.vertex_type AND n.entity_id = o.entity_id""")
def mentions_upsert_nodes(v: Views) -> DataFrame:
    return upsert.upsert_mentions(*_mention_batches(v), "pos")[0].state


@query(_MENTIONS + " SELECT paper_id, vertex_type, entity_id, coalesce(arg_min(source, mention_id) FILTER (first), arg_min(source, mention_id) FILTER (NOT first)) AS source FROM (SELECT *, true AS first FROM old UNION ALL SELECT *, false FROM new) GROUP BY 1, 2, 3".replace("first", "is_old"))
def mentions_upsert(v: Views) -> DataFrame:
    """All MENTIONS edges after the batch; the first writer's source stays."""
    return upsert.upsert_mentions(*_mention_batches(v), "pos")[2]


_CHECKED = f"(SELECT DISTINCT paper_id FROM entity_mentions WHERE extracted_at < TIMESTAMP '{SPLIT}' AND paper_id IS NOT NULL)"


def _checked(v: Views) -> DataFrame:
    old = before(v.raw("entity_mentions"), "extracted_at").where("paper_id is not null").select(F.col("paper_id").alias("id")).distinct()
    return jobs.check_marks(old, "reader")


@query(f"SELECT id FROM paper WHERE pmid IS NOT NULL AND id NOT IN {_CHECKED}")
def extraction_candidates(v: Views) -> DataFrame:
    return jobs.candidates(v.paper.select("id", "pmid"), _checked(v), "reader", "pmid").select("id")


@query(f"SELECT 'reader:' || id AS check_id, 'reader' AS extractor, id AS paper_id FROM paper WHERE pmid IS NOT NULL AND id NOT IN {_CHECKED} UNION SELECT 'reader:' || paper_id, 'reader', paper_id FROM {_CHECKED}")
def mark_checked(v: Views) -> DataFrame:
    marks = _checked(v)
    new = jobs.check_marks(jobs.candidates(v.paper.select("id", "pmid"), marks, "reader", "pmid"), "reader")
    return upsert.upsert_nodes(marks, new, "check_id", False).state


@query(f"SELECT count(*) AS papers, count(m.paper_id) AS yielding, coalesce(CAST(sum(m.n) AS BIGINT), 0) AS mentions FROM (SELECT id FROM paper WHERE pmid IS NOT NULL AND id NOT IN {_CHECKED}) c LEFT JOIN (SELECT paper_id, count(*) AS n FROM entity_mentions GROUP BY 1) m ON m.paper_id = c.id")
def extraction_totals(v: Views) -> DataFrame:
    per = v.raw("entity_mentions").where("paper_id is not null").groupBy(F.col("paper_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return extraction_candidates(v).join(per, "id", "left").agg(F.count(F.lit(1)).alias("papers"), F.count("n").alias("yielding"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))


@query("SELECT paper_id FROM entity_mentions WHERE paper_id IS NOT NULL AND paper_id IN (SELECT id FROM papers) UNION SELECT paper_id FROM citation_stubs WHERE paper_id IN (SELECT id FROM papers)", views=False)
def semi_endpoints(v: Views) -> DataFrame:
    ids = v.raw("entity_mentions").select("paper_id").unionByName(v.raw("citation_stubs").select("paper_id")).distinct()
    return ids.join(v.raw("papers").select(F.col("id").alias("paper_id")), "paper_id", "left_semi")


@query("SELECT dst_type, count(*) AS n_edges, count(DISTINCT dst) AS n_entities FROM mention GROUP BY 1")
def mentions_by_type(v: Views) -> DataFrame:
    return v.mention.groupBy("dst_type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("dst").alias("n_entities"))


@query("SELECT DISTINCT a.name AS child_name, b.name AS parent_name FROM is_a i JOIN (SELECT *, lower(regexp_replace(disease_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS k FROM diseases) a ON a.k = i.child JOIN (SELECT *, lower(regexp_replace(disease_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS k FROM diseases) b ON b.k = i.parent WHERE a.name IS NOT NULL AND b.name IS NOT NULL")
def mesh_pairs(v: Views) -> DataFrame:
    """Every name of a child with every name of its parent, by joins on the edge."""
    names = v.raw("diseases").where("name is not null").select(plain_key(F.col("disease_id")).alias("id"), "name").distinct()
    a, b = names.select(F.col("id").alias("child"), F.col("name").alias("child_name")), names.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return v.is_a.join(a, "child").join(b, "parent").select("child_name", "parent_name").distinct()


@query("SELECT 'unresolved' AS what, count(*) AS n FROM (SELECT dst AS id FROM cites UNION SELECT src FROM cites EXCEPT SELECT id FROM papers) UNION ALL SELECT 'pending', count(*) FROM (SELECT id FROM paper EXCEPT SELECT paper_id FROM entity_mentions)")
def set_ops_pack(v: Views) -> DataFrame:
    ends = v.cites.select(F.col("dst").alias("id")).unionByName(v.cites.select(F.col("src").alias("id"))).distinct()
    known = v.raw("papers").select("id")
    pending = known.distinct().join(v.raw("entity_mentions").select(F.col("paper_id").alias("id")), "id", "left_anti")
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(ends.join(known, "id", "left_anti"), "unresolved").unionByName(count(pending, "pending"))


@query("""SELECT p.id, r.paper AS s2_paper_id, r.n AS citation_count, r.out AS reference_count, r.pmid IS NOT NULL AS found FROM paper p
LEFT JOIN (SELECT pmid, min(sid) AS paper, count(*) AS n, count(*) FILTER (direction = 'references') AS out FROM stub WHERE pmid IS NOT NULL GROUP BY 1) r ON r.pmid = p.pmid WHERE p.pmid IS NOT NULL""")
def citation_match_back(v: Views) -> DataFrame:
    """Papers asked for by their PubMed id, and stubs read as replies, matched by that id; papers without a reply stay as not found."""
    replies = v.stub.where("pmid is not null").groupBy("pmid").agg(F.min("sid").alias("paperId"), F.count(F.lit(1)).alias("citationCount"), F.count_if(F.col("direction") == "references").alias("referenceCount"))
    return match_citation_results(v.paper.where("pmid is not null").select("id", F.col("pmid").alias("identifier")), replies.withColumn("externalIds", F.create_map(F.lit("PubMed"), "pmid")), "PubMed")


# annotations and incremental jobs on the event table

_KINDS = "CASE event_type WHEN 'view' THEN 'Gene' WHEN 'click' THEN 'Compound' WHEN 'purchase' THEN 'Organism' END"


@query(f"""SELECT doc, vertex_type, entity_id, name FROM (SELECT *, row_number() OVER (PARTITION BY doc, vertex_type, entity_id ORDER BY event_id) AS rn FROM (
SELECT user_id AS doc, event_id, {_KINDS} AS vertex_type, CASE event_type WHEN 'view' THEN 'ncbigene:' || k WHEN 'click' THEN 'mesh:' || k WHEN 'purchase' THEN k END AS entity_id, CASE WHEN event_type = 'purchase' THEN props ELSE event_type END AS name
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE event_type <> 'error')) WHERE rn = 1 AND entity_id IS NOT NULL AND vertex_type IS NOT NULL""", views=False)
def mention_normalise(v: Views) -> DataFrame:
    """Events read as annotations: views are genes, clicks chemicals, purchases species, errors invalid."""
    e = v.raw("events")
    kind = text.lookup(F.col("event_type"), {"view": "Gene", "click": "Chemical", "purchase": "Species"})
    base = text.lookup(F.col("event_type"), {"view": "ncbi_gene", "click": "ncbi_mesh", "purchase": "ncbi_taxonomy"})
    rows = e.select("user_id", "event_id", kind.alias("type"), F.get_json_object("props", "$.k").alias("identifier"), F.lit(None).cast("string").alias("normalized_id"), base.alias("database"), (F.col("event_type") != "error").alias("valid"), F.col("event_type").alias("name"), F.col("props").alias("text"))
    return normalise_annotations(rows, "user_id", "event_id")


@query("SELECT event_type AS job, greatest(max(CAST(ts AS DATE)) FILTER (CAST(ts AS DATE) <= DATE '2024-01-20'), DATE '2024-01-05') AS cursor_date FROM events WHERE event_type IS NOT NULL GROUP BY 1", views=False)
def forward_cursor(v: Views) -> DataFrame:
    """Per job, that is kind of event, the newest day seen up to a guard, never before the previous cursor."""
    rows, day = v.raw("events"), F.col("ts").cast("date")
    kinds = [r[0] for r in rows.where("event_type is not null").select("event_type").distinct().collect()]  # a handful
    return v.spark.createDataFrame([(k, jobs.forward_cursor(date(2024, 1, 5), rows.where(F.col("event_type") == k), day, date(2024, 1, 20))) for k in kinds], "job string, cursor_date date")


@query("SELECT count(*) AS n, min(d) AS earliest, max(d) FILTER (d <= DATE '2024-01-20') AS latest FROM (SELECT CAST(ts AS DATE) AS d FROM events)", views=False)
def future_guard(v: Views) -> DataFrame:
    d = F.col("ts").cast("date")
    return jobs.consume_report(v.raw("events"), d, d <= F.lit("2024-01-20").cast("date"))


@query()
def date_windows(v: Views) -> DataFrame:
    """Windows of at most a tenth of all events, by bisection, the newest first."""
    e = v.raw("events").withColumn("day", F.col("ts").cast("date"))
    lo, hi, n = e.agg(F.min("day"), F.max("day"), F.count(F.lit(1))).first()
    found = list(jobs.date_windows(jobs.daily_counter(e, "day"), lo, hi, max(1, n // 10))) if n else []
    return v.spark.createDataFrame([(i, *w) for i, w in enumerate(found)], "place int, start date, end date, n long")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", views=False)
def consume_stream(v: Views) -> DataFrame:
    """Hourly counts of the event table read as a stream to its end; the sink is a table in the shared folder."""
    base = f"{shared_dir(v.spark)}/stream-{uuid.uuid4().hex}"
    schema = v.raw("events").schema
    source = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.d) if v.raw("events").inputFiles()[0].endswith("/events.parquet") else events.stream_of(v.spark, f"{v.d}/events.parquet", schema)
    job = events.hourly_counts(source).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/log").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")).trigger(availableNow=True).start()
    job.awaitTermination()
    return v.spark.read.parquet(f"{base}/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""SELECT job, started_at, count, CASE WHEN lo = hi THEN lo ELSE lo || ' to ' || hi END AS date_range FROM (SELECT event_type AS job, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started_at, count(*) AS count,
strftime(min(ts), '%Y-%m-%d') AS lo, strftime(max(ts), '%Y-%m-%d') AS hi FROM events WHERE event_type IS NOT NULL GROUP BY 1) ORDER BY started_at DESC, job LIMIT 3""", views=False)
def run_log(v: Views) -> DataFrame:
    """A run logged for every kind of event, and the last three of them in time read back."""
    at = f"{shared_dir(v.spark)}/runs-{uuid.uuid4().hex}"
    runs = v.raw("events").where("event_type is not null").groupBy("event_type").agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.count(F.lit(1)).alias("n"), F.min("ts").cast("date").alias("lo"), F.max("ts").cast("date").alias("hi"))
    for r in runs.collect():  # a handful
        jobs.log_run(v.spark, at, job=r.event_type, started_at=r.at, count=r.n, earliest=r.lo, latest=r.hi)
    return jobs.read_runs(v.spark, at, last=3).select("job", "started_at", "count", "date_range") if jobs_logged(v, at) else v.spark.createDataFrame([], "job string, started_at string, count long, date_range string")


def jobs_logged(v: Views, at: str) -> bool:
    path = v.spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(v.spark._jsc.hadoopConfiguration()).exists(path)


@query("SELECT n.source, o.version AS previous, n.version FROM (SELECT source, max(fetched_at) AS version FROM papers GROUP BY 1) n LEFT JOIN (SELECT source, max(fetched_at) AS version FROM papers WHERE published_date < DATE '2020-01-01' GROUP BY 1) o ON o.source = n.source WHERE o.version IS DISTINCT FROM n.version AND n.source IS NOT NULL", views=False)
def release_diff(v: Views) -> DataFrame:
    p = v.raw("papers").where("source is not null")
    versions = lambda df: df.groupBy("source").agg(F.max("fetched_at").alias("version"))
    return jobs.changed_releases(versions(p), versions(p.where("published_date < date'2020-01-01'")))


@query()
def embed_documents(v: Views) -> DataFrame:
    """Title and abstract encoded by the deterministic encoder."""
    p = v.paper.select("id", encoder.embedding_text(F.col("title"), F.col("abstract")).alias("t"))
    return encoder.encode_texts(p, F.col("t")).select("id", "embedding")


# scalar packs

_CUT = r"regexp_replace(substring(text, 1, 400), '[ \t\n\x0B\f\r][^ \t\n\x0B\f\r]*$', '')"


@query(f"SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE {_CUT} || '…' END AS snippet, CASE WHEN length(text) <= 45 THEN text ELSE substring(text, 1, 44) || '…' END AS clipped FROM documents", views=False)
def abstract_snippet(v: Views) -> DataFrame:
    """Of every document."""
    return v.raw("documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.clip(F.col("text")).alias("clipped"))


@query("SELECT id, coalesce(nullif(title, ''), nullif(doi, ''), id) AS label, coalesce(nullif(arxiv_id, ''), nullif(pmid, ''), id) AS shown FROM paper")
def node_label(v: Views) -> DataFrame:
    return v.paper.select("id", text.node_label(F.col("title"), F.col("doi"), F.col("id")).alias("label"), text.display_id(F.col("arxiv_id"), F.col("pmid"), F.col("id")).alias("shown"))


@query("""SELECT id, nullif(n || CASE WHEN n <> '' AND r <> '' THEN '. ' ELSE '' END || r, '') AS built FROM (SELECT id, coalesce(journal_ref, '') AS n,
coalesce(CAST(year(published_date) AS VARCHAR), '') || coalesce(';' || nullif(arxiv_id, ''), '') || coalesce('(' || nullif(pmid, '') || ')', '') || coalesce(':' || nullif(s2_paper_id, ''), '') AS r FROM paper)""")
def journal_ref(v: Views) -> DataFrame:
    """References built of every paper's columns, with all patterns of missing pieces."""
    return v.paper.select("id", text.journal_reference(F.col("journal_ref"), F.year("published_date").cast("string"), F.col("arxiv_id"), F.col("pmid"), F.col("s2_paper_id")).alias("built"))


@query("""SELECT id, coalesce(TRY_CAST(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE), TRY_CAST(y || '-01-01' AS DATE)) AS by_number,
coalesce(TRY_CAST(y || '-' || lpad(CAST(month(published_date) AS VARCHAR), 2, '0') || '-' || lpad(d, 2, '0') AS DATE), TRY_CAST(y || '-01-01' AS DATE)) AS by_name,
TRY_CAST(y || '-01-01' AS DATE) AS by_year, TRY_CAST(lpad(CAST(TRY_CAST(substring(free, 1, 4) AS INT) AS VARCHAR), 4, '0') || '-01-01' AS DATE) AS by_free
FROM (SELECT id, published_date, CAST(year(published_date) AS VARCHAR) AS y, CAST(length(coalesce(title, '')) % 15 AS VARCHAR) AS m, CAST(length(coalesce(abstract, '')) % 33 AS VARCHAR) AS d, coalesce(y || ' Spring', 'Spring ' || source) AS free FROM paper)""".replace("coalesce(y || ' Spring'", "coalesce(CAST(year(published_date) AS VARCHAR) || ' Spring'"))
def pub_date(v: Views) -> DataFrame:
    """Partial dates of every paper, with months from 0 to 14 and days from 0 to 32: by month number, by month name, by year alone, by free text."""
    y, none = F.year("published_date").cast("string"), F.lit(None).cast("string")
    m, d = ((F.length(F.coalesce(F.col(c), F.lit(""))) % n).cast("string") for c, n in (("title", 15), ("abstract", 33)))
    free = F.coalesce(F.concat(y, F.lit(" Spring")), F.concat(F.lit("Spring "), "source"))
    return v.paper.select(
        "id", text.published_date(y, m, d, none).alias("by_number"), text.published_date(y, F.date_format("published_date", "MMM"), d, none).alias("by_name"),
        text.published_date(y, none, none, none).alias("by_year"), text.published_date(none, none, none, free).alias("by_free"),
    )


@query("SELECT id, regexp_replace(arxiv_id, 'v[0-9]+$', '') AS bare, trim(replace(title, chr(10), ' ')) AS line, lower(coalesce(source, '')) || ':' || length(coalesce(title, '')) AS sized FROM paper")
def scalar_pack_text(v: Views) -> DataFrame:
    return v.paper.select("id", text.without_version(F.col("arxiv_id")).alias("bare"), text.one_line(F.col("title")).alias("line"), F.concat(F.lower(F.coalesce("source", F.lit(""))), F.lit(":"), F.length(F.coalesce("title", F.lit("")))).alias("sized"))


@query("SELECT id, len(categories) AS n, categories[1] AS first, len(list_filter(categories, lambda c: starts_with(c, 'mesh:'))) > 0 AS any_mesh FROM paper WHERE categories IS NOT NULL AND len(categories) > 0")
def scalar_pack_array(v: Views) -> DataFrame:
    c = F.col("categories")
    back = F.from_json(F.to_json(c), "array<string>")
    return v.paper.where(F.size(c) > 0).select("id", F.size(back).cast("long").alias("n"), F.try_element_at(back, F.lit(1)).alias("first"), F.exists(back, lambda x: F.coalesce(x.startswith("mesh:"), F.lit(False))).alias("any_mesh"))


@query("SELECT row_id, CASE evidence_code WHEN 'TAS' THEN 0 WHEN 'IEA' THEN 1 ELSE 99 END AS rank FROM participates_in", views=False)
def scalar_pack_map(v: Views) -> DataFrame:
    return v.raw("participates_in").select("row_id", text.evidence_rank(F.col("evidence_code")).alias("rank"))


@query("SELECT event_id, date_trunc('week', ts) AS week FROM events", views=False)
def scalar_pack_date(v: Views) -> DataFrame:
    return v.raw("events").select("event_id", text.week_start(F.col("ts")).cast("timestamp_ntz").alias("week"))
