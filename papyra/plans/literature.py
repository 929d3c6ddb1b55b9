"""Queries over the graph: lookups, lists, neighbourhoods, counts, search, pages; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyra.functions import text
from papyra.operators import graph, search
from papyra.operators.dedupe import evidence_accounting, one_per_key
from papyra.plans.views import WITH_VIEWS, Views
from papyra.sources.papers import category_prefix, in_range

# Anchors of the page queries.
GENE, COMPOUND, ORGANISM, TRAIT, CATEGORY = "ncbigene:700004", "mesh:D960003", "990017", "mesh:D1000001", "mesh:D970001"
NAME_PART = "ri"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a function of the views as a query, with its SQL (after the views' SQL unless ``views`` is false)."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Views(spark, d))
        if sql:
            ORACLE[f.__name__] = (WITH_VIEWS if views else "") + sql
        return f

    return register


# lookups and filters


@query("SELECT id, arxiv_id, pmid, s2_paper_id, coalesce('arxiv:' || nullif(arxiv_id, ''), 'pmid:' || nullif(pmid, ''), 's2:' || nullif(s2_paper_id, '')) AS canonical FROM paper")
def paper_identity(v: Views) -> DataFrame:
    return v.paper.select("id", "arxiv_id", "pmid", "s2_paper_id", text.canonical_id(F.col("arxiv_id"), F.col("pmid"), F.col("s2_paper_id")).alias("canonical"))


@query("SELECT id, title, published_date, source, primary_category FROM paper WHERE id = (SELECT id FROM anchor)")
def paper_lookup(v: Views) -> DataFrame:
    return v.paper.where(F.col("id") == v.anchor_paper()).select("id", "title", "published_date", "source", "primary_category")


@query(f"SELECT pathway_id, name, source_db FROM pathway WHERE pathway_id = (SELECT pathway FROM anchor_pathway)")
def pathway_lookup(v: Views) -> DataFrame:
    return v.pathway.where(F.col("pathway_id") == v.anchor_pathway()).select("pathway_id", "name", "source_db")


@query(f"SELECT id, name FROM entity WHERE type = 'Gene' AND id = '{GENE}'")
def gene_lookup(v: Views) -> DataFrame:
    return v.entity.where((F.col("type") == "Gene") & (F.col("id") == GENE)).select("id", "name")


@query(f"SELECT 'Compound' AS kind, id, name FROM entity WHERE type = 'Compound' AND id = '{COMPOUND}' UNION ALL SELECT 'Organism', id, name FROM entity WHERE type = 'Organism' AND id = '{ORGANISM}' UNION ALL SELECT 'Trait', id, name FROM entity WHERE type = 'Disease' AND id = '{TRAIT}'")
def typed_lookups(v: Views) -> DataFrame:
    hit = ((F.col("type") == "Compound") & (F.col("id") == COMPOUND)) | ((F.col("type") == "Organism") & (F.col("id") == ORGANISM)) | ((F.col("type") == "Disease") & (F.col("id") == TRAIT))
    return v.entity.where(hit).select(F.when(F.col("type") == "Disease", "Trait").otherwise(F.col("type")).alias("kind"), "id", "name")


@query("SELECT kind, id, label FROM labels WHERE kind = 'Disease' AND id = (SELECT min(disease_id) FROM disease)")
def generic_record(v: Views) -> DataFrame:
    first = v.disease.agg(F.min("disease_id")).first()[0]
    return v.labels.where((F.col("kind") == "Disease") & (F.col("id") == first))


_ASKED = "(SELECT id AS asked FROM anchor UNION SELECT min(pmid) FROM paper UNION SELECT min(arxiv_id) FROM paper UNION SELECT 'no such paper')"


@query(f"""SELECT asked, coalesce(a.id, b.id, c.id) AS id FROM {_ASKED} k LEFT JOIN (SELECT id FROM paper) a ON a.id = asked
LEFT JOIN (SELECT pmid, min(id) AS id FROM paper GROUP BY 1) b ON b.pmid = asked LEFT JOIN (SELECT arxiv_id, min(id) AS id FROM paper GROUP BY 1) c ON c.arxiv_id = asked""")
def resolve_paper_id(v: Views) -> DataFrame:
    low = v.paper.agg(F.min("pmid"), F.min("arxiv_id")).first()
    asked = v.spark.createDataFrame([(x,) for x in (v.anchor_paper(), *low, "no such paper")], "asked string").distinct()
    return search.resolve_paper(v.paper, asked)


@query("SELECT id FROM all_paper WHERE enriched_at IS NULL AND NOT is_stub AND (arxiv_id IS NOT NULL OR pmid IS NOT NULL) ORDER BY id LIMIT 50")
def unenriched_candidates(v: Views) -> DataFrame:
    return v.all_paper.where("enriched_at is null and not is_stub and (arxiv_id is not null or pmid is not null)").select("id").orderBy("id").limit(50)


@query("SELECT id FROM paper WHERE embedding IS NULL AND abstract IS NOT NULL ORDER BY id LIMIT 50")
def unembedded_candidates(v: Views) -> DataFrame:
    return v.paper.where("embedding is null and abstract is not null").select("id").orderBy("id").limit(50)


@query("SELECT is_stub, count(*) AS n_papers FROM all_paper GROUP BY 1")
def stub_split(v: Views) -> DataFrame:
    return v.all_paper.groupBy("is_stub").agg(F.count(F.lit(1)).alias("n_papers"))


@query("SELECT id, CASE WHEN source IN ('arxiv', 'kaggle') THEN 'arxiv' WHEN source IN ('pubmed', 'pubmed_baseline') THEN 'pubmed' ELSE source END AS family FROM paper")
def source_family(v: Views) -> DataFrame:
    return v.paper.select("id", text.source_family(F.col("source")).alias("family"))


@query("SELECT id FROM paper WHERE len(list_filter(categories, lambda c: c = 'arxiv:q-bio' OR starts_with(c, 'arxiv:q-bio.'))) > 0 AND published_date BETWEEN DATE '2010-01-01' AND DATE '2019-12-31'")
def source_filters(v: Views) -> DataFrame:
    return v.paper.where(category_prefix(F.col("categories"), ["arxiv:q-bio"]) & in_range(F.col("published_date"), "2010-01-01", "2019-12-31")).select("id")


# entity search


@query(f"SELECT id, name FROM entity WHERE type = 'Gene' AND contains(lower(name), '{NAME_PART}') ORDER BY length(name), id LIMIT 20")
def search_genes(v: Views) -> DataFrame:
    return search.search_entities(v.typed("Gene", "id"), NAME_PART, "id", ["name"], 20)


@query(f"SELECT id, name FROM entity WHERE type = 'Organism' AND (contains(lower(name), '{NAME_PART}') OR contains(lower(id), '{NAME_PART}')) ORDER BY length(name) NULLS LAST, id LIMIT 20")
def search_entities(v: Views) -> DataFrame:
    return search.search_entities(v.typed("Organism", "id"), NAME_PART, "id", ["name", "id"], 20)


@query(f"""SELECT kind, id, label FROM (SELECT kind, id, label, row_number() OVER (PARTITION BY kind ORDER BY length(label) NULLS LAST, id) AS rn FROM labels
WHERE kind NOT IN ('Paper', 'Author', 'Category') AND (contains(lower(label), '{NAME_PART}') OR contains(lower(id), '{NAME_PART}'))) WHERE rn <= 5""")
def search_all_entities(v: Views) -> DataFrame:
    q = F.lit(NAME_PART)
    hit = F.coalesce(F.contains(F.lower("label"), q), F.lit(False)) | F.contains(F.lower("id"), q)
    from pyspark.sql.window import Window

    w = Window.partitionBy("kind").orderBy(F.length("label").asc_nulls_last(), "id")
    return v.labels.where(~F.col("kind").isin("Paper", "Author", "Category") & hit).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("kind", "id", "label")


# ranked lists and counts


@query("SELECT id, title, citation_count FROM all_paper WHERE citation_count IS NOT NULL ORDER BY citation_count DESC, id LIMIT 10")
def most_cited(v: Views) -> DataFrame:
    return v.all_paper.where("citation_count is not null").select("id", "title", "citation_count").orderBy(F.desc("citation_count"), "id").limit(10)


@query(f"SELECT id, title, citation_count FROM all_paper WHERE citation_count IS NOT NULL AND list_contains(categories, '{CATEGORY}') ORDER BY citation_count DESC, id LIMIT 10")
def most_cited_in_category(v: Views) -> DataFrame:
    return v.all_paper.where(F.col("citation_count").isNotNull() & F.array_contains("categories", CATEGORY)).select("id", "title", "citation_count").orderBy(F.desc("citation_count"), "id").limit(10)


@query("SELECT count(*) AS n_papers FROM all_paper WHERE NOT is_stub")
def paper_count(v: Views) -> DataFrame:
    return v.all_paper.where("not is_stub").agg(F.count(F.lit(1)).alias("n_papers"))


_COUNTS = "SELECT count(*) AS papers, count(citation_count) AS enriched, count(*) FILTER (embedded) AS embedded, min(published_date) AS earliest, max(published_date) AS latest FROM all_paper WHERE NOT is_stub"


@query(_COUNTS)
def paper_counts(v: Views) -> DataFrame:
    return v.all_paper.where("not is_stub").agg(F.count(F.lit(1)).alias("papers"), F.count("citation_count").alias("enriched"), F.count_if("embedded").alias("embedded"), F.min("published_date").alias("earliest"), F.max("published_date").alias("latest"))


@query(f"""SELECT *, round(papers * 1.0 / nullif(papers + stubs, 0), 6) AS full_share, round(enriched * 1.0 / nullif(papers, 0), 6) AS enriched_share, round(embedded * 1.0 / nullif(papers, 0), 6) AS embedded_share FROM ({_COUNTS}),
(SELECT count(*) AS stubs FROM stub_paper), (SELECT count(DISTINCT author) AS authors FROM authored), (SELECT count(*) AS categories FROM category),
(SELECT count(*) AS n_cites FROM cites), (SELECT count(*) AS n_authored FROM authored), (SELECT count(*) AS n_in_category FROM in_category), (SELECT count(*) AS n_mentions FROM mention)""")
def stats_overview(v: Views) -> DataFrame:
    one = F.lit(True)
    out = paper_counts(v)
    for df in (
        v.stub_paper.agg(F.count(one).alias("stubs")), v.authored.agg(F.count_distinct("author").alias("authors")), v.category.agg(F.count(one).alias("categories")), v.cites.agg(F.count(one).alias("n_cites")),
        v.authored.agg(F.count(one).alias("n_authored")), v.in_category.agg(F.count(one).alias("n_in_category")), v.mention.agg(F.count(one).alias("n_mentions")),
    ):
        out = out.join(F.broadcast(df), one)  # one row each

    def share(a: str, *whole: str):
        return F.round(F.col(a) / F.nullif(sum((F.col(w) for w in whole), F.lit(0)), F.lit(0)), 6)

    return out.withColumns({"full_share": share("papers", "papers", "stubs"), "enriched_share": share("enriched", "papers"), "embedded_share": share("embedded", "papers")})


@query("""SELECT CASE WHEN source IN ('arxiv', 'kaggle') THEN 'arxiv' WHEN source IN ('pubmed', 'pubmed_baseline') THEN 'pubmed' ELSE source END AS family, count(*) AS papers, count(enriched_at) AS enriched
FROM all_paper WHERE NOT is_stub GROUP BY 1 ORDER BY 2 DESC""")
def source_breakdown(v: Views) -> DataFrame:
    """Enriched counts those stamped, found or not: the other meaning than in ``paper_counts``."""
    return v.all_paper.where("not is_stub").groupBy(text.source_family(F.col("source")).alias("family")).agg(F.count(F.lit(1)).alias("papers"), F.count("enriched_at").alias("enriched")).orderBy(F.desc("papers"))


@query("SELECT c.code, count(i.paper) AS paper_count FROM category c LEFT JOIN (SELECT i.* FROM in_category i JOIN paper p ON p.id = i.paper AND p.published_date >= DATE '2020-01-01') i ON i.code = c.code GROUP BY 1")
def category_counts(v: Views) -> DataFrame:
    recent = v.in_category.join(v.paper.where("published_date >= date'2020-01-01'").select(F.col("id").alias("paper")), "paper")
    return v.category.join(recent, "code", "left").groupBy("code").agg(F.count("paper").alias("paper_count"))


@query("SELECT code, count(*) AS paper_count FROM in_category GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top_category(v: Views) -> DataFrame:
    return v.in_category.groupBy("code").agg(F.count(F.lit(1)).alias("paper_count")).orderBy(F.desc("paper_count"), "code").limit(1)


@query("SELECT author, count(*) AS papers FROM authored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_authors(v: Views) -> DataFrame:
    return v.authored.groupBy("author").agg(F.count(F.lit(1)).alias("papers")).orderBy(F.desc("papers"), "author").limit(10)


def _dated(v: Views, newest: bool) -> DataFrame:
    """The papers are ranked and cut before authors are joined."""
    order = F.desc("published_date") if newest else F.asc("published_date")
    top = v.all_paper.where("published_date is not null").select("id", "title", "published_date").orderBy(order, "id").limit(10)
    names = F.array_join(F.array_sort(F.collect_list("author")), ", ")
    return top.join(v.authored, top.id == F.col("paper"), "left").groupBy("id", "title", "published_date").agg(names.alias("authors"))


def _dated_sql(way: str) -> str:
    return f"""SELECT t.id, t.title, t.published_date, coalesce(string_agg(a.author, ', ' ORDER BY a.author), '') AS authors
FROM (SELECT id, title, published_date FROM all_paper WHERE published_date IS NOT NULL ORDER BY published_date {way}, id LIMIT 10) t LEFT JOIN authored a ON a.paper = t.id GROUP BY 1, 2, 3"""


@query(_dated_sql("DESC"))
def latest_papers(v: Views) -> DataFrame:
    return _dated(v, True)


@query(_dated_sql("ASC"))
def oldest_papers(v: Views) -> DataFrame:
    return _dated(v, False)


# neighbours


@query(f"""SELECT b.dst AS gene_id, count(DISTINCT b.paper) AS n_papers FROM mention a JOIN mention b ON b.paper = a.paper
WHERE a.dst_type = 'Gene' AND b.dst_type = 'Gene' AND a.dst = '{GENE}' AND b.dst <> '{GENE}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def co_mentioned_genes(v: Views) -> DataFrame:
    return graph.shared_neighbours(v.typed_mention("Gene"), GENE, limit=10).select(F.col("dst").alias("gene_id"), F.col("n").alias("n_papers"))


@query(f"""SELECT b.dst AS gene_id, count(DISTINCT b.paper) AS n_papers FROM mention a JOIN mention b ON b.paper = a.paper
WHERE a.dst_type = 'Organism' AND b.dst_type = 'Gene' AND a.dst = '{ORGANISM}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def genes_for_organism(v: Views) -> DataFrame:
    papers = v.typed_mention("Organism").where(F.col("dst") == ORGANISM).select(F.col("src").alias("via"))
    hop = graph.two_hops(papers, v.typed_mention("Gene").select(F.col("src").alias("via"), "dst"), 15)
    return hop.select(F.col("dst").alias("gene_id"), F.col("n").alias("n_papers"))


@query(f"SELECT m.paper AS paper_id, count(DISTINCT p.gene) AS n_genes FROM participates p JOIN mention m ON m.dst_type = 'Gene' AND m.dst = p.gene WHERE p.pathway = (SELECT pathway FROM anchor_pathway) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def papers_for_pathway(v: Views) -> DataFrame:
    genes = v.participates.where(F.col("pathway") == v.anchor_pathway()).select(F.col("gene").alias("via"))
    hop = graph.two_hops(genes, v.typed_mention("Gene").select(F.col("dst").alias("via"), F.col("src").alias("dst")), 15)
    return hop.select(F.col("dst").alias("paper_id"), F.col("n").alias("n_genes"))


@query(f"SELECT m.paper AS paper_id, count(DISTINCT a.gene) AS n_genes FROM associated a JOIN mention m ON m.dst_type = 'Gene' AND m.dst = a.gene WHERE a.trait = '{TRAIT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def papers_for_trait(v: Views) -> DataFrame:
    genes = v.associated.where(F.col("trait") == TRAIT).select(F.col("gene").alias("via"))
    hop = graph.two_hops(genes, v.typed_mention("Gene").select(F.col("dst").alias("via"), F.col("src").alias("dst")), 15)
    return hop.select(F.col("dst").alias("paper_id"), F.col("n").alias("n_genes"))


@query("SELECT author FROM authored WHERE paper = (SELECT id FROM anchor)")
def paper_authors(v: Views) -> DataFrame:
    return v.authored.where(F.col("paper") == v.anchor_paper()).select("author")


@query("SELECT code FROM in_category WHERE paper = (SELECT id FROM anchor)")
def paper_categories(v: Views) -> DataFrame:
    return v.in_category.where(F.col("paper") == v.anchor_paper()).select("code")


@query("SELECT e.id AS gene_id, e.name FROM mention m JOIN entity e ON e.type = 'Gene' AND e.id = m.dst WHERE m.dst_type = 'Gene' AND m.paper = (SELECT id FROM anchor) ORDER BY name NULLS LAST, 1 LIMIT 25")
def paper_genes(v: Views) -> DataFrame:
    return graph.neighbours(v.typed_mention("Gene"), v.typed("Gene", "gene_id"), v.anchor_paper(), "src", "gene_id", ["gene_id", "name"], 25, [F.asc_nulls_last("name"), "gene_id"])


@query(f"SELECT p.gene AS gene_id, e.name, p.evidence_code FROM participates p LEFT JOIN entity e ON e.type = 'Gene' AND e.id = p.gene WHERE p.pathway = (SELECT pathway FROM anchor_pathway) ORDER BY e.name NULLS LAST, 1 LIMIT 25")
def pathway_genes(v: Views) -> DataFrame:
    hit = v.participates.where(F.col("pathway") == v.anchor_pathway()).withColumnRenamed("gene", "gene_id")
    return hit.join(v.typed("Gene", "gene_id"), "gene_id", "left").select("gene_id", "name", "evidence_code").orderBy(F.asc_nulls_last("name"), "gene_id").limit(25)


@query(f"SELECT p.compound AS compound_id, e.name, p.evidence_code FROM produces p JOIN entity e ON e.type = 'Compound' AND e.id = p.compound WHERE p.pathway = (SELECT pathway FROM anchor_pathway) ORDER BY e.name NULLS LAST, 1 LIMIT 25")
def pathway_compounds(v: Views) -> DataFrame:
    hit = v.produces.where(F.col("pathway") == v.anchor_pathway()).withColumnRenamed("compound", "compound_id")
    return hit.join(v.typed("Compound", "compound_id"), "compound_id").select("compound_id", "name", "evidence_code").orderBy(F.asc_nulls_last("name"), "compound_id").limit(25)


_PRODUCED = "(SELECT compound FROM produces GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT w.pathway_id, w.name FROM produces p JOIN pathway w ON w.pathway_id = p.pathway WHERE p.compound = {_PRODUCED} ORDER BY w.name NULLS LAST, 1 LIMIT 25")
def compound_pathways(v: Views) -> DataFrame:
    top = v.produces.groupBy("compound").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "compound").select("compound").first()
    edges = v.produces.select(F.col("pathway").alias("src"), F.col("compound").alias("dst"))
    return graph.neighbours(edges, v.pathway, top[0] if top else "", "dst", "pathway_id", ["pathway_id", "name"], 25, [F.asc_nulls_last("name"), "pathway_id"])


@query(f"SELECT w.pathway_id, w.name, p.evidence_code FROM participates p JOIN pathway w ON w.pathway_id = p.pathway WHERE p.gene = (SELECT gene FROM anchor_gene) ORDER BY 1 LIMIT 25")
def gene_pathways(v: Views) -> DataFrame:
    hit = v.participates.where(F.col("gene") == v.anchor_gene()).withColumnRenamed("pathway", "pathway_id")
    return hit.join(v.pathway, "pathway_id").select("pathway_id", "name", "evidence_code").orderBy("pathway_id").limit(25)


@query(f"SELECT trait AS trait_id FROM associated WHERE gene = '{GENE}' ORDER BY 1 LIMIT 25")
def gene_traits(v: Views) -> DataFrame:
    return v.associated.where(F.col("gene") == GENE).select(F.col("trait").alias("trait_id")).orderBy("trait_id").limit(25)


@query(f"SELECT gene AS gene_id FROM associated WHERE trait = '{TRAIT}' ORDER BY 1 LIMIT 25")
def trait_genes(v: Views) -> DataFrame:
    return v.associated.where(F.col("trait") == TRAIT).select(F.col("gene").alias("gene_id")).orderBy("gene_id").limit(25)


def _mentioning(v: Views, kind: str, anchor: str, limit: int) -> DataFrame:
    return graph.neighbours(v.typed_mention(kind), v.paper, anchor, "dst", "id", ["id", "title"], limit)


def _mentioning_sql(kind: str, anchor: str, limit: int) -> str:
    return f"SELECT p.id, p.title FROM mention m JOIN paper p ON p.id = m.paper WHERE m.dst_type = '{kind}' AND m.dst = '{anchor}' ORDER BY p.id LIMIT {limit}"


@query(_mentioning_sql("Gene", GENE, 25))
def gene_papers(v: Views) -> DataFrame:
    return _mentioning(v, "Gene", GENE, 25)


@query(_mentioning_sql("Compound", COMPOUND, 25))
def compound_papers(v: Views) -> DataFrame:
    return _mentioning(v, "Compound", COMPOUND, 25)


@query(_mentioning_sql("Organism", ORGANISM, 25))
def organism_papers(v: Views) -> DataFrame:
    return _mentioning(v, "Organism", ORGANISM, 25)


@query("SELECT DISTINCT p.id, p.title FROM cites c JOIN all_paper p ON p.id = c.dst WHERE c.src = (SELECT id FROM anchor) ORDER BY 1 LIMIT 50")
def references(v: Views) -> DataFrame:
    return graph.neighbours(v.cites, v.all_paper, v.anchor_paper(), "src", "id", ["id", "title"], 50)


@query("SELECT DISTINCT p.id, p.title FROM cites c JOIN all_paper p ON p.id = c.src WHERE c.dst = (SELECT id FROM anchor) ORDER BY 1 LIMIT 50")
def cited_by(v: Views) -> DataFrame:
    return graph.neighbours(v.cites, v.all_paper, v.anchor_paper(), "dst", "id", ["id", "title"], 50)


def _trail_sql(depth: int) -> str:
    """Trails spelled out: every edge at most once, told apart by its own pair."""
    return f""", both_ways AS (SELECT src AS a, dst AS b, src || '>' || dst AS e FROM cites UNION SELECT dst, src, src || '>' || dst FROM cites
), trail AS (
  SELECT b AS at, [e] AS used FROM both_ways WHERE a = (SELECT id FROM anchor)
  UNION ALL SELECT w.b, list_append(t.used, w.e) FROM trail t JOIN both_ways w ON w.a = t.at WHERE len(t.used) < {depth} AND NOT list_contains(t.used, w.e)
) SELECT DISTINCT at_ AS id FROM (SELECT at AS at_ FROM trail)""".replace("b AS at,", "b AS node,").replace("t.at ", "t.node ").replace("SELECT at AS at_", "SELECT node AS at_")


@query(_trail_sql(1))
def neighborhood_d1(v: Views) -> DataFrame:
    return graph.neighbourhood(v.cites, v.anchor_paper(), 1)


@query(_trail_sql(2))
def neighborhood_d2(v: Views) -> DataFrame:
    return graph.neighbourhood(v.cites, v.anchor_paper(), 2)


@query(_trail_sql(3))
def neighborhood_d3(v: Views) -> DataFrame:
    return graph.neighbourhood(v.cites, v.anchor_paper(), 3)


_INCIDENT = f"""(SELECT rel, dst_kind AS other_kind, dst AS other FROM all_edges WHERE src_kind = 'Gene' AND src = (SELECT gene FROM anchor_gene)
UNION ALL SELECT rel, src_kind, src FROM all_edges WHERE dst_kind = 'Gene' AND dst = (SELECT gene FROM anchor_gene))"""


@query(f"SELECT rel, other_kind, other, label FROM {_INCIDENT} x LEFT JOIN labels l ON l.kind = x.other_kind AND l.id = x.other ORDER BY rel, other_kind, other LIMIT 60")
def generic_neighbours(v: Views) -> DataFrame:
    top = graph.incident(v.all_edges, "Gene", v.anchor_gene()).orderBy("rel", "other_kind", "other").limit(60)
    names = v.labels.select(F.col("kind").alias("other_kind"), F.col("id").alias("other"), "label")
    return top.join(names, ["other_kind", "other"], "left").select("rel", "other_kind", "other", "label")


@query(f"SELECT rel, other_kind, count(*) AS n FROM {_INCIDENT} x GROUP BY 1, 2")
def neighbour_groups(v: Views) -> DataFrame:
    return graph.incident(v.all_edges, "Gene", v.anchor_gene()).groupBy("rel", "other_kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT rel, src_kind, dst_kind FROM all_edges")
def edge_endpoints(v: Views) -> DataFrame:
    return v.all_edges.select("rel", "src_kind", "dst_kind").distinct()


@query("SELECT kind, count(*) AS n FROM labels GROUP BY 1")
def type_counts(v: Views) -> DataFrame:
    return v.labels.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rel, count(*) AS n FROM all_edges GROUP BY 1")
def edge_counts(v: Views) -> DataFrame:
    return v.all_edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


PULSE = ["Paper", "Author", "Category", "Gene", "Compound", "Organism", "Disease", "Pathway", "Trait"]


@query("SELECT kind, n, list_position(['Paper', 'Author', 'Category', 'Gene', 'Compound', 'Organism', 'Disease', 'Pathway', 'Trait'], kind) AS place FROM (SELECT kind, count(*) AS n FROM labels GROUP BY 1) ORDER BY place")
def pulse(v: Views) -> DataFrame:
    """Headline counts in fixed order; types without records don't show."""
    return type_counts(v).withColumn("place", F.array_position(F.array(*map(F.lit, PULSE)), F.col("kind")).cast("int")).orderBy("place")


@query("SELECT kind, count(*) AS n FROM labels GROUP BY 1 ORDER BY 2 DESC, 1")
def records_by_count(v: Views) -> DataFrame:
    return type_counts(v).orderBy(F.desc("n"), "kind")


@query("SELECT DISTINCT e.rel, e.src_kind, a.n AS src_records, e.dst_kind, b.n AS dst_records FROM all_edges e JOIN (SELECT kind, count(*) AS n FROM labels GROUP BY 1) a ON a.kind = e.src_kind JOIN (SELECT kind, count(*) AS n FROM labels GROUP BY 1) b ON b.kind = e.dst_kind")
def schema_graph(v: Views) -> DataFrame:
    """Types with records and the edges between them; exact, not from a sample."""
    n = type_counts(v)
    ends = edge_endpoints(v).join(n.select(F.col("kind").alias("src_kind"), F.col("n").alias("src_records")), "src_kind")
    return ends.join(n.select(F.col("kind").alias("dst_kind"), F.col("n").alias("dst_records")), "dst_kind").select("rel", "src_kind", "src_records", "dst_kind", "dst_records")


@query("""SELECT kind, name FROM (SELECT m.dst_type AS kind, e.name, row_number() OVER (PARTITION BY m.dst_type ORDER BY count(*) DESC, e.id) AS rn
FROM mention m JOIN entity e ON e.type = m.dst_type AND e.id = m.dst WHERE e.name IS NOT NULL GROUP BY m.dst_type, e.id, e.name) WHERE rn = 1""")
def suggestions(v: Views) -> DataFrame:
    counts = v.mention.groupBy(F.col("dst_type").alias("type"), F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(v.entity.where("name is not null"), ["type", "id"])
    return one_per_key(named, ["type"], F.desc("n"), F.asc("id")).select(F.col("type").alias("kind"), "name")


@query("SELECT dst_kind AS kind, other AS id, n FROM (SELECT dst_kind, dst AS other, count(*) AS n, row_number() OVER (PARTITION BY dst_kind ORDER BY count(*) DESC, dst) AS rn FROM all_edges GROUP BY 1, 2) WHERE rn = 1")
def suggestions_by_degree(v: Views) -> DataFrame:
    """The fallback: by edges coming in, over all edge types; outgoing ones don't count."""
    counts = v.all_edges.groupBy(F.col("dst_kind").alias("kind"), F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return one_per_key(counts, ["kind"], F.desc("n"), F.asc("id"))


_TEN = "(SELECT id FROM all_paper WHERE citation_count IS NOT NULL ORDER BY citation_count DESC, id LIMIT 10)"


@query(f"SELECT paper, gene FROM (SELECT m.paper, m.dst AS gene, row_number() OVER (PARTITION BY m.paper ORDER BY m.dst) AS rn FROM mention m WHERE m.dst_type = 'Gene' AND m.paper IN {_TEN}) WHERE rn <= 10")
def concept_graph(v: Views) -> DataFrame:
    from pyspark.sql.window import Window

    top = most_cited(v).select(F.col("id").alias("src"))
    rows = v.typed_mention("Gene").join(top, "src", "left_semi").withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("rn <= 10")
    return rows.select(F.col("src").alias("paper"), F.col("dst").alias("gene"))


@query(f""", e AS (SELECT src, dst FROM cites WHERE src IN {_TEN}), n AS (SELECT id FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) ORDER BY id LIMIT 40)
SELECT count(*) FILTER (src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) AS kept, count(*) FILTER (NOT (src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))) AS hidden FROM e""")
def result_graph(v: Views) -> DataFrame:
    top = most_cited(v).select("id", F.col("title").alias("label"))
    edges = v.cites.join(top.select(F.col("id").alias("src")), "src", "left_semi")
    inside = top.join(edges.select(F.col("src").alias("id")), "id", "left_semi")
    return graph.result_graph(inside, edges, 40)[2]


@query(f"""SELECT DISTINCT m.paper, m.dst AS gene, p.pathway, r.compound FROM mention m JOIN participates p ON p.gene = m.dst LEFT JOIN produces r ON r.pathway = p.pathway
WHERE m.dst_type = 'Gene' AND p.pathway = (SELECT pathway FROM anchor_pathway)""")
def documented_paths(v: Views) -> DataFrame:
    inside = v.participates.where(F.col("pathway") == v.anchor_pathway()).select("gene", "pathway")
    made = v.produces.where(F.col("pathway") == v.anchor_pathway()).select("pathway", "compound")
    return v.typed_mention("Gene").withColumnRenamed("dst", "gene").join(inside, "gene").join(made, "pathway", "left").select(F.col("src").alias("paper"), "gene", "pathway", "compound").distinct()


# hierarchy and crosswalks

_MAPPED = "SELECT disease_id AS id, doid AS key FROM disease WHERE doid IS NOT NULL"


@query(f""", mapped AS ({_MAPPED}), up AS (
  SELECT child AS id, parent AS node FROM is_a UNION SELECT u.id, i.parent FROM up u JOIN is_a i ON i.child = u.node WHERE u.node NOT IN (SELECT id FROM mapped)
) SELECT DISTINCT u.id, u.node AS ancestor FROM up u WHERE u.node IN (SELECT id FROM mapped)""")
def nearest_ancestors(v: Views) -> DataFrame:
    return graph.nearest_mapped_ancestors(v.is_a, v.disease.where("doid is not null").select(F.col("disease_id").alias("id")))


@query(f""", mapped AS ({_MAPPED}), up AS (
  SELECT child AS id, parent AS node FROM is_a UNION SELECT u.id, i.parent FROM up u JOIN is_a i ON i.child = u.node WHERE u.node NOT IN (SELECT id FROM mapped)
) SELECT DISTINCT a.key AS src, b.key AS dst FROM up u JOIN mapped b ON b.id = u.node JOIN mapped a ON a.id = u.id WHERE a.key <> b.key""")
def is_a_edges(v: Views) -> DataFrame:
    return graph.project_is_a(v.is_a, v.disease.where("doid is not null").select(F.col("disease_id").alias("id"), F.col("doid").alias("key")))


@query("""SELECT 'mesh:' || ui AS mesh, doid, name FROM (SELECT ui, doid, name, row_number() OVER (PARTITION BY ui ORDER BY doid, name) AS rn FROM
(SELECT upper(substring(lower(regexp_replace(disease_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), 6)) AS ui, doid, name FROM diseases) WHERE doid IS NOT NULL AND ui IS NOT NULL AND name <> '') WHERE rn = 1""")
def disease_xrefs(v: Views) -> DataFrame:
    """Diseases with a DOID as ontology terms that refer to their MeSH id: the smallest DOID, as text, of each id, with its name."""
    from papyra.operators.crosswalk import disease_xrefs as smallest
    from papyra.operators.references import plain_key

    ui = F.upper(F.substr(plain_key(F.col("disease_id")), F.lit(6)))
    terms = v.raw("diseases").where("doid is not null").select(F.col("doid").alias("id"), "name", F.lit(False).alias("is_obsolete"), F.array(F.concat(F.lit("MESH:"), ui)).alias("xrefs"))
    return smallest(terms)


@query("SELECT gene, pathway, evidence_code FROM participates")
def best_evidence(v: Views) -> DataFrame:
    return v.participates


@query("SELECT count(*) AS rows_considered, CAST(0 AS BIGINT) AS dropped_unresolved, count(*) - count(DISTINCT (gene, pathway)) AS dropped_duplicate FROM membership")
def evidence_accounting_participates(v: Views) -> DataFrame:
    return evidence_accounting(v.membership, ["gene", "pathway"])


@query("SELECT count(*) AS rows_considered, count(*) FILTER (c.mesh IS NULL) AS dropped_unresolved, count(c.mesh) - count(DISTINCT (r.pathway, c.mesh)) FILTER (c.mesh IS NOT NULL) AS dropped_duplicate FROM produced_rows r LEFT JOIN crosswalk c ON c.accession = r.accession")
def evidence_accounting_produces(v: Views) -> DataFrame:
    return evidence_accounting(v.produced_rows.join(v.crosswalk, "accession", "left"), ["pathway", "mesh"], "mesh")


@query("SELECT accession, mesh FROM crosswalk")
def crosswalk(v: Views) -> DataFrame:
    return v.crosswalk


@query("SELECT pathway, compound, evidence_code FROM produces")
def produces(v: Views) -> DataFrame:
    return v.produces


@query("SELECT name AS tag, id AS gene_id FROM (SELECT name, entity_id AS id, row_number() OVER (PARTITION BY name ORDER BY extracted_at DESC, mention_id DESC) AS rn FROM entity_mentions WHERE vertex_type = 'Gene' AND entity_id IS NOT NULL AND name IS NOT NULL AND name NOT IN ('', '-')) WHERE rn = 1", views=False)
def locus_crosswalk(v: Views) -> DataFrame:
    from papyra.operators.crosswalk import tag_crosswalk

    rows = v.raw("entity_mentions").where("vertex_type = 'Gene'")
    return tag_crosswalk(rows, "name", "entity_id", [F.desc("extracted_at"), F.desc("mention_id")]).select("tag", F.col("id").alias("gene_id"))


# keyword and vector search

_TOKENS = r"""docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS n, w, source IS DISTINCT FROM 'kaggle' AS keep FROM docs JOIN documents USING (doc_id) WHERE len(w) > 0)"""


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(terms)))
    hit = " + ".join(f"CAST(tf{i} > 0 AS INT)" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (total - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * n / mean))" for i in range(len(terms)))
    return f"""WITH {_TOKENS}, t AS (SELECT doc_id, n, keep, {tf} FROM d), f AS (SELECT CAST(count(*) AS DOUBLE) AS total, avg(n) AS mean, max({hit}) FILTER (keep) AS most, {df} FROM t)
SELECT doc_id, round({score}, 6) AS score FROM t, f WHERE keep AND {hit} >= CASE WHEN most = {len(terms)} THEN {len(terms)} ELSE 1 END AND {hit} > 0 ORDER BY score DESC, doc_id LIMIT 10"""


def _keyword(v: Views, query_text: str) -> DataFrame:
    return search.keyword_search(v.raw("documents"), query_text, "doc_id", F.col("text"), ~F.col("source").eqNullSafe("kaggle"))


@query(_bm25_sql(["expression", "cell", "lines"]), views=False)
def keyword_and(v: Views) -> DataFrame:
    return _keyword(v, "+expression +(cell lines)")


@query(_bm25_sql(["expression", "исследовали", "nosuchword"]), views=False)
def keyword_or_fallback(v: Views) -> DataFrame:
    return _keyword(v, "expression исследовали nosuchword")


_COSINE = "SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings"


def _query_vector(v: Views) -> list[float]:
    return v.raw("embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT vec_id, similarity FROM ({_COSINE}) WHERE label <> 2 ORDER BY similarity DESC, vec_id LIMIT 10", views=False)
def semantic_topk(v: Views) -> DataFrame:
    return search.semantic_search(v.raw("embeddings"), _query_vector(v), "vec_id", "embedding", 10, F.col("label") != 2, filter_first=True)


@query(f"SELECT vec_id, similarity FROM (SELECT * FROM ({_COSINE}) ORDER BY similarity DESC, vec_id LIMIT 10) WHERE label <> 2", views=False)
def semantic_topk_poststub(v: Views) -> DataFrame:
    return search.semantic_search(v.raw("embeddings"), _query_vector(v), "vec_id", "embedding", 10, F.col("label") != 2)


# pages: (section, rank, id, label)


def _section(df: DataFrame, section: str, key: str, label: str, limit: int) -> DataFrame:
    from pyspark.sql.window import Window

    top = df.select(F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("label")).orderBy("id").limit(limit)
    return top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy("id")).cast("long").alias("rank"), "id", "label")


def _section_sql(section: str, body: str, limit: int) -> str:
    return f"SELECT '{section}' AS section, row_number() OVER (ORDER BY id) AS rank, id, label FROM (SELECT id, label FROM ({body}) ORDER BY id LIMIT {limit})"


def _page(*sections: DataFrame) -> DataFrame:
    out = sections[0]
    for x in sections[1:]:
        out = out.unionByName(x)
    return out


@query(" UNION ALL ".join([
    _section_sql("record", "SELECT id, title AS label FROM paper WHERE id = (SELECT id FROM anchor)", 1), _section_sql("authors", "SELECT author AS id, author AS label FROM authored WHERE paper = (SELECT id FROM anchor)", 100),
    _section_sql("genes", "SELECT e.id, e.name AS label FROM mention m JOIN entity e ON e.type = 'Gene' AND e.id = m.dst WHERE m.dst_type = 'Gene' AND m.paper = (SELECT id FROM anchor)", 25),
    _section_sql("categories", "SELECT code AS id, code AS label FROM in_category WHERE paper = (SELECT id FROM anchor)", 100),
    _section_sql("references", "SELECT p.id, p.title AS label FROM cites c JOIN all_paper p ON p.id = c.dst WHERE c.src = (SELECT id FROM anchor)", 10),
    _section_sql("cited_by", "SELECT p.id, p.title AS label FROM cites c JOIN all_paper p ON p.id = c.src WHERE c.dst = (SELECT id FROM anchor)", 10),
]))
def page_paper(v: Views) -> DataFrame:
    at = v.anchor_paper()
    return _page(
        _section(v.paper.where(F.col("id") == at), "record", "id", "title", 1), _section(v.authored.where(F.col("paper") == at), "authors", "author", "author", 100),
        _section(graph.neighbours(v.typed_mention("Gene"), v.typed("Gene", "id"), at, "src", "id", ["id", "name"]), "genes", "id", "name", 25), _section(v.in_category.where(F.col("paper") == at), "categories", "code", "code", 100),
        _section(graph.neighbours(v.cites, v.all_paper, at, "src", "id", ["id", "title"]), "references", "id", "title", 10), _section(graph.neighbours(v.cites, v.all_paper, at, "dst", "id", ["id", "title"]), "cited_by", "id", "title", 10),
    )


@query(" UNION ALL ".join([
    _section_sql("record", f"SELECT id, name AS label FROM entity WHERE type = 'Gene' AND id = '{GENE}'", 1),
    _section_sql("papers", f"SELECT p.id, p.title AS label FROM mention m JOIN paper p ON p.id = m.paper WHERE m.dst_type = 'Gene' AND m.dst = '{GENE}'", 25),
    _section_sql("pathways", f"SELECT w.pathway_id AS id, w.name AS label FROM participates p JOIN pathway w ON w.pathway_id = p.pathway WHERE p.gene = '{GENE}'", 25),
    _section_sql("traits", f"SELECT trait AS id, trait AS label FROM associated WHERE gene = '{GENE}'", 25),
    _section_sql("co_mentioned", f"SELECT b.dst AS id, CAST(count(DISTINCT b.paper) AS VARCHAR) AS label FROM mention a JOIN mention b ON b.paper = a.paper WHERE a.dst_type = 'Gene' AND b.dst_type = 'Gene' AND a.dst = '{GENE}' AND b.dst <> '{GENE}' GROUP BY 1 ORDER BY count(DISTINCT b.paper) DESC, 1 LIMIT 10", 10),
]))
def page_gene(v: Views) -> DataFrame:
    pathways = v.participates.select(F.col("gene").alias("src"), F.col("pathway").alias("dst"))
    return _page(
        _section(v.typed("Gene", "id").where(F.col("id") == GENE), "record", "id", "name", 1), _section(_mentioning(v, "Gene", GENE, 25), "papers", "id", "title", 25),
        _section(graph.neighbours(pathways, v.pathway, GENE, "src", "pathway_id", ["pathway_id", "name"]), "pathways", "pathway_id", "name", 25), _section(gene_traits(v), "traits", "trait_id", "trait_id", 25),
        _section(co_mentioned_genes(v), "co_mentioned", "gene_id", "n_papers", 10),
    )


@query(" UNION ALL ".join([
    _section_sql("record", f"SELECT pathway_id AS id, name AS label FROM pathway WHERE pathway_id = (SELECT pathway FROM anchor_pathway)", 1), _section_sql("genes", f"SELECT gene AS id, evidence_code AS label FROM participates WHERE pathway = (SELECT pathway FROM anchor_pathway)", 25),
    _section_sql("compounds", f"SELECT compound AS id, evidence_code AS label FROM produces WHERE pathway = (SELECT pathway FROM anchor_pathway)", 15),
    _section_sql("papers", f"SELECT m.paper AS id, CAST(count(DISTINCT p.gene) AS VARCHAR) AS label FROM participates p JOIN mention m ON m.dst_type = 'Gene' AND m.dst = p.gene WHERE p.pathway = (SELECT pathway FROM anchor_pathway) GROUP BY 1 ORDER BY count(DISTINCT p.gene) DESC, 1 LIMIT 15", 15),
]))
def page_pathway(v: Views) -> DataFrame:
    return _page(
        _section(v.pathway.where(F.col("pathway_id") == v.anchor_pathway()), "record", "pathway_id", "name", 1), _section(v.participates.where(F.col("pathway") == v.anchor_pathway()), "genes", "gene", "evidence_code", 25),
        _section(v.produces.where(F.col("pathway") == v.anchor_pathway()), "compounds", "compound", "evidence_code", 15), _section(papers_for_pathway(v), "papers", "paper_id", "n_genes", 15),
    )


@query(" UNION ALL ".join([
    _section_sql("trait_genes", f"SELECT gene AS id, gene AS label FROM associated WHERE trait = '{TRAIT}'", 25), _section_sql("compound_papers", f"SELECT p.id, p.title AS label FROM mention m JOIN paper p ON p.id = m.paper WHERE m.dst_type = 'Compound' AND m.dst = '{COMPOUND}'", 25),
    _section_sql("organism_papers", f"SELECT p.id, p.title AS label FROM mention m JOIN paper p ON p.id = m.paper WHERE m.dst_type = 'Organism' AND m.dst = '{ORGANISM}'", 25),
    _section_sql("neighbours", f"SELECT other AS id, rel AS label FROM {_INCIDENT}", 60),
]))
def page_entity(v: Views) -> DataFrame:
    return _page(
        _section(v.associated.where(F.col("trait") == TRAIT), "trait_genes", "gene", "gene", 25), _section(_mentioning(v, "Compound", COMPOUND, 25), "compound_papers", "id", "title", 25),
        _section(_mentioning(v, "Organism", ORGANISM, 25), "organism_papers", "id", "title", 25), _section(graph.incident(v.all_edges, "Gene", v.anchor_gene()), "neighbours", "other", "rel", 60),
    )


@query("SELECT 'papers' AS what, CAST(count(*) AS VARCHAR) AS value FROM paper UNION ALL SELECT 'top_category', (SELECT code FROM in_category GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) UNION ALL SELECT 'source ' || source, CAST(count(*) AS VARCHAR) FROM paper WHERE source IS NOT NULL GROUP BY source")
def overview_panel(v: Views) -> DataFrame:
    total = v.paper.agg(F.lit("papers").alias("what"), F.count(F.lit(1)).cast("string").alias("value"))
    by = v.paper.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit("source "), "source").alias("what"), "value")
    return total.unionByName(top_category(v).select(F.lit("top_category").alias("what"), F.col("code").alias("value"))).unionByName(by)


@query("SELECT kind, count(*) AS n FROM labels WHERE kind IN ('Gene', 'Compound', 'Organism', 'Disease', 'Pathway') GROUP BY 1 HAVING count(*) > 0")
def searchable_types(v: Views) -> DataFrame:
    """Types with records that the registry knows to have a name."""
    from papyra.registry import DEFAULT

    counts = {r.kind: r.n for r in type_counts(v).collect()}  # one row a type
    kinds = DEFAULT.searchable(counts)
    return v.spark.createDataFrame([(k, counts[k]) for k in kinds], "kind string, n long")


@query("SELECT rel, string_agg(DISTINCT src_kind || '>' || dst_kind, ',' ORDER BY src_kind || '>' || dst_kind) AS ends FROM all_edges GROUP BY 1")
def cached_endpoints(v: Views) -> DataFrame:
    """The end points of every edge type as one cached row each."""
    ends = F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "src_kind", "dst_kind"))), ",")  # bounded by the pairs of types
    return v.all_edges.groupBy("rel").agg(ends.alias("ends"))
