"""The graph's node and edge tables, as lazy views over the delivered tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papyra.functions.text import PAPER_IDENTIFIERS
from papyra.operators.crosswalk import compound_crosswalk
from papyra.operators.dedupe import best_evidence, one_per_key
from papyra.operators.references import plain_identifier, plain_key
from papyra.session import table


def accession(key: Column) -> Column:
    """The accession that stands for a compound's: the number at the end of its key."""
    return F.concat(F.lit("CHEBI:"), F.regexp_extract(key, r"([0-9]+)$", 1))


class Views:
    """Each attribute is a view; nothing is read before it is used, and only the columns that a query needs."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    @property
    def paper(self) -> DataFrame:
        """The latest delivery of every paper."""
        return one_per_key(self.raw("papers"), ["id"], F.desc_nulls_last("fetched_at"), *[F.coalesce(c, F.lit("")) for c in ("title", "abstract", "source")])

    @property
    def stub(self) -> DataFrame:
        """Citation stubs with clean identifiers and their canonical id."""
        ids = {ns: plain_identifier(F.lit(ns), F.try_element_at("identifiers", F.lit(ns))) for ns in PAPER_IDENTIFIERS}
        return self.raw("citation_stubs").select("stub_id", "paper_id", "direction", "title", "enriched_at", *[c.alias(ns) for ns, c in ids.items()]).withColumn("sid", F.coalesce(*[F.concat(F.lit(f"{ns}:"), F.col(ns)) for ns in PAPER_IDENTIFIERS]))

    @property
    def cites(self) -> DataFrame:
        out = F.col("direction") == "references"
        ends = F.when(out, F.col("paper_id")).otherwise(F.col("sid")).alias("src"), F.when(out, F.col("sid")).otherwise(F.col("paper_id")).alias("dst")
        return self.stub.where("paper_id is not null and sid is not null").select(*ends).distinct()

    @property
    def enrichment(self) -> DataFrame:
        """Per enriched paper: when, and how many references and citations were reported."""
        s = self.raw("citation_stubs").where("paper_id is not null")
        return s.groupBy(F.col("paper_id").alias("id")).agg(F.max("enriched_at").alias("enriched_at"), F.count_if(F.col("direction") == "references").alias("reference_count"), F.count_if(F.col("direction") == "citations").alias("citation_count"))

    @property
    def stub_paper(self) -> DataFrame:
        """Papers only known from stubs; the title is that of the first stub that has one."""
        new = self.stub.where("sid is not null").groupBy(F.col("sid").alias("id")).agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("stub_id"))).alias("title"), F.min("arxiv").alias("arxiv_id"), F.min("pmid").alias("pmid"), F.min("s2").alias("s2_paper_id"))
        return new.join(self.raw("papers").select("id"), "id", "left_anti")

    @property
    def all_paper(self) -> DataFrame:
        """Full papers with their enrichment, and stubs."""
        cols = ["id", "arxiv_id", "pmid", "s2_paper_id", "title", "abstract", "primary_category", "categories", "published_date", "source", F.lit(False).alias("is_stub"), F.col("embedding").isNotNull().alias("embedded")]
        full = self.paper.select(*cols).join(self.enrichment, "id", "left")
        return full.unionByName(self.stub_paper.withColumn("is_stub", F.lit(True)).withColumn("embedded", F.lit(False)), allowMissingColumns=True)

    @property
    def authored(self) -> DataFrame:
        return self.paper.select(F.explode("authors").alias("author"), F.col("id").alias("paper")).where("author is not null and author != ''").distinct()

    @property
    def in_category(self) -> DataFrame:
        return self.paper.select(F.col("id").alias("paper"), F.explode("categories").alias("code")).where("code is not null").distinct()

    @property
    def category(self) -> DataFrame:
        return self.in_category.select("code").distinct()

    @property
    def mention(self) -> DataFrame:
        """MENTIONS edges of known papers; the first writer's source."""
        rows = one_per_key(self.raw("entity_mentions").where("paper_id is not null and entity_id is not null"), ["paper_id", "vertex_type", "entity_id"], F.asc("extracted_at"), F.asc("mention_id"))
        return rows.select(F.col("paper_id").alias("paper"), F.col("vertex_type").alias("dst_type"), F.col("entity_id").alias("dst"), "source").join(self.raw("papers").select(F.col("id").alias("paper")), "paper", "left_semi")

    @property
    def entity(self) -> DataFrame:
        """Nodes of the four mentioned types, named by their first named mention."""
        order = F.when(F.col("name").isNotNull(), F.struct("extracted_at", "mention_id"))
        return self.raw("entity_mentions").where("entity_id is not null").groupBy(F.col("vertex_type").alias("type"), F.col("entity_id").alias("id")).agg(F.min_by("name", order).alias("name"))

    def typed(self, kind: str, key: str) -> DataFrame:
        return self.entity.where(F.col("type") == kind).select(F.col("id").alias(key), "name")

    def typed_mention(self, kind: str) -> DataFrame:
        """MENTIONS edges of one type without their source: no ranking needed, only distinct pairs."""
        pairs = self.raw("entity_mentions").where((F.col("vertex_type") == kind) & F.col("paper_id").isNotNull() & F.col("entity_id").isNotNull()).select(F.col("paper_id").alias("src"), F.col("entity_id").alias("dst"))
        return pairs.distinct().join(self.raw("papers").select(F.col("id").alias("src")), "src", "left_semi")

    @property
    def pathway(self) -> DataFrame:
        rows = self.raw("pathways").withColumn("pathway_id", F.upper(plain_key(F.col("pathway_id"))))
        return one_per_key(rows.where("pathway_id is not null"), ["pathway_id"], F.desc_nulls_last("loaded_at"), F.asc_nulls_last("name")).select("pathway_id", "name", "source_db")

    @property
    def membership(self) -> DataFrame:
        """Delivered gene-pathway rows with clean ids."""
        ids = plain_key(F.col("gene_id")).alias("gene"), F.upper(plain_key(F.col("pathway_id"))).alias("pathway")
        return self.raw("participates_in").select("row_id", *ids, "evidence_code", "loaded_at").where("gene is not null and pathway is not null")

    @property
    def participates(self) -> DataFrame:
        return best_evidence(self.membership, ["gene", "pathway"], "evidence_code", "row_id").select("gene", "pathway", "evidence_code")

    @property
    def crosswalk(self) -> DataFrame:
        """Compound accession to MeSH key. The accession is the whole number in the key; names stand for registry numbers, keys under a name for headings; pairs of manual mentions are the curated ones."""
        ids = self.raw("entity_mentions").where("vertex_type = 'Compound' and entity_id is not null").select("entity_id", accession(F.col("entity_id")).alias("accession"), F.substr("entity_id", F.lit(6)).alias("ui"), F.lower("name").alias("cas"), "source")
        named = ids.where("cas is not null").select(F.col("entity_id").alias("compound_id"), "cas", "ui").distinct()
        return compound_crosswalk(ids.select(F.col("entity_id").alias("compound_id"), "accession").distinct(), named.select("compound_id", "cas"), named.select("cas", "ui"), ids.where("source = 'manual'").select("accession", "ui"))

    @property
    def produced_rows(self) -> DataFrame:
        """Delivered compound-pathway rows: the accession is that of the compound with the smallest key that a paper mentions together with the gene; null without one."""
        genes, compounds = self.typed_mention("Gene").withColumnRenamed("dst", "gene"), self.typed_mention("Compound").withColumnRenamed("dst", "compound")
        with_gene = genes.join(compounds, "src").groupBy("gene").agg(accession(F.min("compound")).alias("accession"))
        return self.membership.join(with_gene, "gene", "left").select("row_id", "accession", "pathway", "evidence_code")

    @property
    def produces(self) -> DataFrame:
        rows = self.produced_rows.join(self.crosswalk, "accession")
        return best_evidence(rows, ["pathway", "mesh"], "evidence_code", "row_id").select("pathway", F.col("mesh").alias("compound"), "evidence_code")

    @property
    def associated(self) -> DataFrame:
        """Gene-trait edges: genes and diseases mentioned in one paper."""
        g, t = self.typed_mention("Gene").select("src", F.col("dst").alias("gene")), self.typed_mention("Disease").select("src", F.col("dst").alias("trait"))
        return g.join(t, "src").select("gene", "trait").distinct()

    @property
    def disease(self) -> DataFrame:
        rows = self.raw("diseases").select(plain_key(F.col("disease_id")).alias("disease_id"), "name", "doid", "fetched_at").where("disease_id is not null")
        return one_per_key(rows, ["disease_id"], F.desc_nulls_last("fetched_at"), F.asc_nulls_last("name"), F.asc_nulls_last("doid"))

    @property
    def is_a(self) -> DataFrame:
        return self.raw("disease_is_a").select(plain_key(F.col("child_id")).alias("child"), plain_key(F.col("parent_id")).alias("parent")).where("child is not null and parent is not null").distinct()

    @property
    def all_edges(self) -> DataFrame:
        """Every edge of the graph as rel, src_kind, src, dst_kind, dst."""

        def as_rel(df: DataFrame, rel: str, a: str, src: str, b: str, dst: str) -> DataFrame:
            return df.select(F.lit(rel).alias("rel"), F.lit(a).alias("src_kind"), F.col(src).alias("src"), F.lit(b).alias("dst_kind"), F.col(dst).alias("dst"))

        out = self.mention.select(F.lit("MENTIONS").alias("rel"), F.lit("Paper").alias("src_kind"), F.col("paper").alias("src"), F.col("dst_type").alias("dst_kind"), "dst")
        for x in (
            as_rel(self.cites, "CITES", "Paper", "src", "Paper", "dst"), as_rel(self.authored, "AUTHORED", "Author", "author", "Paper", "paper"), as_rel(self.in_category, "IN_CATEGORY", "Paper", "paper", "Category", "code"),
            as_rel(self.participates, "PARTICIPATES_IN", "Gene", "gene", "Pathway", "pathway"), as_rel(self.produces, "PRODUCES", "Pathway", "pathway", "Compound", "compound"), as_rel(self.is_a, "IS_A", "Disease", "child", "Disease", "parent"),
        ):
            out = out.unionByName(x)
        return out

    @property
    def labels(self) -> DataFrame:
        """kind, id, label of every node."""

        def as_kind(df: DataFrame, kind: str, key: str, label: str) -> DataFrame:
            return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(label).alias("label"))

        out = self.entity.where("type != 'Disease'").select(F.col("type").alias("kind"), "id", F.col("name").alias("label"))
        for x in (as_kind(self.all_paper, "Paper", "id", "title"), as_kind(self.authored.select("author").distinct(), "Author", "author", "author"), as_kind(self.category, "Category", "code", "code"), as_kind(self.pathway, "Pathway", "pathway_id", "name"), as_kind(self.disease, "Disease", "disease_id", "name")):
            out = out.unionByName(x)
        return out

    def anchor_paper(self) -> str:
        """The paper with the most reported references and citations (ties: smallest id): one value, to anchor page queries."""
        row = self.enrichment.orderBy(F.desc(F.col("reference_count") + F.col("citation_count")), "id").select("id").first()
        return row[0] if row else ""

    def anchor_gene(self) -> str:
        """The mentioned gene of the most pathways (ties: smallest id)."""
        return self._busiest("gene")

    def anchor_pathway(self) -> str:
        """The pathway of the most mentioned genes (ties: smallest id)."""
        return self._busiest("pathway")

    def _busiest(self, end: str) -> str:
        mentioned = self.raw("entity_mentions").where("vertex_type = 'Gene'").select(F.col("entity_id").alias("gene"))
        row = self.participates.join(mentioned, "gene", "left_semi").groupBy(end).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), end).first()
        return row[0] if row else ""


def _plain(ns: str, c: str) -> str:
    bare = rf"regexp_replace(lower(regexp_replace({c}, '[\s\p{{Z}}]+', '', 'g')), '^[a-z][a-z0-9_.-]*:', '')"
    return f"nullif({f"regexp_replace({bare}, 'v[0-9]+$', '')" if ns == 'arxiv' else bare}, '')"


def _key(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"


_RANK = "CASE evidence_code WHEN 'TAS' THEN 0 WHEN 'IEA' THEN 1 ELSE 99 END"

#: The views in SQL, a prefix of the queries' SQL.
WITH_VIEWS = f"""WITH RECURSIVE paper AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, coalesce(title, ''), coalesce(abstract, ''), coalesce(source, '')) AS rn FROM papers) WHERE rn = 1
), stub AS (
  SELECT *, coalesce('arxiv:' || arxiv, 'pmid:' || pmid, 's2:' || s2) AS sid FROM (
    SELECT stub_id, paper_id, direction, title, enriched_at, {_plain('arxiv', "identifiers['arxiv']")} AS arxiv, {_plain('pmid', "identifiers['pmid']")} AS pmid, {_plain('s2', "identifiers['s2']")} AS s2 FROM citation_stubs)
), cites AS (
  SELECT DISTINCT CASE WHEN direction = 'references' THEN paper_id ELSE sid END AS src, CASE WHEN direction = 'references' THEN sid ELSE paper_id END AS dst
  FROM stub WHERE paper_id IS NOT NULL AND sid IS NOT NULL
), enrichment AS (
  SELECT paper_id AS id, max(enriched_at) AS enriched_at, count(*) FILTER (direction = 'references') AS reference_count, count(*) FILTER (direction = 'citations') AS citation_count
  FROM citation_stubs WHERE paper_id IS NOT NULL GROUP BY 1
), stub_paper AS (
  SELECT sid AS id, arg_min(title, stub_id) FILTER (title IS NOT NULL) AS title, min(arxiv) AS arxiv_id, min(pmid) AS pmid, min(s2) AS s2_paper_id FROM stub
  WHERE sid IS NOT NULL AND sid NOT IN (SELECT id FROM papers WHERE id IS NOT NULL) GROUP BY 1
), all_paper AS (
  SELECT p.id, p.arxiv_id, p.pmid, p.s2_paper_id, p.title, p.abstract, p.primary_category, p.categories, p.published_date, p.source, false AS is_stub, p.embedding IS NOT NULL AS embedded, e.enriched_at, e.reference_count, e.citation_count
  FROM paper p LEFT JOIN enrichment e ON e.id = p.id
  UNION ALL SELECT id, arxiv_id, pmid, s2_paper_id, title, NULL, NULL, NULL, NULL, NULL, true, false, NULL, NULL, NULL FROM stub_paper
), authored AS (
  SELECT DISTINCT author, paper FROM (SELECT unnest(authors) AS author, id AS paper FROM paper) WHERE author IS NOT NULL AND author <> ''
), in_category AS (
  SELECT DISTINCT paper, code FROM (SELECT id AS paper, unnest(categories) AS code FROM paper) WHERE code IS NOT NULL
), category AS (SELECT DISTINCT code FROM in_category
), mention AS (
  SELECT paper_id AS paper, vertex_type AS dst_type, entity_id AS dst, source FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id, vertex_type, entity_id ORDER BY extracted_at NULLS FIRST, mention_id) AS rn FROM entity_mentions WHERE paper_id IS NOT NULL AND entity_id IS NOT NULL)
  WHERE rn = 1 AND paper_id IN (SELECT id FROM papers)
), entity AS (
  SELECT vertex_type AS type, entity_id AS id, arg_min(name, (extracted_at, mention_id)) FILTER (name IS NOT NULL) AS name FROM entity_mentions WHERE entity_id IS NOT NULL GROUP BY 1, 2
), pathway AS (
  SELECT pathway_id, name, source_db FROM (SELECT upper({_key('pathway_id')}) AS pathway_id, name, source_db, row_number() OVER (PARTITION BY upper({_key('pathway_id')}) ORDER BY loaded_at DESC NULLS LAST, name NULLS LAST) AS rn FROM pathways)
  WHERE rn = 1 AND pathway_id IS NOT NULL
), membership AS (
  SELECT * FROM (SELECT row_id, {_key('gene_id')} AS gene, upper({_key('pathway_id')}) AS pathway, evidence_code, loaded_at FROM participates_in) WHERE gene IS NOT NULL AND pathway IS NOT NULL
), participates AS (
  SELECT gene, pathway, evidence_code FROM (SELECT *, row_number() OVER (PARTITION BY gene, pathway ORDER BY {_RANK}, row_id) AS rn FROM membership) WHERE rn = 1
), compound_name AS (
  SELECT DISTINCT 'CHEBI:' || regexp_extract(entity_id, '([0-9]+)$', 1) AS accession, substring(entity_id, 6) AS ui, lower(name) AS cas, source = 'manual' AS sure FROM entity_mentions WHERE vertex_type = 'Compound' AND entity_id IS NOT NULL
), bridge AS (
  SELECT a.accession, min(b.ui) AS ui FROM compound_name a JOIN compound_name b ON b.cas = a.cas GROUP BY 1 HAVING count(DISTINCT b.ui) = 1
), curated AS (SELECT accession, min(ui) AS ui FROM compound_name WHERE sure GROUP BY 1 HAVING count(DISTINCT ui) = 1
), crosswalk AS (SELECT coalesce(c.accession, b.accession) AS accession, 'mesh:' || coalesce(c.ui, b.ui) AS mesh FROM bridge b FULL JOIN curated c ON c.accession = b.accession
), produced_rows AS (
  SELECT m.row_id, g.accession, m.pathway, m.evidence_code FROM membership m LEFT JOIN (SELECT a.dst AS gene, 'CHEBI:' || regexp_extract(min(b.dst), '([0-9]+)$', 1) AS accession
    FROM mention a JOIN mention b ON b.paper = a.paper WHERE a.dst_type = 'Gene' AND b.dst_type = 'Compound' GROUP BY 1) g ON g.gene = m.gene
), produces AS (
  SELECT pathway, mesh AS compound, evidence_code FROM (
    SELECT r.*, c.mesh, row_number() OVER (PARTITION BY r.pathway, c.mesh ORDER BY {_RANK}, r.row_id) AS rn FROM produced_rows r JOIN crosswalk c ON c.accession = r.accession) WHERE rn = 1
), associated AS (
  SELECT DISTINCT g.dst AS gene, t.dst AS trait FROM mention g JOIN mention t ON t.paper = g.paper WHERE g.dst_type = 'Gene' AND t.dst_type = 'Disease'
), disease AS (
  SELECT disease_id, name, doid, fetched_at FROM (SELECT {_key('disease_id')} AS disease_id, name, doid, fetched_at,
    row_number() OVER (PARTITION BY {_key('disease_id')} ORDER BY fetched_at DESC NULLS LAST, name NULLS LAST, doid NULLS LAST) AS rn FROM diseases) WHERE rn = 1 AND disease_id IS NOT NULL
), is_a AS (
  SELECT DISTINCT child, parent FROM (SELECT {_key('child_id')} AS child, {_key('parent_id')} AS parent FROM disease_is_a) WHERE child IS NOT NULL AND parent IS NOT NULL
), all_edges AS (
  SELECT 'MENTIONS' AS rel, 'Paper' AS src_kind, paper AS src, dst_type AS dst_kind, dst FROM mention
  UNION ALL SELECT 'CITES', 'Paper', src, 'Paper', dst FROM cites
  UNION ALL SELECT 'AUTHORED', 'Author', author, 'Paper', paper FROM authored
  UNION ALL SELECT 'IN_CATEGORY', 'Paper', paper, 'Category', code FROM in_category
  UNION ALL SELECT 'PARTICIPATES_IN', 'Gene', gene, 'Pathway', pathway FROM participates
  UNION ALL SELECT 'PRODUCES', 'Pathway', pathway, 'Compound', compound FROM produces
  UNION ALL SELECT 'IS_A', 'Disease', child, 'Disease', parent FROM is_a
), labels AS (
  SELECT type AS kind, id, name AS label FROM entity WHERE type <> 'Disease'
  UNION ALL SELECT 'Paper', id, title FROM all_paper
  UNION ALL SELECT DISTINCT 'Author', author, author FROM authored
  UNION ALL SELECT 'Category', code, code FROM category
  UNION ALL SELECT 'Pathway', pathway_id, name FROM pathway
  UNION ALL SELECT 'Disease', disease_id, name FROM disease
), anchor AS (
  SELECT id FROM enrichment ORDER BY reference_count + citation_count DESC, id LIMIT 1
), anchor_gene AS (
  SELECT gene FROM participates WHERE gene IN (SELECT entity_id FROM entity_mentions WHERE vertex_type = 'Gene') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), anchor_pathway AS (
  SELECT pathway FROM participates WHERE gene IN (SELECT entity_id FROM entity_mentions WHERE vertex_type = 'Gene') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
)
"""
