"""Queries of the data problems p1, p2 and p4, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papyra.operators.hierarchy import descendants, extra_parents, hierarchy, label_trees
from papyra.operators.references import literature_orphans, monthly_report, outer_trimmed
from papyra.operators.skew import key_statistics
from papyra.session import Cut, table

#: Keys with at least this share of their table's rows are reported as hot.
HOT_SHARE = 0.02


def _keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").select(F.lit("papers").alias("source_table"), F.col("primary_category").alias("key_value"), F.col("id").alias("paper"), F.col("fetched_at").alias("at"))
    mentions = table(spark, d, "entity_mentions").select(F.lit("entity_mentions").alias("source_table"), F.col("entity_id").alias("key_value"), F.col("paper_id").alias("paper"), F.col("extracted_at").alias("at"))
    return papers.unionByName(mentions)


def p1_key_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = key_statistics(_keyed_rows(spark, d), ["source_table", "key_value"], "paper", "at")
    return stats.where("key_value is not null").select("source_table", "key_value", F.col("n_rows"), F.col("n_distinct").alias("n_papers"), "first_at", "last_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    stats = key_statistics(_keyed_rows(spark, d), ["source_table", "key_value"], "paper", "at")
    total = stats.groupBy("source_table").agg(F.sum("n_rows").alias("total"))
    hot = stats.where("key_value is not null").join(F.broadcast(total), "source_table").where(F.col("n_rows") >= F.col("total") * F.lit(HOT_SHARE))
    return hot.select("source_table", "key_value")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return literature_orphans(*[table(spark, d, t) for t in ("citation_stubs", "disease_is_a", "participates_in", "papers", "diseases", "pathways", "removals")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("source_table", "row_id").distinct()


def p2_monthly(spark: SparkSession, d: str) -> DataFrame:
    return monthly_report(_orphans(spark, d))


def mesh_key(c: Column) -> Column:
    """A disease id apart from outer white space and letter case, as ``mesh:`` and the rest in upper case."""
    return F.concat(F.lit("mesh:"), F.upper(F.regexp_replace(outer_trimmed(c), r"^(?i)mesh:", "")))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "disease_is_a").select(mesh_key(F.col("child_id")).alias("child_id"), mesh_key(F.col("parent_id")).alias("parent_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return label_trees(spark, _links(spark, d)).where("on_cycle").select(F.col("id").alias("disease_id"), "cycle_id")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(spark, _links(spark, d))
    return tree.select(F.col("id").alias("disease_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"), "n_descendants", "cycle_id", "on_cycle")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(Cut(spark, "trees")(label_trees(spark, _links(spark, d))))


def p4_extra_parents(spark: SparkSession, d: str) -> DataFrame:
    return extra_parents(_links(spark, d)).select(F.col("id").alias("disease_id"), F.col("parent").alias("parent_id"), F.col("kept").alias("kept_id"))


QUERIES = {"p1_found": p1_found, "p1_key_stats": p1_key_stats, "p2_found": p2_found, "p2_monthly": p2_monthly, "p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants, "p4_extra_parents": p4_extra_parents}

_KEYED = """
SELECT 'papers' AS source_table, primary_category AS key_value, id AS paper, fetched_at AS seen_at FROM papers
UNION ALL SELECT 'entity_mentions', entity_id, paper_id, extracted_at FROM entity_mentions
"""

_ORPHANS = r"""
WITH refs AS (
  SELECT 'citation_stubs' AS source_table, stub_id AS row_id, enriched_at AS seen_at, ns AS kind,
         CASE WHEN ns = 'arxiv' THEN regexp_replace(regexp_replace(lower(regexp_replace(v, '[\s\p{Z}]+', '', 'g')), '^[a-z][a-z0-9_.-]*:', ''), 'v[0-9]+$', '')
              ELSE regexp_replace(lower(regexp_replace(v, '[\s\p{Z}]+', '', 'g')), '^[a-z][a-z0-9_.-]*:', '') END AS key
  FROM (SELECT stub_id, enriched_at, unnest(map_keys(identifiers)) AS ns, unnest(map_values(identifiers)) AS v FROM citation_stubs)
  WHERE ns IN ('arxiv', 'pmid', 's2')
  UNION ALL SELECT 'disease_is_a', edge_id, loaded_at, 'disease', lower(regexp_replace(parent_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) FROM disease_is_a
  UNION ALL SELECT 'participates_in', row_id, loaded_at, 'pathway', lower(regexp_replace(pathway_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) FROM participates_in
), life AS (
  SELECT x.kind, x.id, min(x.since) AS since, min(r.removed_at) AS until FROM (
    SELECT 'Paper' AS kind, lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS id, fetched_at AS since FROM papers
    UNION ALL SELECT 'Disease', lower(regexp_replace(disease_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), fetched_at FROM diseases
    UNION ALL SELECT 'Pathway', lower(regexp_replace(pathway_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), loaded_at FROM pathways) x
  LEFT JOIN removals r ON r.record_type = x.kind AND lower(regexp_replace(r.record_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) = x.id
  GROUP BY 1, 2
), parents AS (
  SELECT DISTINCT p.kind, p.key, l.since, l.until, l.id FROM (
    SELECT 'arxiv' AS kind, regexp_replace(lower(regexp_replace(arxiv_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), 'v[0-9]+$', '') AS key, lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS id FROM papers
    UNION ALL SELECT 'pmid', lower(regexp_replace(pmid, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) FROM papers
    UNION ALL SELECT 's2', lower(regexp_replace(s2_paper_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) FROM papers) p JOIN life l ON l.kind = 'Paper' AND l.id = p.id
  WHERE p.key IS NOT NULL
  UNION ALL SELECT lower(kind), id, since, until, id FROM life WHERE kind <> 'Paper'
), states AS (
  SELECT r.source_table, r.row_id, r.seen_at,
         max(CASE WHEN p.since IS NULL THEN 0 WHEN p.since <= r.seen_at AND (p.until IS NULL OR r.seen_at < p.until) THEN 3
                  WHEN r.seen_at < p.since THEN 1 ELSE 2 END) AS state
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.key = r.key
  WHERE r.key IS NOT NULL AND r.key <> '' AND r.seen_at IS NOT NULL GROUP BY 1, 2, 3
)
"""

_TREES = r"""
WITH RECURSIVE links AS (
  SELECT 'mesh:' || upper(regexp_replace(regexp_replace(child_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^mesh:', '', 'i')) AS id,
         'mesh:' || upper(regexp_replace(regexp_replace(parent_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^mesh:', '', 'i')) AS parent FROM disease_is_a WHERE child_id IS NOT NULL
), nodes AS (
  SELECT id, min(parent) AS parent FROM (SELECT id, parent FROM links UNION ALL SELECT parent, NULL FROM links WHERE parent IS NOT NULL) GROUP BY id
), walk AS (
  SELECT id AS start, parent AS node, 1 AS n, [id] AS seen FROM nodes WHERE parent IS NOT NULL
  UNION ALL SELECT w.start, e.parent, w.n + 1, list_append(w.seen, w.node) FROM walk w JOIN nodes e ON e.id = w.node
  WHERE w.node <> w.start AND NOT list_contains(w.seen, w.node) AND e.parent IS NOT NULL
), cycles AS (
  SELECT start AS id, list_min(seen) AS cycle_id FROM walk WHERE node = start
), tree AS (
  SELECT n.id, n.id AS root, CAST(0 AS BIGINT) AS depth, [n.id] AS path, c.cycle_id FROM nodes n LEFT JOIN cycles c ON c.id = n.id WHERE n.parent IS NULL OR c.id IS NOT NULL
  UNION ALL SELECT n.id, t.root, t.depth + 1, list_append(t.path, n.id), t.cycle_id FROM tree t JOIN nodes n ON n.parent = t.id
  WHERE n.id NOT IN (SELECT id FROM cycles)
)
"""

ORACLE = {
    "p1_found": f"""WITH k AS ({_KEYED}), t AS (SELECT source_table, count(*) AS total FROM k GROUP BY 1)
SELECT k.source_table, key_value FROM k JOIN t ON t.source_table = k.source_table WHERE key_value IS NOT NULL
GROUP BY 1, 2, total HAVING count(*) >= 0.02 * total""",
    "p1_key_stats": f"""SELECT source_table, key_value, count(*) AS n_rows, count(DISTINCT paper) AS n_papers, min(seen_at) AS first_at, max(seen_at) AS last_at
FROM ({_KEYED}) WHERE key_value IS NOT NULL GROUP BY 1, 2""",
    "p2_found": _ORPHANS + "SELECT source_table, row_id FROM states WHERE state < 3",
    "p2_monthly": _ORPHANS + "SELECT source_table, strftime(seen_at, '%Y-%m') AS month, CASE state WHEN 0 THEN 'missing' WHEN 1 THEN 'late' ELSE 'deleted' END AS reason, count(*) AS n_orphans FROM states WHERE state < 3 GROUP BY 1, 2, 3",
    "p4_found": _TREES + "SELECT id AS disease_id, cycle_id FROM cycles",
    "p4_hierarchy": _TREES + """SELECT t.id AS disease_id, t.root AS root_id, t.depth, array_to_string(t.path, '/') AS path, coalesce(d.n, 0) AS n_descendants, t.cycle_id,
t.id IN (SELECT id FROM cycles) AS on_cycle
FROM tree t LEFT JOIN (SELECT a, count(*) AS n FROM (SELECT unnest(list_slice(path, 1, -2)) AS a FROM tree) GROUP BY 1) d ON d.a = t.id""",
    "p4_extra_parents": _TREES + "SELECT DISTINCT l.id AS disease_id, l.parent AS parent_id, n.parent AS kept_id FROM links l JOIN nodes n ON n.id = l.id WHERE l.parent <> n.parent",
    "p4_descendants": _TREES + "SELECT path[i] AS ancestor_id, id AS descendant_id, depth + 1 - i AS levels FROM (SELECT *, unnest(generate_series(1, depth)) AS i FROM tree)",
}
