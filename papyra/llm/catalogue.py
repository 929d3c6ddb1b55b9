"""The queries of this package, by name, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyra.llm import appearance, encode, leaks, names, neighbours
from papyra.session import table


#: p3: the neighbours wanted of each paper, and the least similarity of a pair.
K, LEAST, WIDTH = 5, 0.9, 64


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_vectors(spark, table(spark, d, "papers"), "id", "embedding", K, WIDTH, LEAST, at="fetched_at")
    return near.select(F.least("key_a", "key_b").alias("paper_id_a"), F.greatest("key_a", "key_b").alias("paper_id_b")).distinct()


def p3_embedding_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_vectors(spark, table(spark, d, "embeddings"), "vec_id", "embedding", K, WIDTH, probes=None)
    return near.select("key_a", "key_b", F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_entity_pairs(names.spelling_links(spark, table(spark, d, "papers"), "authors"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_links(spark, table(spark, d, "papers"), "authors")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(p6_ids(spark, d))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.verbatim_matches(spark, table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("doc_id", "item_id").distinct()


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leaks.without_leaks(docs, _matches(spark, d)).select("doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = appearance.lookalike_pairs(spark, table(spark, d, "documents"))
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return appearance.consistent_form(spark, table(spark, d, "documents"))


QUERIES = {"p3_found": p3_found, "p3_embedding_neighbours": p3_embedding_neighbours, "p5_found": p5_found, "p5_entities": p5_entities, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_matches": p7_matches, "p7_clean": p7_clean, "p8_found": p8_found, "p8_forms": p8_forms}
ORACLE = {
    "p3_embedding_neighbours": """SELECT key_a, key_b, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY key_a ORDER BY s DESC, key_b) AS n FROM (
    SELECT a.vec_id AS key_a, b.vec_id AS key_b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE n <= 5""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
