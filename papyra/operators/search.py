"""Keyword, vector and entity search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from papyra.functions.text import cosine, search_terms

#: BM25 parameters.
K1, B = 1.2, 0.75


def keyword_search(docs: DataFrame, query: str, key: str, text: Column, keep: Column | None = None, top: int = 10, fallback: bool = True) -> DataFrame:
    """``key, score``: documents by BM25 (ties: smaller key). All terms must match; if no document has all, any may.

    ``keep`` filters before the limit; statistics are over all documents with text. One pass over the corpus: per document
    only the counts of the query's terms and its length are kept, never an exploded index, and the document frequencies and
    the number of matches needed come from a one-row aggregate that is broadcast.
    """
    terms = search_terms(query)
    low = F.lower(text)
    tf = [F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(t)}(?![\p{{L}}\p{{N}}])")).cast("double").alias(f"__tf{i}") for i, t in enumerate(terms)]
    lean = docs.select(key, (keep if keep is not None else F.lit(True)).alias("__keep"), F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")).cast("double").alias("__len"), *tf).where("__len > 0")
    has = [F.col(f"__tf{i}") > 0 for i in range(len(terms))]
    matched = sum((h.cast("int") for h in has), F.lit(0))
    facts = lean.agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__len").alias("__avg"), F.max(F.when(F.col("__keep"), matched)).alias("__most"), *[F.count_if(h).cast("double").alias(f"__df{i}") for i, h in enumerate(has)])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        score = score + idf * F.col(f"__tf{i}") * (K1 + 1) / (F.col(f"__tf{i}") + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    need = F.when(F.col("__most") == len(terms), len(terms)).otherwise(1 if fallback else len(terms))
    hits = lean.join(F.broadcast(facts), F.lit(True)).where(F.col("__keep") & (matched > 0) & (matched >= need))
    return hits.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(top)


def semantic_search(vectors: DataFrame, query: list[float], key: str, vector: str, top: int = 10, keep: Column | None = None, filter_first: bool = False) -> DataFrame:
    """``key, similarity``: the nearest vectors to ``query`` by exact cosine (ties: smaller key).

    ``keep`` is applied to the top rows, which may leave fewer, unless ``filter_first``. Vectors of another length are left out.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size(vector) == len(query))
    if filter_first and keep is not None:
        rows = rows.where(keep)
    scored = rows.withColumn("similarity", F.round(cosine(F.col(vector), q), 6)).where("similarity is not null").orderBy(F.desc("similarity"), key).limit(top)
    if keep is not None and not filter_first:
        scored = scored.where(keep)
    return scored.select(key, "similarity")


def search_entities(nodes: DataFrame, query: str, key: str, fields: list[str], limit: int | None = 10) -> DataFrame:
    """Nodes of which any field contains the query, apart from case; the shortest names first, nulls last, then by key."""
    q = F.lit(query.lower())
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f).cast("string")), q), F.lit(False))
    found = nodes.where(hit)
    return found if limit is None else found.orderBy(F.length("name").asc_nulls_last(), key).limit(limit)


def resolve_paper(papers: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked, id``: the paper of each ``asked(asked)`` key: by id, else by PubMed id, else by arXiv id; null if there is none.

    One pass over the papers: each is listed under its three names, and the best match is kept.
    """
    names = F.array(F.struct(F.lit(0).alias("rank"), F.col("id").alias("asked")), F.struct(F.lit(1).alias("rank"), F.col("pmid").alias("asked")), F.struct(F.lit(2).alias("rank"), F.col("arxiv_id").alias("asked")))
    under = papers.select("id", F.explode(names).alias("x")).select("id", "x.rank", "x.asked")
    return asked.join(under, "asked", "left").groupBy("asked").agg(F.min(F.struct("rank", "id")).alias("m")).select("asked", F.col("m.id").alias("id"))
