"""Identity crosswalks between vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papyra.operators.dedupe import one_per_key


def tag_crosswalk(rows: DataFrame, tag: str, identifier: str, last_first: list[Column]) -> DataFrame:
    """``tag, id``: the last row of every tag counts; empty tags and ``-`` are none."""
    used = rows.where(F.col(tag).isNotNull() & ~F.col(tag).isin("", "-") & F.col(identifier).isNotNull())
    return one_per_key(used, [tag], *last_first).select(F.col(tag).alias("tag"), F.col(identifier).alias("id"))


def unambiguous(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value."""
    return pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo = hi").select(key, F.col("lo").alias(value))


def compound_crosswalk(accessions: DataFrame, registry: DataFrame, headings: DataFrame, curated: DataFrame) -> DataFrame:
    """``accession, mesh``: compound accessions and MeSH keys (``mesh:`` and the identifier).

    The bridge goes accession -> registry numbers -> headings and counts only if all numbers together lead to one heading;
    curated pairs override it, if they are unambiguous themselves. ``accessions``: compound_id, accession; ``registry``:
    compound_id, cas; ``headings``: cas, ui; ``curated``: accession, ui.
    """
    bridge = unambiguous(accessions.join(registry, "compound_id").join(headings, "cas").select("accession", "ui"), "accession", "ui")
    sure = unambiguous(curated, "accession", "ui").withColumnRenamed("ui", "__ui")
    both = sure.join(bridge, "accession", "full_outer")
    return both.select("accession", F.concat(F.lit("mesh:"), F.coalesce("__ui", "ui")).alias("mesh"))


def disease_xrefs(terms: DataFrame) -> DataFrame:
    """``mesh, doid, name``: for every MeSH id the smallest DOID (as text) of the live, named terms that refer to it.

    ``terms``: id, name, is_obsolete, xrefs array<string>.
    """
    live = terms.where("not is_obsolete and name is not null and name != ''")
    refs = live.select("id", "name", F.explode("xrefs").alias("x")).where(F.col("x").startswith("MESH:"))
    best = refs.groupBy(F.concat(F.lit("mesh:"), F.substr("x", F.lit(6))).alias("mesh")).agg(F.min(F.struct("id", "name")).alias("m"))
    return best.select("mesh", F.col("m.id").alias("doid"), F.col("m.name").alias("name"))
