"""References to records that are missing, deleted or not there yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papyra.operators.skew import salted_left_join


def outer_trimmed(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_key(c: Column) -> Column:
    """An id apart from outer white space and letter case; an empty one is null."""
    return F.nullif(F.lower(outer_trimmed(c)), F.lit(""))


def plain_identifier(namespace: Column, c: Column) -> Column:
    """A paper identifier apart from white space, letter case, a leading namespace name with colon and, for arXiv, a version ending; an empty one is null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)\s+", "")), r"^[a-z][a-z0-9_.-]*:", "")
    version = F.when(namespace == "arxiv", r"v[0-9]+$").otherwise(r"$^")  # the second matches nothing in a text that isn't empty
    return F.nullif(F.regexp_replace(bare, version, F.lit("")), F.lit(""))


def lifetimes(records: DataFrame, key: str, since: str, removals: DataFrame, record_type: str) -> DataFrame:
    """Per record ``__id``: ``__from`` its earliest time (inclusive) and ``__until`` its removal (exclusive, null: never).

    Several deliveries make one record; several removals count from the earliest. Null ids are no records.
    """
    first = records.select(plain_key(F.col(key)).alias("__id"), F.col(since).alias("__s")).where("__id is not null").groupBy("__id").agg(F.min("__s").alias("__from"))
    gone = removals.where(F.col("record_type") == record_type).select(plain_key(F.col("record_id")).alias("__id"), "removed_at")
    gone = gone.groupBy("__id").agg(F.min("removed_at").alias("__until"))
    return first.join(gone, "__id", "left")


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose target was not there at their own time, with the reason.

    ``references``: ``source_table, row_id, at, kind, key``, one row per identifier of a reference. ``parents``:
    ``kind, key, __from, __until``, one row per identifier and validity interval. Both are hash-partitioned by (kind, key),
    sorted and merged linearly (sort-merge join, hot keys salted); no side is broadcast. A reference is fine if any of its
    identifiers meets an interval with ``__from <= at < __until``.

    Result: ``source_table, row_id, at, reason``; the reason is ``deleted`` if a target had been there and was removed,
    else ``late`` if one arrives after the reference, else ``missing``. Null keys are no references; a null ``at`` can't be
    placed and is no case; repeated rows give one row; empty tables give none.
    """
    refs = references.where("key is not null and at is not null")
    met = salted_left_join(refs, parents, ["kind", "key"], F.col("row_id"))
    there = F.col("__from").isNotNull() & (F.col("__from") <= F.col("at")) & (F.col("__until").isNull() | (F.col("at") < F.col("__until")))
    state = F.when(there, 3).when(F.col("__from").isNull(), 0).when(F.col("at") < F.col("__from"), 1).otherwise(2)
    best = met.groupBy("source_table", "row_id", "at").agg(F.max(state).alias("__state")).where("__state < 3")
    reason = F.element_at(F.array(F.lit("missing"), F.lit("late"), F.lit("deleted")), F.col("__state") + 1)
    return best.select("source_table", "row_id", "at", reason.alias("reason"))


def stub_references(stubs: DataFrame) -> DataFrame:
    """One reference per usable identifier of a stub; a null or empty map and other namespaces give none."""
    pairs = stubs.select(F.col("stub_id").alias("row_id"), F.col("enriched_at").alias("at"), F.explode("identifiers").alias("__ns", "__v"))
    kind = F.lower(F.trim("__ns"))
    return pairs.where(kind.isin("arxiv", "pmid", "s2")).select(
        F.lit("citation_stubs").alias("source_table"), "row_id", "at", kind.alias("kind"), plain_identifier(kind, F.col("__v")).alias("key")
    )


def id_references(df: DataFrame, source_table: str, row_id: str, key: str, kind: str) -> DataFrame:
    return df.select(F.lit(source_table).alias("source_table"), F.col(row_id).alias("row_id"), F.col("loaded_at").alias("at"), F.lit(kind).alias("kind"), plain_key(F.col(key)).alias("key"))


def paper_targets(papers: DataFrame, removals: DataFrame) -> DataFrame:
    """Papers under each of their identifiers, with the validity interval of the paper."""
    life = lifetimes(papers, "id", "fetched_at", removals, "Paper")
    names = F.array(*[F.struct(F.lit(k).alias("kind"), plain_identifier(F.lit(k), F.col(c)).alias("key")) for k, c in (("arxiv", "arxiv_id"), ("pmid", "pmid"), ("s2", "s2_paper_id"))])
    under = papers.select(plain_key(F.col("id")).alias("__id"), F.explode(names).alias("__k")).select("__id", "__k.kind", "__k.key").where("__id is not null and key is not null").distinct()
    return under.join(life, "__id").select("kind", "key", "__from", "__until")


def literature_orphans(stubs: DataFrame, is_a: DataFrame, participates: DataFrame, papers: DataFrame, diseases: DataFrame, pathways: DataFrame, removals: DataFrame) -> DataFrame:
    """The orphan references of the three referring tables of the graph."""
    refs = stub_references(stubs).unionByName(id_references(is_a, "disease_is_a", "edge_id", "parent_id", "disease"))
    refs = refs.unionByName(id_references(participates, "participates_in", "row_id", "pathway_id", "pathway"))
    parents = paper_targets(papers, removals)
    for df, key, since, kind in ((diseases, "disease_id", "fetched_at", "Disease"), (pathways, "pathway_id", "loaded_at", "Pathway")):
        life = lifetimes(df, key, since, removals, kind)
        parents = parents.unionByName(life.select(F.lit(kind.lower()).alias("kind"), F.col("__id").alias("key"), "__from", "__until"))
    return orphan_references(refs, parents)


def monthly_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per referring table, month (``YYYY-MM`` of the reference's own time) and reason."""
    return orphans.groupBy("source_table", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
