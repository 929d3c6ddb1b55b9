"""Keyed upserts as functions from the old state and incoming rows to the new state.

States are DataFrames; writing them is the business of ``papyra.store``. Created rows are returned as a DataFrame, so a
caller that needs no count pays for none.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, functions as F

from papyra.operators.dedupe import one_per_key


class CreateMissing(Enum):
    """Which end points of an edge may be created by it."""

    # Fixed values.
    NONE = "none"
    SRC = "src"
    DST = "dst"
    BOTH = "both"


@dataclass
class NodeUpsert:
    state: DataFrame
    created: DataFrame


@dataclass
class EdgeUpsert:
    state: DataFrame
    created: DataFrame
    src_nodes: DataFrame
    dst_nodes: DataFrame


def written_props(declared: list[str], incoming: DataFrame) -> list[str]:
    """The declared properties that the incoming rows have, in declared order."""
    return [p for p in declared if p in incoming.columns]


def last_wins(incoming: DataFrame, key: list[str], position: str | None) -> DataFrame:
    """One row per key, the last by ``position``; without one the last in the order of the rows' partitions."""
    rows = incoming.withColumn("__at", F.monotonically_increasing_id()) if position is None else incoming.withColumnRenamed(position, "__at")
    return one_per_key(rows, key, F.col("__at").desc()).drop("__at")


def upsert_nodes(existing: DataFrame, incoming: DataFrame, key: str, update: bool, declared: list[str] | None = None, position: str | None = None) -> NodeUpsert:
    """Inserts absent keys; with ``update``, rewrites the written properties of present ones (nulls included), else leaves them.

    Null keys are dropped. Repeated incoming keys: the last by ``position`` counts, once. Properties that are not declared
    are not written. Columns only one side has are null for rows of the other.
    """
    props = written_props(declared or [c for c in incoming.columns if c not in (key, position)], incoming)
    new = last_wins(incoming.where(F.col(key).isNotNull()), [key], position).select(F.col(key).alias("__k"), *[F.col(p).alias(f"__new_{p}") for p in props], F.lit(True).alias("__in"))
    old = existing.withColumn("__was", F.lit(True))
    both = old.join(new, F.col(key) == F.col("__k"), "full_outer")
    columns: list[Column] = [F.coalesce(key, "__k").alias(key)]
    for c in [c for c in existing.columns if c != key] + [p for p in props if p not in existing.columns]:
        before = F.col(c) if c in existing.columns else F.lit(None)
        if c not in props:
            columns.append(before.alias(c))
        elif update:
            columns.append(F.when(F.col("__in"), F.col(f"__new_{c}")).otherwise(before).alias(c))
        else:
            columns.append(F.when(F.col("__was").isNull(), F.col(f"__new_{c}")).otherwise(before).alias(c))
    return NodeUpsert(both.select(*columns), both.where("__was is null").select(F.col("__k").alias(key)))


def upsert_edges(
    existing: DataFrame, incoming: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, src_key: str, dst_key: str, create: CreateMissing = CreateMissing.NONE,
    update: bool = False, bootstrappable: tuple[bool, bool] = (True, True), position: str | None = None,
) -> EdgeUpsert:
    """Upserts edges ``(src, dst, props...)``, at most one per pair.

    Rows whose end point is absent are dropped, unless ``create`` allows that end: then a node with only its key is
    created. An end whose type can't be bootstrapped must not be created (ValueError). Null ends are dropped.
    """
    make_src, make_dst = create in (CreateMissing.SRC, CreateMissing.BOTH), create in (CreateMissing.DST, CreateMissing.BOTH)
    if (make_src and not bootstrappable[0]) or (make_dst and not bootstrappable[1]):
        raise ValueError("this type of node can't be created from an edge")
    rows = last_wins(incoming.where("src is not null and dst is not null"), ["src", "dst"], position)
    if not make_src:
        rows = rows.join(src_nodes.select(F.col(src_key).alias("src")), "src", "left_semi")
    if not make_dst:
        rows = rows.join(dst_nodes.select(F.col(dst_key).alias("dst")), "dst", "left_semi")
    props = [c for c in rows.columns if c not in ("src", "dst")]
    new = rows.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), *[F.col(p).alias(f"__new_{p}") for p in props], F.lit(True).alias("__in"))
    both = existing.withColumn("__was", F.lit(True)).join(new, (F.col("src") == F.col("__s")) & (F.col("dst") == F.col("__d")), "full_outer")
    take = F.col("__in") if update else F.col("__was").isNull()
    columns = [F.coalesce("src", "__s").alias("src"), F.coalesce("dst", "__d").alias("dst")]
    columns += [F.when(take, F.col(f"__new_{p}")).otherwise(F.col(p) if p in existing.columns else F.lit(None)).alias(p) for p in props]
    columns += [F.col(c) for c in existing.columns if c not in ("src", "dst", *props)]

    def grown(nodes: DataFrame, key: str, end: str, make: bool) -> DataFrame:
        if not make:
            return nodes
        return nodes.unionByName(rows.select(F.col(end).alias(key)).distinct().join(nodes.select(key), key, "left_anti"), allowMissingColumns=True)

    return EdgeUpsert(both.select(*columns), both.where("__was is null").select(F.col("__s").alias("src"), F.col("__d").alias("dst")), grown(src_nodes, src_key, "src", make_src), grown(dst_nodes, dst_key, "dst", make_dst))


def paper_delta(existing: DataFrame, incoming: DataFrame, position: str | None = None) -> DataFrame:
    """One row of what an upsert of full papers changes: ``new_papers, upgraded_stubs, embedded_delta, earliest, latest``.

    Papers are overwritten whole, so a delivery without a vector takes an old vector away (delta -1).
    """
    new = last_wins(incoming, ["id"], position).select("id", F.col("embedding").isNotNull().alias("__now"), "published_date")
    old = existing.select("id", "is_stub", F.col("embedding").isNotNull().alias("__before"), F.lit(True).alias("__was"))
    both = new.join(old, "id", "left")
    before, now = F.coalesce("__before", F.lit(False)).cast("int"), F.col("__now").cast("int")
    return both.agg(
        F.count_if(F.col("__was").isNull()).alias("new_papers"), F.count_if(F.coalesce("is_stub", F.lit(False))).alias("upgraded_stubs"),
        F.coalesce(F.sum(now - before), F.lit(0)).alias("embedded_delta"), F.min("published_date").alias("earliest"), F.max("published_date").alias("latest"),
    )


def upsert_papers(existing: DataFrame, incoming: DataFrame, position: str | None = None, preserve_embedding: bool = False) -> NodeUpsert:
    """Papers overwritten whole (nulls included) and no longer stubs; ``preserve_embedding`` keeps a vector that a delivery lacks."""
    up = upsert_nodes(existing, incoming.withColumn("is_stub", F.lit(False)), "id", True, position=position)
    if preserve_embedding:
        kept = existing.select("id", F.col("embedding").alias("__kept"))
        up.state = up.state.join(kept, "id", "left").withColumn("embedding", F.coalesce("embedding", "__kept")).drop("__kept")
    return up


def fold_stats(old: DataFrame, delta: DataFrame, sums: list[str], lows: list[str] = (), highs: list[str] = ()) -> DataFrame:
    """The one-row counters after a delta: sums (null as 0), minima and maxima."""
    both = old.select(*sums, *lows, *highs).unionByName(delta.select(*sums, *lows, *highs))
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])


def count_new_edges(created: DataFrame, by: str, counts: DataFrame, key: str, column: str) -> DataFrame:
    """Counters per node, raised by the number of created edges that end there; nodes without new edges keep theirs."""
    more = created.groupBy(F.col(by).alias(key)).agg(F.count(F.lit(1)).alias("__more"))
    return counts.join(more, key, "full_outer").withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("__more", F.lit(0))).drop("__more")


def backfill_names(nodes: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Nodes with ``name`` filled from ``names(key, name)`` where it was null, and ``filled`` telling where."""
    new = names.where("name is not null").groupBy(key).agg(F.min("name").alias("__name"))
    both = nodes.join(new, key, "left").withColumn("filled", F.col("name").isNull() & F.col("__name").isNotNull())
    return both.withColumn("name", F.coalesce("name", "__name")).drop("__name")


def apply_enrichment(papers: DataFrame, results: DataFrame, stubs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Citation results written to the graph: (papers, cites edges, one-row delta).

    ``results``: ``id, s2_paper_id, citation_count, reference_count, enriched_at``, one row per paper, counts null for a paper that
    was not found, which is stamped all the same and loses what it had. ``stubs``: ``paper_id, direction, id, title``. References
    point from the paper, citations to it; stubs are only created where no paper has their id.
    """
    written = ["s2_paper_id", "citation_count", "reference_count", "enriched_at"]
    old = papers.select("id", F.col("citation_count").alias("__before"))
    delta = results.join(old, "id").agg(F.count_if(F.col("__before").isNull() & F.col("citation_count").isNotNull()).alias("newly_enriched"))
    found = stubs.where("id is not null")
    fresh = found.groupBy("id").agg(F.max("title").alias("title")).withColumn("is_stub", F.lit(True))
    grown = upsert_nodes(papers, fresh, "id", False).state
    updated = upsert_nodes(grown, results.join(grown.select("id"), "id", "left_semi"), "id", True, written).state
    out = F.col("direction") == "references"
    edges = found.select(F.when(out, F.col("paper_id")).otherwise(F.col("id")).alias("src"), F.when(out, F.col("id")).otherwise(F.col("paper_id")).alias("dst"))
    ends = updated.select(F.col("id").alias("src"))
    edges = edges.distinct().join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return updated, edges.select("src", "dst"), delta


def set_embeddings(papers: DataFrame, vectors: DataFrame) -> DataFrame:
    """Papers with ``embedding`` and ``embedded_at`` replaced where ``vectors(id, embedding, embedded_at)`` has their id; nothing else changes."""
    new = last_wins(vectors, ["id"], None).select("id", F.col("embedding").alias("__e"), F.col("embedded_at").alias("__t"), F.lit(True).alias("__in"))
    both = papers.join(new, "id", "left")
    return both.withColumn("embedding", F.when(F.col("__in"), F.col("__e")).otherwise(F.col("embedding"))).withColumn("embedded_at", F.when(F.col("__in"), F.col("__t")).otherwise(F.col("embedded_at"))).drop("__e", "__t", "__in")


def upsert_mentions(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, position: str) -> tuple[NodeUpsert, DataFrame, DataFrame]:
    """Entity mentions written to the graph: (nodes, created edges, all edges).

    ``mentions``: ``paper_id, vertex_type, entity_id, name, source`` and a position. An entity's last name in the batch counts; existing
    nodes keep theirs, unless it is null, which is filled; the first writer of an edge keeps its ``source``.
    """
    rows = mentions.where("entity_id is not null and paper_id is not null")
    named = one_per_key(rows.where("name is not null"), ["vertex_type", "entity_id"], F.col(position).desc()).select("vertex_type", "entity_id", F.col("name").alias("__name"))
    batch = rows.select("vertex_type", "entity_id").distinct().join(named, ["vertex_type", "entity_id"], "left")
    both = nodes.withColumn("__was", F.lit(True)).join(batch, ["vertex_type", "entity_id"], "full_outer")
    state = both.withColumn("name", F.coalesce("name", "__name"))
    links = one_per_key(rows, ["paper_id", "vertex_type", "entity_id"], F.col(position)).select("paper_id", "vertex_type", "entity_id", "source")
    created = links.join(edges, ["paper_id", "vertex_type", "entity_id"], "left_anti")
    return NodeUpsert(state.drop("__was", "__name"), state.where("__was is null").select("vertex_type", "entity_id")), created, edges.unionByName(created)
