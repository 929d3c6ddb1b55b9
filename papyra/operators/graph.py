"""Traversals over edge tables ``(src, dst)``: neighbours, neighbourhoods, ancestors and bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from papyra.operators.dedupe import one_per_key
from papyra.session import Cut


def neighbours(edges: DataFrame, nodes: DataFrame, anchor: str, at: str, key: str, columns: list[str], limit: int | None = None, order: list | None = None) -> DataFrame:
    """The nodes one edge away from ``anchor``, which is the edge's ``at`` end. The anchor reaches the scan as a filter.

    Ordered by ``order``, by default the key, so a limit is deterministic.
    """
    other = "dst" if at == "src" else "src"
    hit = edges.where(F.col(at) == anchor).select(F.col(other).alias(key)).distinct()
    out = hit.join(nodes, key).select(*columns)
    return out if limit is None else out.orderBy(*(order or [key])).limit(limit)


def shared_neighbours(edges: DataFrame, anchor: str, via: str = "src", end: str = "dst", limit: int | None = None) -> DataFrame:
    """``end, n``: end points that share a ``via`` with the anchor (itself left out), by the number of distinct shared ones.

    The anchor's side is filtered first, so the self join only meets its own neighbours.
    """
    mine = edges.where(F.col(end) == anchor).select(via).distinct()
    out = edges.join(mine, via, "left_semi").where(F.col(end) != anchor).groupBy(end).agg(F.count_distinct(via).alias("n"))
    return out if limit is None else out.orderBy(F.desc("n"), end).limit(limit)


def two_hops(first: DataFrame, second: DataFrame, limit: int | None = None) -> DataFrame:
    """``dst, n``: what ``second(via, dst)`` leads to from the ``via`` of ``first``, with the number of distinct ones."""
    out = second.join(first.select("via").distinct(), "via", "left_semi").groupBy("dst").agg(F.count_distinct("via").alias("n"))
    return out if limit is None else out.orderBy(F.desc("n"), "dst").limit(limit)


def neighbourhood(edges: DataFrame, seed: str, depth: int) -> DataFrame:
    """``id`` of all nodes that an undirected trail of 1 to ``depth`` edges leads to from ``seed`` (depth is clamped to 1..3).

    A trail uses no edge twice but may visit a node again. So another node is reached if its distance is at most the depth,
    and the seed itself if a closed trail is short enough: a loop, two parallel or reciprocal edges, a triangle. Repeated
    rows of ``edges`` are one edge; a -> b and b -> a are two.
    """
    depth = max(1, min(3, depth))
    once = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    once = once if depth == 1 else Cut(edges.sparkSession, "edges")(once)  # read once for all steps
    both = once.where("src != dst").select("src", "dst").unionByName(once.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    frontier = both.where(F.col("src") == seed).select("dst").distinct()
    first, reached = frontier, [frontier]
    for _ in range(depth - 1):
        frontier = both.join(frontier.select(F.col("dst").alias("src")), "src", "left_semi").select("dst").distinct()
        reached.append(frontier)
    others = reduce(DataFrame.unionByName, reached).where(F.col("dst") != seed).select(F.col("dst").alias("id")).distinct()
    closed = [once.where((F.col("src") == seed) & (F.col("dst") == seed)).select(F.lit(seed).alias("id"))]
    if depth >= 2:
        twice = both.where(F.col("src") == seed).groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        closed.append(twice.select(F.lit(seed).alias("id")))
    if depth >= 3:
        ring = both.join(first.select(F.col("dst").alias("src")), "src", "left_semi").join(first, "dst", "left_semi").where((F.col("src") != seed) & (F.col("dst") != seed))
        loop = once.where("src = dst").select("src").join(first.select(F.col("dst").alias("src")), "src", "left_semi")
        looped = loop.join(both.where(F.col("src") == seed).groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "src", "left_semi")
        closed += [ring.select(F.lit(seed).alias("id")), looped.select(F.lit(seed).alias("id"))]
    return others.unionByName(reduce(DataFrame.unionByName, closed).limit(1))


def nearest_mapped_ancestors(is_a: DataFrame, mapped: DataFrame) -> DataFrame:
    """``id, ancestor``: for every child of ``is_a(child, parent)``, the first mapped node on each path up.

    A search stops at a mapped node and goes on through others. Open searches are composed with themselves, so after round
    i they stand 2^i links up: the rounds are logarithmic in the depth. Searches that ran into a root or that have gone
    further than there are links (a cycle without mapped nodes) end without result.
    """
    cut = Cut(is_a.sparkSession, "ancestors")
    known = mapped.select(F.col("id").alias("at")).distinct().withColumn("hit", F.lit(True))
    links = is_a.where("child is not null and parent is not null").select(F.col("child").alias("id"), F.col("parent").alias("at")).distinct()
    pairs = cut(links.join(known, "at", "left").select("id", "at", F.coalesce("hit", F.lit(False)).alias("hit")))
    most, walked = pairs.count(), 1
    while walked <= most and not pairs.where("not hit").isEmpty():
        ahead = pairs.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("hit").alias("met"))
        further = pairs.where("not hit").join(ahead, "at").select("id", F.col("next").alias("at"), F.col("met").alias("hit"))
        step = cut(pairs.where("hit").unionByName(further).distinct())
        cut.drop(pairs)
        pairs, walked = step, 2 * walked
    return pairs.where("hit").select("id", F.col("at").alias("ancestor")).distinct()


def project_is_a(is_a: DataFrame, keys: DataFrame) -> DataFrame:
    """``src, dst``: the subtype edges between external keys ``keys(id, key)``: each key of a node to each key of its nearest mapped ancestors, no self edges."""
    up = nearest_mapped_ancestors(is_a, keys.select("id").distinct())
    a, b = keys.select("id", F.col("key").alias("src")), keys.select(F.col("id").alias("ancestor"), F.col("key").alias("dst"))
    return up.join(a, "id").join(b, "ancestor").where("src != dst").select("src", "dst").distinct()


def incident(edges: DataFrame, kind: str, key: str) -> DataFrame:
    """``rel, other_kind, other`` of every edge, in either direction, at node ``key`` of ``kind``. ``edges``: rel, src_kind, src, dst_kind, dst."""
    out = edges.where((F.col("src_kind") == kind) & (F.col("src") == key)).select("rel", F.col("dst_kind").alias("other_kind"), F.col("dst").alias("other"))
    into = edges.where((F.col("dst_kind") == kind) & (F.col("dst") == key)).select("rel", F.col("src_kind").alias("other_kind"), F.col("src").alias("other"))
    return out.unionByName(into)


def result_graph(vertices: DataFrame, edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A drawable graph of a mixed result: (at most ``cap`` nodes by key, the edges between them, one row ``kept, hidden`` of edges).

    End points that are no vertex of the result are added by their key.
    """
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    nodes = vertices.select("id", "label").unionByName(ends.join(vertices.select("id"), "id", "left_anti").withColumn("label", F.col("id")))
    kept = one_per_key(nodes, ["id"], F.col("label")).orderBy("id").limit(cap)
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    counts = edges.agg(F.count(F.lit(1)).alias("total")).join(inside.agg(F.count(F.lit(1)).alias("kept")), F.lit(True)).select("kept", (F.col("total") - F.col("kept")).alias("hidden"))
    return kept, inside, counts
