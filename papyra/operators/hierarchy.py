"""Parent-child links to full hierarchies: cycles, roots, depths, paths and descendants.

All steps work on node tables with joins, and the number of rounds is logarithmic in the depth (pointer doubling). No round
brings nodes to the driver: it only reads counts. Joins towards ancestors are salted, as one node may be the ancestor of
almost all others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from papyra.operators.skew import fair_share, salted_left_join
from papyra.session import Cut

#: Paths are put together from blocks of so many nodes of a chain.
BLOCK = 64


def _edges(links: DataFrame, child: str, parent: str) -> DataFrame:
    return links.select(F.col(child).alias("id"), F.col(parent).alias("parent")).where("id is not null")


def parent_table(links: DataFrame, child: str, parent: str) -> DataFrame:
    """One row ``id, parent`` per node. A node that is only a parent, or only has null parents, is a root (null parent).

    Null children are dropped: they name no node. Repeated links count once. A child of several parents keeps the smallest,
    so the result is a forest whatever the input; ``extra_parents`` reports the links that are left out by that.
    """
    edges = _edges(links, child, parent)
    ends = edges.unionByName(edges.where("parent is not null").select(F.col("parent").alias("id"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent")))
    return ends.groupBy("id").agg(F.min("parent").alias("parent"))


def extra_parents(links: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """``id, parent, kept``: the links of children with several parents that ``parent_table`` leaves out, and the parent it keeps. A cycle through such a link isn't seen."""
    once = _edges(links, child, parent).where("parent is not null").distinct()
    several = once.groupBy("id").agg(F.min("parent").alias("kept"), F.max("parent").alias("__last")).where("kept != __last").select("id", "kept")
    return once.join(several, "id").where("parent != kept").select("id", "parent", "kept")


def _look(state: DataFrame, limit: float) -> Row:
    """Of the rows that still point at a node: ``open`` their number, ``targets`` the number of nodes pointed at, ``moving`` whether a minimum changed, and ``heavy``, the nodes that at least ``limit`` rows point at (no more than all rows / limit)."""
    state = state if "changed" in state.columns else state.withColumn("changed", F.lit(False))
    per = state.where("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("changed").alias("moved"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("open"), F.count(F.lit(1)).alias("targets"), F.coalesce(F.max("moved"), F.lit(False)).alias("moving"), F.collect_list(F.when(F.col("n") >= limit, F.struct("p", "n"))).alias("heavy")).first()


def _towards(state: DataFrame, ahead: DataFrame, heavy: list[Row], limit: float) -> DataFrame:
    """Every row joined with the row of the node it points at; nodes many point at are salted."""
    if not heavy:
        return state.join(ahead, "p", "left")
    marks = state.sparkSession.createDataFrame([(x.p, math.ceil(x.n / limit)) for x in heavy], T.StructType([T.StructField("p", state.schema["p"].dataType), T.StructField("__salts", T.IntegerType())]))
    return salted_left_join(state, ahead, ["p"], F.col("id"), heavy=marks)


def cycle_nodes(nodes: DataFrame, cut: Cut) -> DataFrame:
    """``id, cycle_id`` of the nodes on a cycle of ``nodes(id, parent)``; cycle_id is the smallest id on the cycle."""
    lost = climb(nodes.select("id", F.col("parent").alias("up"), F.col("id").alias("cycle")), cut, nodes.count())[1]
    return rings(lost) if lost is not None else nodes.select("id", F.col("id").alias("cycle_id")).limit(0)


def rings(lost: DataFrame) -> DataFrame:
    """``id, cycle_id`` of the cycles among the nodes without root that ``climb`` returns."""
    return lost.join(lost.select(F.col("p").alias("id")).distinct(), "id", "left_semi").select("id", F.col("m").alias("cycle_id"))


def prefix_sums(df: DataFrame, group: str, order: str, value: str, out: str, cut: Cut) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before in ``order`` (0 for the first).

    (group, order) must be unique. A group is range-partitioned over many tasks, so one that holds a third of all rows is
    no problem: sums inside a partition are completed by the sums of the partitions before.
    """
    placed = cut(df.repartitionByRange(F.col(group), F.col(order)).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(group, "__part").agg(F.sum(value).alias("__s")).select(group, "__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    local = placed.withColumn("__l", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(parts, [group, "__part"]).withColumn(out, F.col("__l") + F.col("__b")).drop("__l", "__b", "__part")


def climb(nodes: DataFrame, cut: Cut, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(nodes of trees: ``id, root, depth, acc, cycle``; nodes without root, as they are in or below a cycle: ``id, p, m``, or None) of ``nodes(id, up, cycle)``.

    After round i, p is the 2^i-th ancestor, acc counts the nodes less than 2^i levels below, and m is the smallest of the
    first 2^i ids on the way. A tree that isn't finished closes nodes in every round; so once none is closed, all that are
    open never reach a root. They go on until the set they point at no longer shrinks: then every tail has been walked off,
    and that set is exactly the nodes on cycles; and until a round changes no minimum: then each window of a cycle has the
    same minimum as the window after it, all the way round.
    """
    up, limit = F.col("up"), n * fair_share(cut.spark)
    state = cut(nodes.select("id", up.alias("p"), F.coalesce("up", "id").alias("root"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("acc"), "cycle", F.col("id").alias("m"), F.lit(True).alias("changed")))
    done, before, spent = None, None, state
    columns = ["id", "root", "depth", "acc", "cycle"]
    while True:
        now = _look(state, limit)
        if now.open == 0:
            return state.select(*columns), None
        if done is None and before and before.open == now.open:
            done, state, spent = state.where("p is null").select(*columns), state.where("p is not null"), None
        if done is not None and before.targets == now.targets and not now.moving:
            return done, state.select("id", "p", "m")
        before = now
        below = state.where("p is not null").groupBy(F.col("p").alias("id")).agg(F.sum("acc").alias("more"))
        ahead = state.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("cycle").alias("c"), F.col("m").alias("k"))
        met = _towards(state, ahead, now.heavy, limit).join(below, "id", "left")
        state = cut(met.select(
            "id", F.col("q").alias("p"), F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"), F.coalesce("c", "cycle").alias("cycle"),
            F.least("m", "k").alias("m"), F.coalesce(F.col("k") < F.col("m"), F.lit(False)).alias("changed"),
        ))
        if spent is not None:  # the table that holds the finished trees stays
            cut.drop(spent)
        spent = state


def label_trees(spark: SparkSession, links: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """Every node with ``parent, root, depth, n_descendants, enter, leave, chain, chain_pos, segments, cycle_id, on_cycle``.

    Cycles are told apart first: a node on a cycle is the root of what hangs below it, keeps its parent, and carries the
    smallest id of the cycle as ``cycle_id``; nodes below inherit it with ``on_cycle`` false; all others have null.
    Descendants of a node are exactly the nodes of the same root whose ``enter`` lies in ``(enter, leave)``, as preorder
    numbers start at 0 in every tree.

    Heavy-path decomposition: subtree sizes by doubling; every node's largest child (ties: smallest id) continues its
    chain, so any path meets at most log2(n) chains. ``chain`` is the head of a node's chain and ``chain_pos`` its place;
    preorder numbers are consecutive along a chain, which makes chains intervals. ``segments`` are the pieces of chains,
    (head, first depth, last depth), of which the path from the root consists: at most log2(n), however long it is.

    Nulls, repeats and several parents: see ``parent_table``. Empty table: no rows.
    """
    cut = Cut(spark, "hierarchy")
    nodes = cut(parent_table(links, child, parent))
    key = nodes.schema["id"].dataType
    none = F.lit(None).cast(key)
    n = nodes.count()
    limit = n * fair_share(spark)
    climbed, lost = climb(nodes.select("id", F.col("parent").alias("up"), none.alias("cycle")), cut, n)
    if lost is not None:
        again = nodes.join(lost.select("id"), "id", "left_semi").join(rings(lost), "id", "left")
        again = again.select("id", F.when(F.col("cycle_id").isNull(), F.col("parent")).alias("up"), F.col("cycle_id").alias("cycle"))
        climbed = climbed.unionByName(climb(cut(again), cut, n)[0])
    on_cycle = (F.col("root") == F.col("id")) & F.col("cycle").isNotNull()
    sized = cut(nodes.join(climbed, "id").withColumn("on_cycle", on_cycle).withColumn("up", F.when(~on_cycle, F.col("parent"))))

    # heavy children, and where each child's subtree begins after its parent
    best = sized.where("up is not null").groupBy("up").agg(F.min(F.struct((-F.col("acc")).alias("a"), "id")).alias("h")).select(F.col("up").alias("p"), F.col("h.id").alias("heavy"), (-F.col("h.a")).alias("heavy_size"))
    tied = sized.select("id", F.col("up").alias("p"), "acc", "depth")
    kin = cut(_towards(tied, best, _look(tied, limit).heavy, limit))
    light = prefix_sums(kin.where("p is not null and id != heavy").select("id", "p", "acc", "heavy_size"), "p", "id", "acc", "earlier", cut).select("id", (F.col("earlier") + F.col("heavy_size") + 1).alias("off"))

    # down from the root by doubling: preorder numbers, the head of the own chain, and the pieces of chains above it.
    # A window reaches from p (exclusive) down to the node; a piece that begins above its window has no head yet.
    heavy = F.col("id") == F.col("heavy")
    piece = f"array<struct<head:{key.simpleString()},first:bigint,last:bigint>>"
    own = F.struct(none.alias("head"), F.lit(None).cast("long").alias("first"), (F.col("depth") - 1).alias("last"))
    starts = F.when(F.coalesce(heavy, F.lit(False)), None).otherwise(F.struct("id", "depth")).alias("head")
    state = cut(kin.join(light, "id", "left").select("id", "p", F.when(F.col("p").isNull(), 0).when(heavy, 1).otherwise(F.col("off")).cast("long").alias("enter"), starts, F.when(F.col("off").isNotNull(), F.array(own)).otherwise(F.array()).cast(piece).alias("pieces")))
    while (now := _look(state, limit)).open:
        ahead = state.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("enter").alias("e"), F.col("head").alias("h"), F.col("pieces").alias("above"))
        filled = F.transform("pieces", lambda x: F.struct(F.coalesce(x["head"], F.col("h.id")).alias("head"), F.coalesce(x["first"], F.col("h.depth")).alias("first"), x["last"].alias("last")))
        pieces = F.when(F.col("above").isNull(), F.col("pieces")).otherwise(F.concat("above", filled))
        step = cut(_towards(state, ahead, now.heavy, limit).select("id", F.col("q").alias("p"), (F.col("enter") + F.coalesce("e", F.lit(0))).alias("enter"), F.coalesce("head", "h").alias("head"), pieces.alias("pieces")))
        cut.drop(state)
        state = step
    last = F.struct(F.col("head.id").alias("head"), F.col("head.depth").alias("first"), F.col("depth").alias("last"))
    return sized.join(state.drop("p"), "id").select(
        "id", "parent", "root", "depth", (F.col("acc") - 1).alias("n_descendants"), "enter", (F.col("enter") + F.col("acc")).alias("leave"), F.col("head.id").alias("chain"), (F.col("depth") - F.col("head.depth")).alias("chain_pos"),
        F.concat("pieces", F.array(last)).cast(piece).alias("segments"), F.col("cycle").alias("cycle_id"), "on_cycle",
    )


def _path_blocks(tree: DataFrame) -> DataFrame:
    """``id, depth, at, ids``: the blocks of which each node's path consists, in the order of ``at``.

    Chains are cut into blocks of at most ``BLOCK`` nodes, and every piece of a path is joined with the blocks it touches, so
    a chain is never gathered whole; the first block of a large tree is on almost every path, hence the salts.
    """
    block = lambda c: F.floor(c / BLOCK)
    blocks = tree.groupBy(F.col("chain").alias("head"), block(F.col("depth")).alias("at")).agg(F.sort_array(F.collect_list(F.struct("depth", "id"))).alias("run"))
    pieces = tree.select("id", "depth", F.explode("segments").alias("s")).select("id", "depth", "s.*")
    pieces = pieces.withColumn("at", F.explode(F.sequence(block(F.col("first")), block(F.col("last")))))
    met = salted_left_join(pieces, blocks, ["head", "at"], F.col("id"))
    inside = F.filter("run", lambda x: x["depth"].between(F.col("first"), F.col("last")))
    return met.select("id", "depth", F.col("first"), "at", F.transform(inside, lambda x: x["id"]).alias("ids"))


def with_paths(tree: DataFrame) -> DataFrame:
    """The nodes of ``label_trees`` with ``path``, an array from the root to the node, concatenated from chain segments. All paths together are as long as all depths."""
    paths = _path_blocks(tree).groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first", "at", "ids"))), lambda x: x["ids"])).alias("path"))
    return tree.join(paths, "id")


def hierarchy(spark: SparkSession, links: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """Every node as in ``label_trees``, with its ``path`` from the root."""
    return with_paths(Cut(spark, "trees")(label_trees(spark, links, child, parent)))


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, levels``: all descendants of every node of a ``hierarchy`` or ``label_trees`` result, from the pieces of chains on each node's path."""
    above = _path_blocks(tree.select("id", "depth", "chain", "segments"))
    at = F.greatest(F.col("first"), F.col("at") * BLOCK)
    pairs = above.select(F.col("id").alias("descendant_id"), "depth", at.alias("base"), F.posexplode("ids").alias("i", "ancestor_id"))
    levels = (F.col("depth") - F.col("base") - F.col("i")).cast("long")
    return pairs.select("ancestor_id", "descendant_id", levels.alias("levels")).where("levels > 0")
