"""The most similar vectors of every vector: a block matrix join over int8 product tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from papyra.operators.skew import salted_left_join
from papyra.session import Cut, tasks

#: Rows a block holds on average. Groups of blocks are as many as a group has blocks, so both grow with the square root of the data.
ROWS_A_BLOCK = 256
#: Centres of groups are fitted on the driver on a sample of so many rows a group, those of blocks by the group's task on so many of its rows a block.
SAMPLE_A_CENTRE = 32
#: Every vector is compared with the blocks of its nearest centres: so many groups, and in each so many times as many blocks.
PROBES, BLOCKS_A_PROBE = 4, 2
#: Products are cut into tiles of so many rows.
TILE = 4096
#: Guests of a group are taken so many at a time.
GUESTS = 32_768
#: A digest of 16 bytes as two numbers, as it is stored and as it is computed with.
DIGEST, NATIVE = [("hi", ">u8"), ("lo", ">u8")], [("hi", "u8"), ("lo", "u8")]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_centres(x: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest centres of each row, whatever its length, the nearest first; in tiles, so memory is bounded whatever their number."""
    most, out = min(most, len(c)), []
    step = max(1, TILE * TILE // max(len(c), 1))
    for lo in range(0, len(x), step):
        near = unit(x[lo : lo + step]).astype(np.float32) @ c.T
        top = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < len(c) else np.tile(np.arange(len(c)), (len(near), 1))
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, most), np.int64)


def fit_centres(sample: np.ndarray, blocks: int, rounds: int = 6, seed: int = 17) -> np.ndarray:
    """Spherical k-means from random rows of the sample, so dense regions get many blocks."""
    rng = np.random.default_rng(seed)
    x = unit(sample).astype(np.float32)
    c = x[rng.choice(len(x), min(blocks, len(x)), replace=False)]
    for _ in range(rounds if len(c) > 1 else 0):
        near = nearest_centres(x, c, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        heads, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = c.copy()
        c[heads] = np.where(size > 0, sums / np.maximum(size, 1e-12), c[heads])
    return c


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and the length of what the codes miss."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def best_of(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of each ``i`` the ``k`` with the largest ``s`` (ties: smaller ``j``), each pair once: a bounded heap for every row, merged in bulk."""
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, s = i[fresh], j[fresh], s[fresh]
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    return i[rank < k], j[rank < k], s[rank < k]


def tile_pairs(q: np.ndarray, h: np.ndarray, k: int, least: float | None, same: bool, both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers in ``q`` and ``h`` and cosines of the ``k`` nearest rows of ``h`` for every row of ``q``; never more than ``k`` a row.

    Products of int8 codes (exact: sums below 2^24 in a float32 product) give every cosine up to a bound: with codes x', y'
    that miss x and y by r and s, |xy - x'y'| <= s + r (1 + s). Pairs whose upper bound reaches neither ``least`` nor the
    k-th best lower bound of their row are out; the rest is computed in float64, row by row where it is most of a row, and
    cut to the ``k`` best. ``same``: q is h, leave out the diagonal. ``both``: the ``k`` nearest rows of ``q`` for every row
    of ``h`` come too.
    """
    if both:
        i, j, s = tile_pairs(q, h, k, least, same)
        b, a, t = tile_pairs(h, q, k, least, same)
        return np.concatenate((i, a)), np.concatenate((j, b)), np.concatenate((s, t))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    (cq, sq, rq), (ch, sh, rh) = quantised(q), quantised(h)
    codes, miss = ch.astype(np.float32).T, rh.max()
    step = max(1, TILE * 256 // max(len(h), 1))
    for lo in range(0, len(q), step):
        rows = slice(lo, min(len(q), lo + step))
        near = (cq[rows].astype(np.float32) @ codes) * (sq[rows, None] * sh[None, :]).astype(np.float32)
        slack = (miss + rq[rows] * (1 + miss) + 1e-6).astype(np.float32)[:, None]
        if same:
            near[np.arange(len(near)), np.arange(rows.start, rows.stop)] = -4
        floor = np.full((len(near), 1), -3, np.float32)
        if len(h) > k:
            floor = np.maximum(floor, np.partition(near, -k, axis=1)[:, -k][:, None] - 2 * slack)
        if least is not None:
            floor = np.maximum(floor, np.float32(least) - slack)
        keep = near >= floor
        full = keep.sum(1) > 8 * k + len(h) // 8  # near-duplicates: cheaper as a product than pair by pair
        if full.any():
            r = np.flatnonzero(full)
            exact = np.where(keep[r], q[rows][r] @ h.T, -4)
            top = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            i, j, s = np.repeat(r, top.shape[1]), top.ravel(), np.take_along_axis(exact, top, 1).ravel()
            out.append((i[s > -4] + lo, j[s > -4], s[s > -4]))
            keep[r] = False
        i, j = np.nonzero(keep)
        i, j, s = best_of(i, j, np.einsum("ij,ij->i", q[rows][i], h[j]), k)
        out.append((i + lo, j, s))
    i, j, s = (np.concatenate(x) for x in zip(*out))
    return (i, j, s) if least is None else (i[s >= least], j[s >= least], s[s >= least])


class Group:
    """The residents of a group of blocks: which block each is in, and the best pairs so far of each."""

    def __init__(self, raw: np.ndarray, keys: np.ndarray, k: int, least: float | None, probes: int):
        n, self.k, self.least = len(raw), k, least
        blocks = -(-n // ROWS_A_BLOCK)
        some = np.random.default_rng(5).choice(n, min(n, SAMPLE_A_CENTRE * blocks), replace=False)
        self.centres, self.probes = fit_centres(raw[some], blocks), probes
        near = nearest_centres(raw, self.centres, probes)
        order = np.argsort(near[:, 0], kind="stable")
        self.raw, self.keys, self.near = raw[order], keys[order], near[order]
        self.edges = np.searchsorted(self.near[:, 0], np.arange(len(self.centres) + 1))
        self.best: list[tuple] = []

    def meet(self, q: np.ndarray, near: np.ndarray, own: bool) -> tuple[tuple, tuple]:
        """The best residents of each row of ``q``, and the best rows of ``q`` of each resident, in the blocks that ``near`` names. ``own``: q are the residents."""
        k, there, back = self.k, [], []
        order = np.argsort(near.ravel(), kind="stable")
        block, row = near.ravel()[order], order // near.shape[1]
        for b, at in zip(*np.unique(block, return_index=True)):
            rows = row[at : np.searchsorted(block, b, "right")]
            for lo in range(self.edges[b], self.edges[b + 1], TILE):
                h = unit(self.raw[lo : min(lo + TILE, self.edges[b + 1])])
                for first in range(0, len(rows), TILE):
                    r = rows[first : first + TILE]
                    x = unit(q[r])
                    if own:  # a resident is not its own neighbour
                        i, j, s = tile_pairs(x, h, k + 1, self.least, False)
                        i, j, s = best_of(*(z[r[i] != j + lo] for z in (i, j, s)), k)
                        there.append((r[i], j + lo, s))
                        continue
                    i, j, s = tile_pairs(x, h, k, self.least, False)
                    there.append((r[i], j + lo, s))
                    j, i, s = tile_pairs(h, x, k, self.least, False)
                    back.append((j + lo, r[i], s))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return tuple(best_of(*(np.concatenate(x) for x in zip(*(rows or [none]))), k) for rows in (there, back))

    def residents(self) -> None:
        (i, j, s), _ = self.meet(self.raw, self.near, True)
        self.best.append((np.concatenate((i, j)), self.keys[np.concatenate((j, i))], np.concatenate((s, s))))

    def guests(self, raw: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(guest key, resident key, cosine) of the best residents of each guest; the residents remember their best guests."""
        (i, j, s), (a, b, t) = self.meet(raw, nearest_centres(raw, self.centres, self.probes), False)
        self.best.append((a, keys[b], t))
        self.best = [self.merged()]
        return keys[i], self.keys[j], s

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, other, s = (np.concatenate(x) for x in zip(*self.best))
        names, number = np.unique(other, return_inverse=True)
        i, j, s = best_of(i, number, s, self.k)
        return i, names[j], s

    def out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, other, s = self.merged()
        return self.keys[i], other, s


def usable(v: str, width: int):
    """A vector of the right length, without nulls, NaN or infinite elements, not all zero."""
    return F.expr(f"size({v}) = {width} and not exists({v}, x -> x is null or isnan(x) or abs(x) = float('inf')) and exists({v}, x -> x != 0)")


def nearest_vectors(spark: SparkSession, rows: DataFrame, key: str, vector: str, k: int, width: int, least: float | None = None, at: str | None = None, probes: int | None = PROBES) -> DataFrame:
    """``key_a, key_b, similarity``: for every ``key`` the ``k`` others of the highest cosine similarity (ties: smaller key).

    A key has one vector: of several rows, the usable one with the latest ``at`` (ties: the larger digest). Unusable vectors
    (see ``usable``) are none. With ``least``, pairs below it are left out.

    Rows of the same vector are one class, so a class of copies costs as much as one row; classes are expanded at the end,
    never to all pairs. Centres are fitted on two levels. Those of groups, on the driver, on a bounded sample; every class is
    a resident of its nearest group and a guest of the next ``probes`` - 1. Those of blocks, by the task of a group, on its
    residents: every class is multiplied with the ``BLOCKS_A_PROBE * probes`` nearest blocks of each group it is in, in int8 tiles. There are
    about as many groups as blocks in a group, so blocks keep their size whatever the number of rows. Of every tile, block
    and group only the ``k`` best of each row are kept; groups that the sample shows to be large are split over tasks. What
    is lost are neighbours that share no block; with ``probes`` None every block of every group is met, and the result is
    exact.
    """
    cut = Cut(spark, "neighbours")
    good = rows.where(usable(vector, width)).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"), F.col(at or key).alias("at")).where("id is not null")
    digest = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), "v")), 16, "0") for seed in (1, 2)]))
    good = good.withColumn("cls", digest)
    last = good.groupBy("id").agg(F.max(F.struct("at", "cls")).alias("x")).select("id", F.col("x.cls").alias("cls"))
    members = cut(last)
    once = Window.partitionBy("cls").orderBy("at")
    vectors = cut(good.select("cls", "v", "at").withColumn("n", F.row_number().over(once)).where("n = 1").join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "v"))

    n = vectors.count()
    groups = max(1, math.ceil(math.sqrt(n / ROWS_A_BLOCK)))
    wanted = SAMPLE_A_CENTRE * groups
    drawn = vectors.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / max(n, 1)) * (1 << 30)) + 1)).select("v").limit(2 * wanted).toArrow()
    if drawn.num_rows == 0:
        kind = rows.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"key_a {kind}, key_b {kind}, similarity double")
    sample = matrix(drawn["v"], width)
    centres = fit_centres(sample, groups)
    weight = np.bincount(nearest_centres(sample, centres, 1)[:, 0], minlength=len(centres)) / len(sample)
    split = np.maximum(1, np.ceil(weight * len(centres) / 4)).astype(np.int64)
    shared = spark.sparkContext.broadcast((centres, split))
    schema = pa.schema([("tile", pa.int64()), ("guest", pa.bool_()), ("cls", pa.binary()), ("v", pa.list_(pa.float32()))])
    visits = probes or len(centres)
    inner = BLOCKS_A_PROBE * probes if probes else 1 << 40

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, parts = shared.value
        base = np.cumsum(parts) - parts
        for whole in batches:
            for b in (whole.slice(lo, TILE) for lo in range(0, whole.num_rows, TILE)):
                raw = matrix(b["v"], width)
                top = nearest_centres(raw, c, visits)
                home = top[:, 0]
                mine = np.frombuffer(b"".join(x[:4] for x in b["cls"].to_pylist()), np.uint32) % parts[home]
                row, tile, guest = [np.arange(len(raw))], [base[home] + mine], [np.zeros(len(raw), bool)]
                for j in range(top.shape[1]):
                    for s in range(int(parts[top[:, j]].max())):
                        r = np.flatnonzero((parts[top[:, j]] > s) & ~((top[:, j] == home) & (mine == s)))
                        row.append(r)
                        tile.append(base[top[r, j]] + s)
                        guest.append(np.ones(len(r), bool))
                row = np.concatenate(row)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * width), pa.array(raw[row].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tile).astype(np.int64)), pa.array(np.concatenate(guest)), b["cls"].take(pa.array(row)), flat], schema=schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in a.astype(DIGEST)], pa.binary()), pa.array([x.tobytes() for x in b.astype(DIGEST)], pa.binary()), pa.array(s)], names=["a", "b", "s"])

        def names(parts: list) -> np.ndarray:
            """Digests as pairs of numbers, which sort as the digests do."""
            return np.frombuffer(b"".join(x for p in parts for x in p.to_pylist()), DIGEST).astype(NATIVE)

        tile, group, held, waiting, size = None, None, [], [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            """The residents are complete, or so many guests wait that they are met."""
            nonlocal group, held, waiting, size
            if group is None and held:
                group = Group(np.concatenate([x for x, _ in held]), names([c for _, c in held]), k, least, inner)
                group.residents()
                held = []
            if waiting and group is not None:
                yield sent(*group.guests(np.concatenate([x for x, _ in waiting]), names([c for _, c in waiting])))
            waiting, size = [], 0

        for b in batches:
            tiles, guests = b["tile"].to_numpy(zero_copy_only=False), b["guest"].to_numpy(zero_copy_only=False)
            x, ck = matrix(b["v"], width), b["cls"]
            edges = np.flatnonzero(np.concatenate(([True], (tiles[1:] != tiles[:-1]) | (guests[1:] != guests[:-1]), [True])))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if tiles[lo] != tile:
                    yield from settle()
                    if group is not None:
                        yield sent(*group.out())
                    tile, group, held = tiles[lo], None, []
                if not guests[lo]:
                    held.append((x[lo:hi].copy(), ck[lo:hi]))
                elif held or group is not None:
                    waiting.append((x[lo:hi].copy(), ck[lo:hi]))
                    size += hi - lo
                    if size >= GUESTS:
                        yield from settle()
        yield from settle()
        if group is not None:
            yield sent(*group.out())

    placed = vectors.mapInArrow(place, "tile long, guest boolean, cls binary, v array<float>")
    tiles = placed.repartition(tasks(spark), "tile").sortWithinPartitions("tile", "guest")
    close_pairs = tiles.mapInArrow(multiply, "a binary, b binary, s double")
    best = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    merged = cut(close_pairs.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("a", "b", "s"))

    # classes to keys: no key needs more than the first k + 1 members of any class
    order = Window.partitionBy("cls").orderBy("id")
    first = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select(F.col("cls").alias("b"), "id")
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("s"))
    named = salted_left_join(merged.unionByName(copies), first, ["b"], F.col("a"))
    listed = named.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.col("s").desc(), "id"))).where(F.col("n") <= k + 1)
    pairs = salted_left_join(members.select(F.col("cls").alias("a"), F.col("id").alias("key_a")), listed.select("a", F.col("id").alias("key_b"), "s"), ["a"], F.col("key_a")).where("key_a != key_b")
    ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy("key_a").orderBy(F.col("s").desc(), "key_b"))).where(F.col("n") <= k)
    return ranked.select("key_a", "key_b", F.col("s").alias("similarity"))
