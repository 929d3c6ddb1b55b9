"""Aggregation and joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papyra.session import tasks

#: A key is heavy if it holds more rows than a task's fair share divided by this.
PIECES_A_TASK = 4


def fair_share(spark: SparkSession) -> float:
    """The share of all rows above which a key is heavy: it follows from the number of tasks, not from the size of the data."""
    return 1 / (PIECES_A_TASK * tasks(spark))


def heavy_keys(df: DataFrame, keys: list[str], share: float | None = None, counted: str | None = None) -> DataFrame:
    """The keys (null included) holding at least ``share`` of all rows (default ``fair_share``), with ``__salts``: into how many pieces of that share each is split.

    There are at most 1/share of them, and at most 2/share pieces in all, so what is broadcast and what is repeated is
    bounded by the number of tasks. Counted over all rows with map-side combining, or taken from ``df`` itself if it has
    one row per key with its count in ``counted``. An empty table has none.
    """
    share = share or fair_share(df.sparkSession)
    counts = df.select(*keys, F.col(counted).alias("__n")) if counted else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg((F.sum("__n") * F.lit(share)).alias("__piece"))
    return counts.join(F.broadcast(total), F.col("__n") >= F.col("__piece")).select(*keys, F.least(F.ceil(F.col("__n") / F.col("__piece")), F.lit(2**31 - 1)).cast("int").alias("__salts"))


def _marked(df: DataFrame, keys: list[str], heavy: DataFrame, salts: int | None, null_safe: bool) -> DataFrame:
    """``df`` with ``__salts`` of its heavy keys, null for others."""
    marks = heavy.select(*[F.col(k).alias(f"__h_{k}") for k in keys], (F.least("__salts", F.lit(salts)) if salts else F.col("__salts")).alias("__salts"))
    same = lambda k: F.col(k).eqNullSafe(F.col(f"__h_{k}")) if null_safe else F.col(k) == F.col(f"__h_{k}")
    return df.join(F.broadcast(marks), reduce(lambda a, b: a & b, map(same, keys)), "left").drop(*[f"__h_{k}" for k in keys])


def salted(df: DataFrame, keys: list[str], spread: Column, heavy: DataFrame, salts: int | None = None) -> DataFrame:
    """``df`` with column ``__salt``: a hash of ``spread`` in [0, the key's number of salts) for heavy keys, 0 for the others.

    The salt is a function of the row's content, not of a random generator, so a task that is run again after an executor
    is lost sends its rows to the same places. ``salts``: at most so many a key.
    """
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("int")
    return _marked(df, keys, heavy, salts, True).withColumn("__salt", salt).drop("__salts")


def key_statistics(df: DataFrame, keys: list[str], distinct: str, at: str, share: float | None = None, salts: int | None = None) -> DataFrame:
    """Per key: ``n_rows``, ``n_distinct`` values of ``distinct``, ``first_at`` and ``last_at`` of ``at``.

    Two-stage salted aggregation. Heavy keys get a salt made from ``distinct``, so equal values share a salt and the
    distinct counts of the salts add up; partial results per (key, salt) are then merged by key. Only the count of
    distinct values needs its own pass inside a salt: rows are first folded to one per (key, salt, value) on the map side.

    Nulls: a null key is a key of its own (drop it later if it is none); a null in ``distinct`` or ``at`` counts as a row
    and nothing else. Repeated rows count each time. Empty table: no rows. Other columns of ``df`` are never read.
    """
    narrow = df.select(*keys, F.col(distinct).alias("__d"), F.col(at).alias("__t"))
    rows = salted(narrow, keys, F.col("__d"), heavy_keys(narrow, keys, share), salts)
    per_value = rows.groupBy(*keys, "__salt", "__d").agg(F.count(F.lit(1)).alias("__n"), F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    per_salt = per_value.groupBy(*keys, "__salt").agg(
        F.sum("__n").alias("__n"), F.count("__d").alias("__d"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")
    )
    return per_salt.groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"), F.sum("__d").alias("n_distinct"), F.min("__lo").alias("first_at"), F.max("__hi").alias("last_at")
    )


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, share: float | None = None, salts: int | None = None, heavy: DataFrame | None = None, strategy: str = "merge") -> DataFrame:
    """Left outer join on ``keys`` whose heavy left keys are spread over tasks by their weight; both sides are shuffled, none broadcast.

    The right rows of a heavy key are repeated once per salt, all others once. Null keys match nothing and keep their left
    rows, as in SQL. ``right`` may hold several rows per key. ``heavy``: the heavy keys where they are known already.
    ``strategy``: ``merge`` sorts both sides; ``shuffle_hash`` hashes the right one, which must then have few rows a key.
    """
    heavy = heavy_keys(left.select(*keys), keys, share) if heavy is None else heavy
    a = salted(left, keys, spread, heavy, salts)
    b = _marked(right, keys, heavy, salts, False)
    b = b.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return a.join(b.hint(strategy), [*keys, "__salt"], "left").drop("__salt")
