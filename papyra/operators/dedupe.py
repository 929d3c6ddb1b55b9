"""One row per key, by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from papyra.functions.text import evidence_rank


def one_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in ``order``, which must be total. Spark prunes to one row per key before the shuffle, so a hot key is no problem."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def best_evidence(df: DataFrame, pair: list[str], code: str, position: str) -> DataFrame:
    """One row per pair: the code of the best rank; of equal ranks the row that came first."""
    return one_per_key(df, pair, evidence_rank(F.col(code)), F.col(position))


def evidence_accounting(df: DataFrame, pair: list[str], resolved: str | None = None) -> DataFrame:
    """One row: ``rows_considered``, ``dropped_unresolved`` (null in ``resolved``, decided first) and ``dropped_duplicate``."""
    ok = F.col(resolved).isNotNull() if resolved else F.lit(True)
    per_pair = df.withColumn("__ok", ok).groupBy(*pair, "__ok").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    lost = F.coalesce(F.sum(F.when(~F.col("__ok"), F.col("n"))), F.lit(0))
    kept = F.count_if(F.col("__ok"))
    return per_pair.agg(total.alias("rows_considered"), lost.alias("dropped_unresolved"), (total - lost - kept).alias("dropped_duplicate"))
