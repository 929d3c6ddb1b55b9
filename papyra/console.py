"""A guarded SQL console."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Statements that only read.
READING = ("select", "with", "show", "describe", "desc", "explain", "values", "table", "from")


def without_comments(statement: str, literals: str | None = None) -> str:
    """The statement without comments. What stands in quotes is no comment; ``literals`` replaces it, if given."""
    quoted = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`"""
    keep = (lambda m: m[0] if m[1] and literals is None else literals if m[1] else " ")
    return re.sub(rf"(?s)({quoted})|/\*.*?\*/|--[^\n]*", keep, statement).strip()


def run_sql(spark: SparkSession, statement: str, read_only: bool = True, limit: int | None = 1000, args: dict | None = None) -> DataFrame:
    """The result of one statement. ``read_only`` refuses anything that is no query (ValueError); ``limit`` bounds the rows of queries, None leaves them whole."""
    plain = without_comments(statement, literals="''").rstrip(";").strip()
    if not plain:
        raise ValueError("no statement")
    kind = re.match(r"[(\s]*(\w+)", plain)
    reads = bool(kind) and kind[1].lower() in READING
    hidden_write = bool(re.search(r"(?is)\binsert\s+(into|overwrite)\b", plain))
    if read_only and (not reads or hidden_write):
        raise ValueError("only queries are allowed here")
    out = spark.sql(without_comments(statement).rstrip(";").strip(), args=args or {})
    return out.limit(limit) if reads and limit is not None and kind[1].lower() in ("select", "with", "values", "table", "from") else out


def list_databases(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def use_database(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def describe_tables(spark: SparkSession, schema: str) -> DataFrame:
    """``name, column, type`` of every column of a schema's tables."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(schema) for c in spark.catalog.listColumns(f"{schema}.{t.name}")]
    return spark.createDataFrame(rows, "name string, column string, type string")
