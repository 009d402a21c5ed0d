"""Checks of the data: columns, references, links, coordinates, constraints, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_gaps(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, T.StructType]) -> DataFrame:
    """A row for each expected column that a table lacks or has with another type."""
    rows = []
    for name, schema in sorted(expected.items()):
        held = {f.name: f.dataType.simpleString() for f in tables[name].schema} if name in tables else {}
        rows += [(name, f.name, f.dataType.simpleString(), held.get(f.name)) for f in schema if held.get(f.name) != f.dataType.simpleString()]
    return spark.createDataFrame(rows, "table string, column string, expected string, found string")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows break each check, in one pass; a check that is unknown for a row is not broken by it."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("rows")) for n in checks])
    return counts.select(F.inline(pairs))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Values of a key that must be unique, and how often they occur."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def cleared_links(df: DataFrame, role: str, links: dict[str, str]) -> DataFrame:
    """Links that do not go with the role set to null. ``links``: column and the role that may have it."""
    return df.withColumns({c: F.when(F.col(role) == r, F.col(c)) for c, r in links.items()})


def linked_by_others(users: DataFrame, link: str, value: object, but: list) -> DataFrame:
    """Users other than those named that are linked to an entity: while there are any, it stays."""
    return users.where((F.col(link) == value) & ~F.col("id").isin(but))


def health(checks: dict[str, DataFrame]) -> DataFrame:
    """A row for each table and whether it has a row; the whole is healthy if all have."""
    frames = [df.limit(1).agg((F.count("*") > 0).alias("ok")).select(F.lit(n).alias("check"), "ok") for n, df in checks.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table; no column is read."""
    frames = [df.agg(F.count("*").alias(n)) for n, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f)
    return out
