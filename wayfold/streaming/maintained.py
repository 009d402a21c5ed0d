"""Counts that keep up with a table's changes.

A change feed tells of each row what it was and what it is: an insert has no before, a delete no after, an update both. A batch of the feed is
summed up to one difference for each group (a retraction takes one away), and the counts, a versioned table, take these differences in
one commit that carries the batch's number. A replayed batch finds its number there and changes nothing; a failed one leaves the counts as they
were, so the stream goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wayfold.operators.mutate import settled
from wayfold.sources import files, versions

_KEY = "_group"


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The feed that leads from one state of a table to another: before and after of each row that differs (keys are unique)."""
    old = before.select(F.col(key), F.struct(*before.columns).alias("before"))
    new = after.select(F.col(key), F.struct(*before.columns).alias("after"))
    return old.join(new, key, "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("before", "after")


def differences(feed: DataFrame, groups: list[str]) -> DataFrame:
    """groups and n: by how much the count of each group changes; groups whose changes cancel out are left out."""
    sides = F.array(F.struct(F.col("before").alias("row"), F.lit(-1).alias("n")), F.struct(F.col("after").alias("row"), F.lit(1).alias("n")))
    told = feed.select(F.explode(sides).alias("s")).where("s.row IS NOT NULL").select(*[F.col(f"s.row.{g}").alias(g) for g in groups], "s.n")
    return told.groupBy(*groups).agg(F.sum("n").alias("n")).where("n <> 0")


def _keyed(df: DataFrame, groups: list[str]) -> DataFrame:
    """With the group as one text, by which the counts are kept; null is a value of its own."""
    return df.withColumn(_KEY, F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}))


def start(spark: SparkSession, folder: str, rows: DataFrame, groups: list[str]) -> None:
    """The counts of a table as it is now."""
    versions.create(_keyed(rows.groupBy(*groups).agg(F.count("*").alias("n")), groups), folder, _KEY)


def apply(spark: SparkSession, folder: str, feed: DataFrame, groups: list[str], batch: str) -> int:
    """Take a batch of the feed into the counts, once whatever its number of runs: the version of the counts that has it."""
    number = versions.version(spark, folder)
    if batch in files.entry(spark, folder, number)["tokens"]:
        return number
    delta = settled(_keyed(differences(feed, groups), groups))  # a row for each group that changes
    held = versions.read(spark, folder, number).join(delta.select(_KEY), _KEY, "left_semi").select(_KEY, F.col("n").alias("_n"))
    new = delta.join(held, _KEY, "left").withColumn("n", F.col("n") + F.coalesce("_n", F.lit(0))).drop("_n")
    return versions.upsert(spark, folder, new.select(*versions.read(spark, folder, number).columns), token=batch, base=number)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts by group; groups without rows are left out."""
    return versions.read(spark, folder).where("n <> 0").drop(_KEY)


def keep(feed: DataFrame, folder: str, groups: list[str], name: str) -> DataStreamWriter:
    """A writer that takes a stream of changes into the counts; start it with a checkpoint of its own. ``name`` sets its batches apart from other streams'."""

    def take(batch: DataFrame, number: int) -> None:
        apply(batch.sparkSession, folder, batch, groups, f"{name}-{number}")

    once: Callable[[DataFrame, int], None] = take
    return feed.writeStream.foreachBatch(once)
