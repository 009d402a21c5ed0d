"""All facets of a screen from one bitmap index.

Rows get places (block of 32 768, bit); for each block, facet and value a bitmap holds the rows with the value. Whatever is chosen, the rows of a
facet's value under the choices are the bits that its bitmap and those of the choices have in common, so one pass over the bitmaps gives every
facet's counts, and says which choices are no longer offered. The table itself is read once, when the index is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import present
from wayfold.operators.mutate import settled

#: Facet of the bitmap that has every row of a block.
EVERY = ""


def _values(df: DataFrame, column: str) -> Column:
    """The values of a row as texts: of an array its distinct elements, else the one value; empty ones are no value."""
    value = F.col(column)
    many = F.transform(value, lambda x: x.cast("string")) if dict(df.dtypes)[column].startswith("array") else F.array(value.cast("string"))
    return F.array_distinct(F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: present(x).isNotNull()))


def _pairs(facet: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value")))


def index(df: DataFrame, facets: list[str]) -> DataFrame:
    """block, facet, value and bits: for each value of the columns named (arrays: of an element) in each block of rows.

    Rows are not sorted or numbered in one place: each task counts its own. The result is settled in the shared folder; keep it
    (``write.parquet``) to answer later screens without the table.
    """
    row = F.monotonically_increasing_id()
    pairs = [_pairs(f, _values(df, f)) for f in facets]
    every = F.array(F.struct(F.lit(EVERY).alias("facet"), F.lit("").alias("value")))
    told = df.select(row.alias("row"), F.concat(every, *pairs).alias("pairs")).select("row", F.inline("pairs"))
    made = told.groupBy(F.bitmap_bucket_number("row").alias("block"), "facet", "value").agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
    return settled(made)


def counts(index: DataFrame, choices: dict[str, str | None], under: dict[str, list[str]]) -> DataFrame:
    """facet, value, n, chosen and kept: every value of every facet with its rows under the choices of the facets that rule it.

    ``under``: for a facet those whose choices its values are counted under (none: all rows count). Choices that are None or empty rule nothing. A
    value without rows has n 0: it is not offered; a choice is ``kept`` while it is offered, and a choice that no row has gets a row too.
    """
    spark, made = index.sparkSession, {f: v for f, v in choices.items() if v}
    rules = [(f, g, made[g], sum(h in made for h in gs)) for f, gs in under.items() for g in gs if g in made]  # a few dozen
    own = index.where(F.col("facet") != EVERY)
    if rules:
        ruled = F.broadcast(spark.createDataFrame(rules, "ruled string, facet string, value string, rulers int"))
        masks = index.join(ruled, ["facet", "value"]).groupBy("block", F.col("ruled").alias("facet")).agg(F.bitmap_and_agg("bits").alias("mask"), F.count("*").alias("here"), F.max("rulers").alias("rulers"))
        held = own.join(masks, ["block", "facet"], "left").withColumn("free", ~F.col("facet").isin([r[0] for r in rules]))
        # a block where a choice has no row at all holds nothing under it
        met = held.withColumn("pair", F.when(F.col("free"), F.array("bits")).when(F.col("here") == F.col("rulers"), F.array("bits", "mask")).otherwise(F.array(F.lit(b""))))
        own = met.select("block", "facet", "value", F.explode("pair").alias("bits")).groupBy("block", "facet", "value").agg(F.bitmap_and_agg("bits").alias("bits"), F.min(F.length("bits")).alias("least")).withColumn("bits", F.when(F.col("least") > 0, F.col("bits")))
    sums = own.groupBy("facet", "value").agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
    if not made:
        return sums.withColumns({"chosen": F.lit(False), "kept": F.lit(False)})
    chosen = F.broadcast(spark.createDataFrame(list(made.items()), "facet string, value string").withColumn("chosen", F.lit(True)))
    missing = chosen.join(sums, ["facet", "value"], "left_anti").select("facet", "value", F.lit(0).cast("long").alias("n"), "chosen")
    told = sums.join(chosen, ["facet", "value"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))).unionByName(missing)
    return told.withColumn("kept", F.col("chosen") & (F.col("n") > 0))
