"""Deep pages of a long list: the list is sorted once into blocks, and a page reads the blocks that hold its rows.

``arrange`` writes the rows in sorted blocks with a small index: how many rows stand before each block. ``page`` finds the blocks of a page
number in the index and reads nothing else.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.sources import files

#: Rows of a block, a file of its own.
BLOCK = 1 << 16


def arrange(df: DataFrame, order: dict[str, bool], folder: str, block: int = BLOCK) -> None:
    """Sort the rows by columns (name: ascending) into the folder. Nothing is seen of a call that fails; a later call replaces the list."""
    spark, place = df.sparkSession, files.own_name(folder, "list")
    by = _order(order)
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sorted_.write.option("maxRecordsPerFile", block).parquet(place)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    told = spark.read.schema(schema).parquet(place).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), F.min(F.struct("_part", "_at")).alias("first"))
    blocks, before = [], 0
    for r in told.orderBy("first").collect():  # a row for each file, as in Spark's own file index
        blocks.append({"path": r.path, "before": before, "part": r.first._part, "at": r.first._at})
        before += r.rows
    files.commit(spark, folder, files.last_number(spark, folder) + 1, {"schema": schema.jsonValue(), "order": order, "blocks": blocks, "total": before})


def _order(order: dict[str, bool]) -> list[Column]:
    return [F.col(c) if ascending else F.col(c).desc() for c, ascending in order.items()]


def _read(spark: SparkSession, content: dict, chosen: list[dict]) -> DataFrame:
    """The rows of some blocks with their numbers: those of a range of the sort count on, so a row's own number needs no sorting."""
    schema = T.StructType.fromJson(content["schema"])
    if not chosen:
        return spark.createDataFrame([], schema).withColumn("nth", F.lit(0).cast("long"))
    rows = spark.read.schema(schema).parquet(*[b["path"] for b in chosen])
    starts = {b["part"]: b["before"] - b["at"] for b in chosen}  # what stands before a range
    first = F.create_map(*[F.lit(x) for part, before in starts.items() for x in (part, before)])
    return rows.withColumn("nth", (F.col("_at") + first[F.col("_part")] + 1).cast("long"))


def page(spark: SparkSession, folder: str, number: int, size: int) -> DataFrame:
    """A page (from 1) of the list, with row numbers, the total of rows and that of pages."""
    content = files.entry(spark, folder, files.last_number(spark, folder))
    size, number = max(size, 1), max(number, 1)
    low, high = (number - 1) * size, min(number * size, content["total"])
    befores = [b["before"] for b in content["blocks"]]
    chosen = content["blocks"][max(0, bisect_right(befores, low) - 1) : bisect_right(befores, high - 1)] if low < high else []
    rows = _read(spark, content, chosen).where((F.col("nth") > low) & (F.col("nth") <= high)).drop("_part", "_at")
    return rows.withColumns({"total": F.lit(content["total"]).cast("long"), "pages": F.lit(-(-content["total"] // size)).cast("long")})
