"""Text files read by ranges: every task reads ranges of bytes, and what a line needs to know of earlier ones travels as a summary of each range.

A range is what Spark makes of a file (``spark.sql.files.maxPartitionBytes``); lines belong to the range in which they begin. Rows inside a
range are looked at in order, ranges of a listing only through their summaries, a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from wayfold.operators.mutate import settled

#: Summaries, a row for each range, are broadcast up to so many.
BROADCAST_RANGES = 1 << 18


def _within() -> WindowSpec:
    """The lines of a range in order, up to and with the current one."""
    return Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)


def _earlier(*order: str) -> WindowSpec:
    """What stands before: earlier ranges of a listing, or (by "at") earlier lines of a range."""
    keys = ["file", "range"] if order == ("at",) else ["file"]
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def lines_of(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """file, range (part and first byte), at (order inside the range) and text of every line.

    A path is one listing, its files (if it is a folder, as Spark writes them) parts of it in the order of their names; unless
    ``whole``, each file is a listing of its own. Lines end with a line feed; a carriage return before it stays.
    """
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    part = F.col("_metadata.file_path")
    place = F.struct(part.alias("part"), F.col("_metadata.file_block_start").alias("first_byte"))
    return read.select((F.lit(path) if whole else part).alias("file"), place.alias("range"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a listing (without its end), empty if there is none: no more than a part or two is looked into."""
    for part in sorted(spark.read.option("recursiveFileLookup", True).text(path).inputFiles()):
        row = lines_of(spark, part).where("range.first_byte = 0").select("text").first()
        if row:
            return row.text.removesuffix("\r")
    return ""


def before(column: Column, order: str) -> Column:
    """The sum of a column over the earlier ranges of a listing (by "range") or lines of a range (by "at")."""
    return F.coalesce(F.sum(column).over(_earlier(order)), F.lit(0))


def with_summaries(lines: DataFrame, summaries: DataFrame) -> DataFrame:
    """The lines with the summary of their range."""
    few = summaries.count() <= BROADCAST_RANGES
    return lines.join(F.broadcast(summaries) if few else summaries, ["file", "range"])


def quoted_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """file, record (its number in the listing, from 0) and text of every record: a line feed inside quotes does not end one.

    Whether a range begins inside quotes is known once those before it are: each tells the parity of its quotes, and how many
    records would begin in it from either state; composed along the listing, that gives each range its state and first number.
    Only records of several lines are put together by a shuffle; a quote left open takes all that follows.
    """
    quotes = F.length("text") - F.length(F.replace("text", F.lit(quote), F.lit("")))
    told = settled(lines.withColumn("quotes", quotes).withColumn("odd", before(F.col("quotes"), "at") % 2))
    each = told.groupBy("file", "range").agg((F.sum("quotes") % 2).alias("parity"), F.count_if(F.col("odd") == 0).alias("outside"), F.count_if(F.col("odd") == 1).alias("inside"))
    begun = each.withColumn("state", before(F.col("parity"), "range") % 2).withColumn("begins", F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside")))
    summaries = begun.withColumn("first", before(F.col("begins"), "range")).select("file", "range", "state", "first")
    starts = (F.col("odd") + F.col("state")) % 2 == 0
    ends = (F.col("odd") + F.col("state") + F.col("quotes")) % 2 == 0
    marked = with_summaries(told, summaries).select("file", "range", "at", "text", "first", starts.alias("starts"), ends.alias("ends"))
    counted = marked.withColumn("record", F.col("first") + F.sum(F.col("starts").cast("int")).over(_within()) - 1)
    alone = counted.where("starts AND ends").select("file", "record", "text")
    parts = counted.where("NOT (starts AND ends)").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("range", "at", "text"))).alias("parts"))
    return alone.unionByName(parts.select("file", "record", F.array_join(F.transform("parts", lambda x: x.text), "\n").alias("text")))


def carried(lines: DataFrame, values: dict[str, Column], counts: dict[str, Column]) -> DataFrame:
    """The lines with the latest non-null value of some columns and the number of lines so far that meet some conditions, up to and with the line.

    A range's summary holds its last value of each column and its counts; composed along the listing, they are what the next ranges begin
    with.
    """
    told = settled(lines.withColumns(values | {c: condition.cast("int") for c, condition in counts.items()}))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in values]
    each = told.groupBy("file", "range").agg(*last, *[F.sum(c).alias(c) for c in counts])
    earlier, own = _earlier("range"), _within()
    held = each.select("file", "range", *[F.last(c, True).over(earlier).alias(f"_{c}") for c in values], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in counts])
    so_far = {c: F.coalesce(F.last(c, True).over(own), F.col(f"_{c}")) for c in values} | {c: F.col(f"_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in counts}
    return with_summaries(told, held).withColumns(so_far).drop(*[f"_{c}" for c in so_far])
