"""Substring search by a kept index of trigrams.

``add`` writes rows in blocks of ``BLOCK`` and, for each run of three letters and block, which rows of the block hold the run in their searched text;
later calls add generations beside the earlier ones and touch nothing that is there. A search takes the posting lists of the query's runs, keeps
the blocks in which some row has all of them, reads those blocks only, and applies the search's own condition to their rows, so it returns
the rows that the condition alone would. A query shorter than a run reads all blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.sources import files

#: Rows of a block, a folder of its own; blocks that a search names one by one (more are met by a join).
BLOCK, NAMED = 1 << 15, 4096
_GRAM = 3


def haystack(columns: list[str], arrays: list[str] = ()) -> Column:
    """The texts that a search over several columns looks into, in lower case; no run of letters goes from one into the next."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns] + [F.coalesce(F.array_join(a, "\n"), F.lit("")) for a in arrays]
    return F.lower(F.concat_ws("\n", *texts))


def add(df: DataFrame, folder: str, text: Column, block: int = BLOCK) -> None:
    """Index the rows by ``text`` (lower case) under the folder, beside what it holds. Nothing is seen of a call that fails."""
    spark, place = df.sparkSession, files.own_name(folder, "generation")
    task, nth = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))  # rows of a task count from 0
    placed = df.select("*", text.alias("_text"), F.monotonically_increasing_id().alias("_row")).withColumns({"_block": F.concat_ws("-", task.cast("string"), F.floor(nth / block).cast("string")), "_at": (nth % block).cast("int")})
    placed.drop("_row").write.partitionBy("_block").parquet(f"{place}/rows")
    held = spark.read.schema(placed.drop("_row").schema).parquet(f"{place}/rows").where(F.length("_text") >= _GRAM)
    runs = F.transform(F.sequence(F.lit(1), F.length("_text") - _GRAM + 1), lambda i: F.substring(F.col("_text"), i, F.lit(_GRAM)))
    grams = held.select("_block", "_at", F.explode(F.array_distinct(runs)).alias("gram"))
    posted = grams.groupBy("gram", "_block").agg(F.array_sort(F.collect_list("_at")).alias("rows"))  # as many as a block has at most
    posted.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{place}/grams")
    while True:
        number = files.last_number(spark, folder)
        held_before = files.entry(spark, folder, number)["generations"] if number else []
        try:
            return files.commit(spark, folder, number + 1, {"generations": [*held_before, {"path": place, "schema": placed.drop("_row").schema.jsonValue()}]})
        except files.Conflict:  # generations are independent: this one goes behind the other
            continue


def candidates(spark: SparkSession, place: str, query: str) -> DataFrame:
    """The blocks of a generation in which some row has all runs of the query, and how many rows there have."""
    grams = sorted({query[i : i + _GRAM] for i in range(len(query) - _GRAM + 1)})
    lists = spark.read.schema("gram string, _block string, rows array<int>").parquet(f"{place}/grams").where(F.col("gram").isin(grams))
    met = lists.groupBy("_block").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(grams))
    common = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), F.array_intersect)
    return met.select("_block", F.size(common).alias("n")).where("n > 0")


def search(spark: SparkSession, folder: str, query: str, condition: Column) -> DataFrame:
    """The indexed rows that meet the condition, which implies that their searched text contains the query (any case)."""
    sought, number = query.lower(), files.last_number(spark, folder)
    if not number:
        raise ValueError(f"{folder} holds no index")
    found = []
    for made in files.entry(spark, folder, number)["generations"]:
        rows = spark.read.schema(T.StructType.fromJson(made["schema"])).parquet(f"{made['path']}/rows")
        if len(sought) >= _GRAM:
            blocks = candidates(spark, made["path"], sought).select("_block")
            named = [r[0] for r in blocks.limit(NAMED + 1).collect()]
            rows = rows.where(F.col("_block").isin(named)) if len(named) <= NAMED else rows.join(blocks, "_block", "left_semi")
        found.append(rows.where(condition).drop("_text", "_block", "_at"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
