"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut into ``cells`` equal arcs. Every shard holds ``virtual_nodes`` points on it; a row's key is hashed to a
cell and belongs to the first point clockwise. A shard takes no more rows than its bound; rows beyond it continue
clockwise to the next shard with room. Which rows go on is decided from the row counts of the cells alone (a table of
``cells`` rows, whatever the input), so that the rows themselves are ranked and placed in parallel.

Cases: null keys hash like any value; repeated rows are placed one by one (each has its own slot); a key that holds many
of the rows is ranked in as many parts as shuffles have (``lanes``) and overflows like any other; an empty table gives an empty result; extra
columns are kept unless they bear the name of a result column (``shard``, ``slot``), which then is replaced.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import materialize, utf8

CELLS, VIRTUAL_NODES = 4096, 64
_SEED = 71


def ring(spark: SparkSession, n_shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """The points of the ring as (cell, shard) in clockwise order; adding a shard leaves the points of the others."""
    points = spark.range(n_shards * virtual_nodes).select((F.col("id") / virtual_nodes).cast("int").alias("s"), (F.col("id") % virtual_nodes).cast("int").alias("v"))
    hashed = points.select(F.xxhash64(F.lit(_SEED + 1), "s", "v").alias("h"), "s").select(F.pmod("h", F.lit(cells)).cast("int").alias("cell"), "h", "s")
    return [(r.cell, r.s) for r in hashed.orderBy("cell", "h", "s").collect()]


def plan(counts: dict[int, int], points: list[tuple[int, int]], n_shards: int, slack: float = 0.0) -> list[dict]:
    """Which ranks of each cell go to which shard, and the slot of the first of them.

    ``slack`` 0 bounds the shards' counts at most one apart; otherwise a shard takes (1 + slack) times the mean at most.
    """
    total = sum(counts.values())
    if slack:
        bound = [-int(-total * (1 + slack) // n_shards)] * n_shards
    else:
        bound = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    load, cells_of_points, out = [0] * n_shards, [c for c, _ in points], []
    full: set[int] = {s for s in range(n_shards) if not bound[s]}
    for cell in sorted(counts):
        at, low, left = bisect_left(cells_of_points, cell), 0, counts[cell]
        while left:
            shard = points[at % len(points)][1]
            if shard not in full:
                take = min(left, bound[shard] - load[shard])
                out.append({"cell": cell, "low": low, "high": low + take, "shard": shard, "first_slot": load[shard]})
                load[shard] += take
                low, left = low + take, left - take
                if load[shard] == bound[shard]:
                    full.add(shard)
            at += 1
    return out


def assign(df: DataFrame, keys: list[str], n_shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS, lanes: int | None = None) -> DataFrame:
    """Every row with its ``shard`` and its ``slot`` there (from 0 without gaps)."""
    spark = df.sparkSession
    lanes = lanes or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in df.columns if c not in ("shard", "slot")]
    if df.columns.count("shard") > 1 or len(set(own)) < len(own):
        raise ValueError(f"ambiguous columns: {df.columns}")
    hashed = F.xxhash64(F.lit(_SEED), *[F.col(k) for k in keys])
    rows = df.select(F.struct(*own).alias("row"), hashed.alias("h"))
    rows = rows.select("row", "h", F.pmod("h", F.lit(cells)).cast("int").alias("cell"), (F.spark_partition_id() % lanes).alias("lane"))
    rows = materialize(rows, "ring-rows")  # lanes are read again below: they have to stay as they are
    sizes = rows.groupBy("cell", "lane").agg(F.count("*").alias("n"))
    counts = {r.cell: r.n for r in sizes.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    pieces = plan(counts, ring(spark, n_shards, virtual_nodes, cells), n_shards, slack)
    schema = "array<struct<cell:int,low:long,high:long,shard:int,first_slot:long>>"
    pieces = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(pieces)), schema)))
    before = Window.partitionBy("cell").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("cell", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("cell", "lane").orderBy("h", *[F.col(f"row.{k}") for k in keys])
    ranked = rows.withColumn("nth", F.row_number().over(order)).join(offsets, ["cell", "lane"]).withColumn("nth", F.col("nth") - 1 + F.col("before"))
    # at most cells + n_shards rows
    placed = ranked.join(F.broadcast(pieces), (ranked.cell == pieces.cell) & (ranked.nth >= pieces.low) & (ranked.nth < pieces.high))
    return placed.select("row.*", "shard", (F.col("first_slot") + F.col("nth") - F.col("low")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facts = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(utf8("text")).alias("text_crc32"))
    placed = assign(facts, ["doc_id"], 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
