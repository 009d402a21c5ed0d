"""The nearest places for every row of a table of points.

Places are points on a sphere in space, so neither the poles nor the date line are special. Along a space-filling curve they are cut into blocks
of bounded size; a directory has the box of each block. A point first meets a block near to it, which gives a bound on its k-th distance; then
every block whose box is within that bound, and with those the k nearest are proved. No point meets all places, wherever they crowd.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.operators.mutate import settled

#: Places of a block, at least, and blocks at most: the directory is sent to every task. Boxes of so many blocks are looked at first.
BLOCK, DIRECTORY, SHELF = 256, 1 << 16, 64
#: Miles are rounded; a box that seems this much too far is looked into all the same.
_SLACK = 1e-4


def _in_space(lat: str, lng: str) -> dict[str, Column]:
    north, east = F.radians(lat), F.radians(lng)
    return {"_x": F.cos(north) * F.cos(east), "_y": F.cos(north) * F.sin(east), "_z": F.sin(north)}


def _along_curve() -> Column:
    """The place of (_x, _y, _z) on a Z-order curve: 20 bits of each coordinate, interleaved."""
    code = F.lit(0).cast("long")
    for i, c in enumerate(("_x", "_y", "_z")):
        bits = F.least(F.floor((F.col(c) + 1) / 2 * (1 << 20)), F.lit((1 << 20) - 1)).cast("long")
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        code = code.bitwiseOR(F.shiftleft(bits, i))
    return code


def _usable(df: DataFrame) -> DataFrame:
    fine = lambda c, most: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= most)
    return df.where(fine("lat", 90) & fine("lng", 1e6))


def nearest_to_each(points: DataFrame, places: DataFrame, k: int, key: str = "point", order: list[str] = ("id",)) -> DataFrame:
    """The k nearest places for each point: its ``key``, nth (from 1), miles, and the places' columns but their coordinates.

    Both have lat and lng in degrees; rows without (null, not a number, beyond the poles) take no part. Ties go by ``order``. Points with equal
    coordinates are one while it matters, of places with equal coordinates only the first k.
    """
    order = list(order)
    place = F.struct(*[c for c in places.columns if c not in ("lat", "lng")])
    first = Window.partitionBy("lat", "lng").orderBy(*order)
    held = _usable(places).select("lat", "lng", *order, place.alias("_place")).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k)
    coded = held.withColumns(_in_space("lat", "lng")).withColumn("_code", _along_curve())
    at = F.monotonically_increasing_id()  # counts from 0 in each range
    ranged = settled(coded.repartitionByRange("_code").sortWithinPartitions("_code").withColumn("_at", at).drop("_code", "_nth"))
    size = max(BLOCK, k, -(-ranged.count() // DIRECTORY) * 2)
    block = (F.shiftright("_at", 33) * (1 << 33) + F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / size)).cast("long")
    blocks = ranged.withColumn("_block", block)
    box = [f(c).alias(f"{side}{c}") for c in ("_x", "_y", "_z") for side, f in (("low", F.min), ("high", F.max))]
    directory = blocks.groupBy("_block").agg(*box).orderBy("_block").collect()  # DIRECTORY rows, and one for each range, at most
    asked = settled(_usable(points).select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).distinct().withColumns(_in_space("_lat", "_lng")))
    if not directory:
        return points.select(key).where("false").select(key, F.lit(0).alias("nth"), F.lit(0.0).alias("miles"), *[F.lit(None).cast(places.schema[c].dataType).alias(c) for c in places.columns if c not in ("lat", "lng")])
    numbers = [r["_block"] for r in directory]
    lows, highs = ([[r[f"{side}{c}"] for c in ("_x", "_y", "_z")] for r in directory] for side in ("low", "high"))

    def routed(batches: Iterator) -> Iterator:
        """Each point with a block near it, or (with a bound) with all others that the bound reaches."""
        import numpy as np
        import pyarrow as pa

        low, high, names = np.array(lows), np.array(highs), np.array(numbers, dtype=np.int64)
        shelves = np.arange(0, len(names), SHELF)
        shelf_low, shelf_high = np.minimum.reduceat(low, shelves), np.maximum.reduceat(high, shelves)

        def away(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return np.sqrt((np.maximum(np.maximum(low - x, x - high), 0) ** 2).sum(axis=1))

        for batch in batches:
            out: list[tuple] = []
            x = np.stack([np.asarray(batch.column(c)) for c in ("_x", "_y", "_z")], axis=1)
            bounds = np.asarray(batch.column("bound").fill_null(np.inf)) if "bound" in batch.schema.names else None
            for row in range(len(x)):
                far = away(x[row], shelf_low, shelf_high)
                at = int(far.argmin()) * SHELF
                first = at + int(away(x[row], low[at : at + SHELF], high[at : at + SHELF]).argmin())
                if bounds is None:
                    out.append((row, first))
                    continue
                chord = 2 * np.sin(min(np.pi / 2, (bounds[row] + _SLACK) / (2 * geo.EARTH_MILES))) + 1e-9 if np.isfinite(bounds[row]) else np.inf
                for at in np.flatnonzero(far <= chord) * SHELF:
                    out += [(row, at + b) for b in np.flatnonzero(away(x[row], low[at : at + SHELF], high[at : at + SHELF]) <= chord) if at + b != first]
            rows = pa.array([r for r, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_lat").take(rows), batch.column("_lng").take(rows), pa.array(names[[b for _, b in out]] if out else [], pa.int64())], ["_lat", "_lng", "_block"])

    def met(routes: DataFrame) -> DataFrame:
        """The k nearest of each point among the places of its blocks."""
        pairs = routes.mapInArrow(routed, "_lat double, _lng double, _block long").join(blocks.select("_block", "lat", "lng", *order, "_place"), "_block")
        away = pairs.select("_lat", "_lng", geo.miles(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng")).alias("miles"), *order, "_place")
        return _first(away, k, order)

    near = settled(met(asked))
    bound = near.groupBy("_lat", "_lng").agg(F.when(F.count("*") >= k, F.max("miles")).alias("bound"))
    far = met(asked.join(bound, ["_lat", "_lng"], "left"))
    found = _first(near.unionByName(far).select("_lat", "_lng", "miles", *order, "_place"), k, order)
    told = points.select(key, F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).join(found, ["_lat", "_lng"])
    return told.select(key, "nth", "miles", "_place.*")


def _first(pairs: DataFrame, k: int, order: list[str]) -> DataFrame:
    best = Window.partitionBy("_lat", "_lng").orderBy("miles", *order)
    return pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
