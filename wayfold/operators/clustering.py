"""Clusters of a map: markers that would overlap on the screen are drawn as one.

From the finest zoom to the one shown, the clusters of a zoom are the markers of the next coarser one. On a zoom the markers are taken in an
order of their own (a hash, so that chains stay short): one that has no earlier cluster's middle within the radius is the middle of a new
cluster, any other joins the earliest such cluster. That is the plain greedy rule, run in rounds: whatever has no undecided earlier
neighbour is decided. Neighbours meet by cells as wide as the radius and those around them, so borders of cells cut no cluster; and as
middles are never closer than the radius of the finer zoom, a marker has few neighbours, however many places stand in one spot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.mutate import settled

#: Pixels within which markers are one cluster, of a tile's side, and how much finer places are put together at the finest zoom.
RADIUS, TILE, GRAIN = 60, 256, 8
#: Beyond this latitude the map has no place.
_EDGE = 85.0511287798


def pixels(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Where a place stands on the map of a zoom."""
    side = float(TILE << zoom)
    north = F.radians(F.greatest(F.least(lat, F.lit(_EDGE)), F.lit(-_EDGE)))
    return (lng + 180) / 360 * side, (F.lit(0.5) - F.log(F.tan(math.pi / 4 + north / 2)) / (2 * math.pi)) * side


def _neighbours(items: DataFrame, radius: float) -> DataFrame:
    """(later, earlier): pairs of markers (_order, x, y) within the radius of each other."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    own = items.select(F.col("_order").alias("later"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    own = own.select("later", "ax", "ay", around("cx").alias("cx"), "cy").select("later", "ax", "ay", "cx", around("cy").alias("cy"))
    others = items.select(F.col("_order").alias("earlier"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = own.join(others, ["cx", "cy"]).where((F.col("earlier") < F.col("later")) & (F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2)) <= radius * radius))
    return near.select("later", "earlier")


def _joined(items: DataFrame, radius: float) -> DataFrame:
    """(_order, middle): the cluster of every marker, by the order of its middle."""
    pairs = settled(_neighbours(items, radius))
    open_, middles = items.select("_order"), None
    left = pairs
    while True:
        # no undecided earlier neighbour: a middle, for those near a middle were taken out
        new = settled(open_.join(left.select(F.col("later").alias("_order")).distinct(), "_order", "left_anti"))
        middles = new if middles is None else middles.unionByName(new)
        if left.isEmpty():
            break
        taken = pairs.join(new.withColumnRenamed("_order", "earlier"), "earlier", "left_semi").select(F.col("later").alias("_order")).distinct()
        open_ = settled(open_.join(new, "_order", "left_anti").join(taken, "_order", "left_anti"))
        names = open_.select("_order")
        left = settled(left.join(names.withColumnRenamed("_order", "later"), "later", "left_semi").join(names.withColumnRenamed("_order", "earlier"), "earlier", "left_semi"))
    first = pairs.join(middles.withColumnRenamed("_order", "earlier"), "earlier", "left_semi").groupBy(F.col("later").alias("_order")).agg(F.min("earlier").alias("middle"))
    return settled(items.select("_order").join(first, "_order", "left").select("_order", F.coalesce("middle", "_order").alias("middle")))


def screen_clusters(places: DataFrame, zoom: int, finest: int, key: list[str] = ("kind", "id"), radius: float = RADIUS) -> DataFrame:
    """The clusters at a zoom: lat, lng and key of the middle, how many places, clinics and lawyers, and the size class.

    ``finest``: the zoom from which clusters are built up; there, places in one cell of a ``GRAIN``-th of the radius are one marker. Places without
    coordinates (null, or not a number) take no part; of places equal in key one is enough; an empty table has no clusters.
    """
    key = list(key)
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    order = F.struct(F.xxhash64(*key).alias("hash"), *key).alias("_order")
    rows = places.where(fine("lat") & fine("lng")).dropDuplicates(key).select(order, "lat", "lng", F.lit(1).cast("long").alias("places"), *[(F.col("kind") == k).cast("long").alias(n) for k, n in (("clinic", "clinics"), ("lawyer", "lawyers"))])
    sums = [F.sum(c).alias(c) for c in ("places", "clinics", "lawyers")]
    at = [F.min_by(c, "_order").alias(c) for c in ("lat", "lng")]
    x, y = pixels(F.col("lat"), F.col("lng"), finest)
    grain = radius / GRAIN
    items = settled(rows.groupBy(F.floor(x / grain).alias("gx"), F.floor(y / grain).alias("gy")).agg(F.min("_order").alias("_order"), *at, *sums).drop("gx", "gy"))
    for level in range(finest, zoom - 1, -1):
        x, y = pixels(F.col("lat"), F.col("lng"), level)
        middles = _joined(items.select("_order", x.alias("x"), y.alias("y")), radius)
        grown = items.join(middles, "_order").groupBy("middle").agg(*[F.min_by(c, F.when(F.col("_order") == F.col("middle"), F.col("_order"))).alias(c) for c in ("lat", "lng")], *sums)
        items = settled(grown.withColumnRenamed("middle", "_order"))
    return items.select(*[F.col(f"_order.{k}").alias(k) for k in key], "lat", "lng", "places", "clinics", "lawyers", geo.size_class(F.col("places")).alias("size"))
