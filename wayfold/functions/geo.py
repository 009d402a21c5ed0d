"""Places: great-circle distances, usable coordinates, map views and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's radius in miles, and the map views.
EARTH_MILES = 3958.8
DEFAULT_VIEW = (39.8, -89.5, 5)
STATE_VIEWS = {"FL": (27.8, -83.5, 7), "MN": (46.0, -94.5, 7)}


def miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column, digits: int = 6) -> Column:
    """Great-circle distance, rounded so that engines agree."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.round(2 * EARTH_MILES * F.atan2(F.sqrt(chord), F.sqrt(1 - chord)), digits)


def has_coordinates(lat: Column, lng: Column) -> Column:
    """Both there and neither zero: zero stands for missing."""
    return (F.coalesce(lat, F.lit(0.0)) != 0) & (F.coalesce(lng, F.lit(0.0)) != 0)


def lacks_coordinates(lat: Column, lng: Column) -> Column:
    """Both zero."""
    return (lat == 0) & (lng == 0)


def view(state: Column) -> Column:
    """The centre and zoom of a state's map; unknown states get the whole country."""
    shown = lambda v: F.struct(F.lit(v[0]).alias("lat"), F.lit(v[1]).alias("lng"), F.lit(v[2]).alias("zoom"))
    known = F.create_map(*[x for s, v in STATE_VIEWS.items() for x in (F.lit(s), shown(v))])
    return F.coalesce(known[state], shown(DEFAULT_VIEW))


def cell(degrees: Column, size: float) -> Column:
    """The number of a grid cell."""
    return F.floor(degrees / F.lit(size)).cast("long")


def size_class(count: Column) -> Column:
    """How a cluster of so many places is drawn."""
    return F.when(count < 20, "small").when(count < 100, "medium").otherwise("large")
