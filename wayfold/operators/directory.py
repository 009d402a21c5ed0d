"""Directories of places: filters, search, facets, the map's list, nearest places."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.functions.text import present


def where_given(df: DataFrame, conditions: list[tuple[object, Column]], valid: dict[int, list] | None = None) -> DataFrame:
    """Rows that meet the conditions whose parameter is given; with ``valid``, those with another value are ignored."""
    used = [c for i, (value, c) in enumerate(conditions) if value not in (None, "") and (not valid or i not in valid or value in valid[i])]
    return df.where(reduce(and_, used)) if used else df


def only(df: DataFrame, column: str, key: object) -> DataFrame:
    """The row with the key, and nothing if several rows have it."""
    rows = Window.partitionBy(column)
    return df.where(F.col(column) == key).withColumn("_rows", F.count("*").over(rows)).where("_rows = 1").drop("_rows")


def contains_any(query: str, columns: list[str], arrays: list[str] = (), trim: bool = False) -> Column:
    """The query occurs in one of the columns or in an element of the arrays, in any case; an empty query always does."""
    sought = (query.strip() if trim else query).lower()
    if not sought:
        return F.lit(True)
    tests = [F.coalesce(F.lower(F.col(c)).contains(sought), F.lit(False)) for c in columns]
    tests += [F.coalesce(F.exists(a, lambda s: F.lower(s).contains(sought)), F.lit(False)) for a in arrays]
    return reduce(or_, tests)


def contains_in_all(query: str, columns: list[str], array: str) -> Column:
    """The query occurs in the columns and the array's elements written one after the other; it may span two of them."""
    sought = query.strip().lower()
    text = F.lower(F.concat_ws(" ", *[present(F.col(c)) for c in columns], F.array_join(array, " ")))
    return F.lit(True) if not sought else text.contains(sought)


def not_only(array: str, pattern: str) -> Column:
    """Some element does not match the pattern, or there are no elements."""
    return F.col(array).isNull() | (F.size(array) == 0) | F.exists(array, lambda s: ~s.rlike(pattern))


def is_available(choice: str, column: str = "available") -> Column:
    """``available``, ``unavailable`` or anything else for all."""
    return F.col(column) if choice == "available" else ~F.col(column) if choice == "unavailable" else F.lit(True)


def matches_specialist(array: str, tags: list[str]) -> Column:
    """The array shares a tag with the list, in any case."""
    return F.arrays_overlap(F.transform(array, F.lower), F.array(*[F.lit(t.lower()) for t in tags]).cast("array<string>"))


# The tags that each kind of specialist goes by.
SPECIALIST_TAGS = {
    "Orthopedist": ["Orthopedics", "Orthopedic", "Orthopedist"],
    "Orthopedic Surgeon": ["Orthopedic Surgery", "Orthopedic Surgeon", "Orthopedics"],
    "Neurologist": ["Neurology", "Neurologist"],
    "Physical Therapist": ["Physical Therapy", "PT", "Physical Therapist"],
    "Pain Management": ["Pain Management", "Pain Medicine"],
    "General Practitioner": ["General Practice", "Family Medicine", "Internal Medicine", "Primary Care"],
    "Radiologist": ["Radiology", "Radiologist", "Imaging"],
    "Other": [],
}


def facet(df: DataFrame, column: str, parents: dict[str, str | None] | None = None) -> DataFrame:
    """The distinct values of a column (or of an array's elements) in order, among the rows with the parents' values."""
    rows = where_given(df, [(v, F.col(k) == v) for k, v in (parents or {}).items()])
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    return rows.select(value.alias(column)).where(present(F.col(column)).isNotNull()).distinct().orderBy(column)


def kept_choice(df: DataFrame, column: str, choice: str, parents: dict[str, str | None]) -> DataFrame:
    """One row: the choice if the facet still offers it, else empty."""
    offered = facet(df, column, parents).agg(F.coalesce(F.bool_or(F.col(column) == choice), F.lit(False)).alias("offered"))
    return offered.select(F.when(F.col("offered"), choice).otherwise("").alias("choice"))


def on_map(clinics: DataFrame, firms: DataFrame) -> DataFrame:
    """Both kinds of place in one list, with their kind, and only those with coordinates."""
    marked = clinics.withColumn("kind", F.lit("clinic")).unionByName(firms.withColumn("kind", F.lit("lawyer")), allowMissingColumns=True)
    return marked.where(geo.has_coordinates(F.col("lat"), F.col("lng")))


def nearest(places: DataFrame, lat: float, lng: float, most: int | None = None, key: str = "id") -> DataFrame:
    """The places by distance from a point; ties by kind and key."""
    away = places.withColumn("miles", geo.miles(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))
    ordered = away.orderBy("miles", *[c for c in ("kind", key) if c in places.columns])
    return ordered.limit(most) if most is not None else ordered


def clusters(places: DataFrame, degrees: float) -> DataFrame:
    """Places by grid cell: how many, which kinds, and the size class."""
    cells = places.groupBy(geo.cell(F.col("lat"), degrees).alias("row"), geo.cell(F.col("lng"), degrees).alias("column"))
    counted = cells.agg(F.count("*").alias("places"), F.count_if(F.col("kind") == "clinic").alias("clinics"), F.count_if(F.col("kind") == "lawyer").alias("lawyers"))
    return counted.withColumn("size", geo.size_class(F.col("places")))


def without(df: DataFrame, *columns: str) -> DataFrame:
    """Columns that a caller may not see, dropped."""
    return df.drop(*columns)


def tree(df: DataFrame, outer: str, inner: str, name: str, shown: int = 5) -> DataFrame:
    """Rows by outer and inner group: the first names in order, and how many more there are."""
    first = df.where(F.col(name).isNotNull()).withColumn("_nth", F.row_number().over(Window.partitionBy(outer, inner).orderBy(name))).where(F.col("_nth") <= shown)
    names = first.groupBy(F.col(outer).alias("_outer"), F.col(inner).alias("_inner")).agg(F.array_sort(F.collect_list(name)).alias("_names"))
    counted = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    told = counted.join(names, F.col(outer).eqNullSafe(F.col("_outer")) & F.col(inner).eqNullSafe(F.col("_inner")), "left")
    listed = F.coalesce(F.array_join("_names", "; "), F.lit(""))
    return told.select(outer, inner, "n", listed.alias("shown"), F.greatest(F.col("n") - shown, F.lit(0)).alias("more"))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def renamed(df: DataFrame, rule: object) -> DataFrame:
    """All columns renamed by a rule such as ``camel`` or ``snake``."""
    return df.toDF(*[rule(c) for c in df.columns])


def document(df: DataFrame, kind: str, fields: list[str], arrays: dict[str, list[str]] | None = None) -> DataFrame:
    """The one document of a kind with some fields, and of its arrays of objects some members."""
    members = lambda names: lambda x: F.struct(*[x[m].alias(m) for m in names])
    chosen = [F.transform(f, members(arrays[f])).alias(f) if arrays and f in arrays else F.col(f) for f in fields]
    return df.where(F.col("_type") == kind).limit(1).select(*chosen)


def picked(df: DataFrame, query: str, columns: list[str], most: int = 20, state: str | None = None) -> DataFrame:
    """What a picker offers: the first rows by name that contain the query, of one state if given."""
    rows = where_given(df, [(state, F.col("state") == (state or ""))])
    return rows.where(contains_any(query, columns, trim=True)).orderBy("name", "id").limit(most)

