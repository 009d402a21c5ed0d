"""Texts inside texts: sorted suffixes merged with the texts that are sought in them.

A text stands inside another if some suffix of the other begins with it. Sorted, a text comes right before all strings that begin with it,
so one pass over suffixes and sought texts together, keeping a stack of those sought texts that the current string begins with, finds
everything: no pair of texts is compared, and letters are sorted once. The sort is by ranges; what the stack holds at the start of a range is
looked up beforehand (a few texts for each range), so ranges are passed over independently. Suffixes are cut to the length of the longest
sought text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.mutate import settled

#: Kinds of string in the sorted order: texts to be found (of the one side or of the other) come before the suffixes that begin with them.
_HELD, _SOUGHT, _HELD_SUFFIX, _SOUGHT_SUFFIX = range(4)


def _group(on: list[str]) -> Column:
    """One string for the columns that must be equal; null where one of them is null."""
    return F.concat(F.lit(""), *[F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in on])


def _suffixes(text: str, longest: int) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(F.col(text), i, F.lit(longest))))


def _ranges(rows: DataFrame) -> tuple[DataFrame, dict[int, list]]:
    """The rows (town, key, kind, ...) in sorted ranges, and for each range those sought texts of earlier ones that its first key begins with."""
    order = ["town", "key", "kind"]
    ranged = settled(rows.repartitionByRange("town", "key").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    first = ranged.groupBy("part").agg(F.min(F.struct("town", "key")).alias("first")).select("part", "first.*")
    prefixes = first.where(F.length("key") > 1).select("part", "town", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda i: F.substring("key", F.lit(1), i))).alias("key"))
    open_ = ranged.where(F.col("kind") <= _SOUGHT).drop("part").join(F.broadcast(prefixes), ["town", "key"])  # a few rows for each range
    stacks: dict[int, list] = {}
    for r in open_.orderBy("part", F.length("key"), "kind").collect():
        stacks.setdefault(r.part, []).append(r)
    return ranged, stacks


def contained(shorts: DataFrame, longs: DataFrame, short: str, long: str, on: list[str] = ()) -> DataFrame:
    """All pairs of rows, equal in ``on``, whose ``short`` text occurs inside the ``long`` one. Empty texts pair with nothing.

    The columns of the two sides must differ but for ``on``.
    """
    on = list(on)
    sought = shorts.select(*on, short).where(F.length(short) > 0).distinct().select(_group(on).alias("town"), F.col(short).alias("key"), F.lit(_SOUGHT).alias("kind"), F.lit(None).cast("string").alias("text"))
    longest = sought.agg(F.max(F.length("key")).alias("n")).first().n or 1
    held = longs.select(*on, long).where(F.length(long) > 0).distinct().select(_group(on).alias("town"), _suffixes(long, longest).alias("key"), F.lit(_HELD_SUFFIX).alias("kind"), F.col(long).alias("text"))
    ranged, stacks = _ranges(sought.unionByName(held).where("town IS NOT NULL"))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stack: list[tuple[str, str]] = []
        begun = False
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for town, key, kind, text, part in zip(*[batch.column(c).to_pylist() for c in ("town", "key", "kind", "text", "part")], strict=True):
                if not begun:
                    stack, begun = [(r.town, r.key) for r in stacks.get(part, [])], True
                while stack and not (stack[-1][0] == town and key.startswith(stack[-1][1])):
                    stack.pop()
                if kind == _SOUGHT:
                    stack.append((town, key))
                else:
                    for _, found in stack:
                        out[0].append(town)
                        out[1].append(found)
                        out[2].append(text)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["_town", "_short", "_long"])

    pairs = ranged.mapInArrow(scan, "_town string, _short string, _long string").distinct()
    left = shorts.withColumn("_town", _group(on)).join(pairs.withColumnRenamed("_short", short), ["_town", short])
    return left.join(longs.withColumns({"_town": _group(on), "_long": F.col(long)}).drop(*on), ["_town", "_long"]).drop("_town", "_long")


def least_related(sought: DataFrame, held: DataFrame, on: str, text: str, value: str) -> DataFrame:
    """For each sought (``on``, ``text``) the least ``value`` (a struct) of the held rows, equal in ``on``, whose text contains the sought one or is contained in it.

    Both directions come from one pass: the least value travels down the stack from held texts to sought suffixes, and up it from held
    suffixes to sought texts, so texts that are all inside each other cost no more than others.
    """
    kind = held.schema[value].dataType
    one = held.where(F.length(text) > 0).groupBy(F.col(on).alias("town"), F.col(text).alias("key")).agg(F.min(value).alias("value"))
    asked = sought.where(F.length(text) > 0).select(F.col(on).alias("town"), F.col(text).alias("key")).distinct()
    one, asked = settled(one), settled(asked)
    sizes = one.select(F.length("key").alias("n")).unionByName(asked.select(F.length("key").alias("n"))).agg(F.max("n").alias("n")).first()
    none, whole = F.lit(None).cast(kind).alias("value"), F.lit(None).cast("string").alias("text")
    rows = one.select("town", "key", F.lit(_HELD).alias("kind"), "value", whole).unionByName(asked.select("town", "key", F.lit(_SOUGHT).alias("kind"), none, whole))
    rows = rows.unionByName(one.select("town", _suffixes("key", sizes.n or 1).alias("key"), F.lit(_HELD_SUFFIX).alias("kind"), "value", whole))
    rows = rows.unionByName(asked.select("town", _suffixes("key", sizes.n or 1).alias("key"), F.lit(_SOUGHT_SUFFIX).alias("kind"), none, F.col("key").alias("text")))
    ranged, stacks = _ranges(rows.where("town IS NOT NULL"))

    def order(v: dict) -> tuple:
        return tuple((x is not None, x) for x in v.values())  # nulls first, as in Spark

    def least(a: dict | None, b: dict | None) -> dict | None:
        return b if a is None else a if b is None or order(a) <= order(b) else b

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        # of each text on the stack: town, text, least value of the held ones down to it, whether it is sought, least value met above it
        stack: list[list] = []
        out: tuple[list, list, list] = ([], [], [])

        def tell(town: str, key: str, found: dict) -> None:
            for column, x in zip(out, (town, key, found), strict=True):
                column.append(x)

        def pop() -> None:
            town, key, _, wanted, met = stack.pop()
            if met is not None:
                if wanted:
                    tell(town, key, met)
                if stack:
                    stack[-1][4] = least(stack[-1][4], met)

        def push(town: str, key: str, kind_: int, found: dict | None) -> None:
            above = stack[-1][2] if stack else None
            if stack and stack[-1][1] == key:
                stack[-1][2], stack[-1][3] = least(stack[-1][2], found), stack[-1][3] or kind_ == _SOUGHT
            else:
                stack.append([town, key, least(above, found), kind_ == _SOUGHT, None])

        begun = False
        for batch in batches:
            for town, key, kind_, found, text_, part in zip(*[batch.column(c).to_pylist() for c in ("town", "key", "kind", "value", "text", "part")], strict=True):
                if not begun:
                    for r in stacks.get(part, []):
                        push(r.town, r.key, r.kind, r.value.asDict() if r.value is not None else None)
                    begun = True
                while stack and not (stack[-1][0] == town and key.startswith(stack[-1][1])):
                    pop()
                if kind_ <= _SOUGHT:
                    push(town, key, kind_, found)
                elif stack and kind_ == _HELD_SUFFIX:
                    stack[-1][4] = least(stack[-1][4], found)
                elif stack and stack[-1][2] is not None:
                    tell(town, text_, stack[-1][2])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], arrow)], ["town", "key", "value"])
            out = ([], [], [])
        while stack:
            pop()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], arrow)], ["town", "key", "value"])

    found = ranged.mapInArrow(scan, f"town string, key string, value {kind.simpleString()}")
    return found.groupBy(F.col("town").alias(on), F.col("key").alias(text)).agg(F.min("value").alias(value))
