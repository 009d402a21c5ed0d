"""A table with versions: files of sorted keys, and a log that says which files make up each version.

A write reads the rows of those files only that hold one of its keys: key ranges and Bloom filters rule most files out, the keys of the rest are
looked up. It writes new files beside the old ones and then commits the next number in the log (``files``), so a failed write
leaves the old version, and of two writers that began from the same version one gets a ``Conflict``. A write with a token that the table has seen
changes nothing, so a rerun is safe.

The log holds a line for each file (as Spark's own file index does); Bloom filters stay in tables. Null keys equal nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.sources import files

#: Rows of a file at most; places of a file's Bloom filter (of 32 768 bits each) for so many keys.
FILE_ROWS, KEYS_OF_BITS = 1 << 20, 4096
#: Tokens that the log remembers, and files whose key ranges are sent to the tasks.
TOKENS, RANGES = 10_000, 1 << 17
_BITS = 1 << 15


def _bit(key: str, places: Column, seed: int) -> Column:
    """The bit of a key in a filter of ``places`` parts: a part in the high digits, a bit of 32 768 below."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), places * _BITS)


def _write(df: DataFrame, folder: str, key: str, file_rows: int) -> list[dict]:
    """The rows in new files, sorted by key: a line of the log for each."""
    spark, data, blooms = df.sparkSession, files.own_name(folder, "data"), files.own_name(folder, "blooms")
    df.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", file_rows).parquet(data)
    path = F.col("_metadata.file_path").alias("path")
    rows = spark.read.schema(df.schema).parquet(data).select(path, F.col(key).alias("key"))
    told = rows.groupBy("path").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    found = [r.asDict() for r in told.withColumn("low", F.col("low").cast("string")).withColumn("high", F.col("high").cast("string")).orderBy("path").collect()]
    places = F.lit(max([1, *[-(-r["rows"] // KEYS_OF_BITS) for r in found]]))
    bits = rows.where("key IS NOT NULL").select("path", F.explode(F.array(*[_bit("key", places, s) for s in (1, 2)])).alias("bit"))
    bits.groupBy("path", F.floor(F.col("bit") / _BITS).alias("place")).agg(F.bitmap_construct_agg((F.col("bit") % _BITS).cast("long")).alias("bits")).withColumn("places", places).write.parquet(blooms)
    return [r | {"blooms": blooms} for r in found]


def version(spark: SparkSession, folder: str) -> int:
    """The number of the latest version; 0 if there is no table."""
    return files.last_number(spark, folder)


def create(df: DataFrame, folder: str, key: str, file_rows: int = FILE_ROWS) -> int:
    """The first version of a table."""
    content = {"key": key, "schema": df.schema.jsonValue(), "file_rows": file_rows, "files": _write(df, folder, key, file_rows), "tokens": []}
    files.commit(df.sparkSession, folder, 1, content)
    return 1


def _rows(spark: SparkSession, content: dict, paths: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(content["schema"])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """A version of the table, the latest unless given."""
    content = files.entry(spark, folder, number or version(spark, folder))
    return _rows(spark, content, [f["path"] for f in content["files"]])


def holding(spark: SparkSession, content: dict, keys: DataFrame) -> list[str]:
    """The files that hold one of the keys (a frame of one column)."""
    key, held = content["key"], [f for f in content["files"] if f["low"] is not None]
    kind = T.StructType.fromJson(content["schema"])[key].dataType
    asked = keys.select(F.col(keys.columns[0]).cast(kind).alias("key")).where("key IS NOT NULL").distinct()
    if held and len(held) <= RANGES:
        exact = isinstance(kind, (T.IntegralType, T.StringType))
        number = isinstance(kind, T.IntegralType)
        spans = [(f["path"], int(f["low"]) if number else f["low"].encode(), int(f["high"]) if number else f["high"].encode()) for f in held] if exact else []

        def within(batches: Iterator) -> Iterator:
            """Files whose range a key is in: the spans by their lower ends, and how far up any span before reaches."""
            from bisect import bisect_right

            import pyarrow as pa

            spans_ = sorted(spans, key=lambda s: s[1])
            lows, reach = [s[1] for s in spans_], []
            for s in spans_:
                reach.append(s[2] if not reach or s[2] > reach[-1] else reach[-1])
            for batch in batches:
                out: tuple[list, list] = ([], [])
                for k in batch.column(0).to_pylist():
                    own = k if number else k.encode()
                    at = bisect_right(lows, own) - 1
                    while at >= 0 and reach[at] >= own:
                        if spans_[at][2] >= own:
                            out[0].append(k)
                            out[1].append(spans_[at][0])
                        at -= 1
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.string())], ["key", "path"])

        if exact:
            near = asked.mapInArrow(within, f"key {kind.simpleString()}, path string")
            blooms = spark.read.schema("path string, place long, bits binary, places int").parquet(*{f["blooms"] for f in held})
            sizes = blooms.groupBy("path").agg(F.max("places").alias("places"))
            tests = near.join(sizes, "path").select("key", "path", F.explode(F.array(*[_bit("key", F.col("places"), s) for s in (1, 2)])).alias("bit")).withColumn("place", F.floor(F.col("bit") / _BITS))
            byte = "CAST(conv(hex(substring(bits, CAST(bit % 32768 AS INT) DIV 8 + 1, 1)), 16, 10) AS INT)"
            hit = tests.join(blooms.select("path", "place", "bits"), ["path", "place"]).where(f"(shiftright({byte}, CAST(bit % 8 AS INT)) & 1) = 1")
            likely = {r.path for r in hit.groupBy("path", "key").agg(F.count("*").alias("n")).where("n = 2").select("path").distinct().collect()}  # a row for each file
            held = [f for f in held if f["path"] in likely]
    if not held:
        return []
    found = _rows(spark, content, [f["path"] for f in held]).select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("path")).join(asked, "key", "left_semi")
    return sorted(r.path for r in found.select("path").distinct().collect())


def _committed(spark: SparkSession, folder: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], token: str | None, base: int | None) -> int:
    """Rewrite the files that hold one of the keys by ``change`` (of their rows) and commit the next version."""
    number = base or version(spark, folder)
    content = files.entry(spark, folder, number)
    if token is not None and token in content["tokens"]:
        return number
    touched = set(holding(spark, content, keys))
    new = _write(change(_rows(spark, content, sorted(touched))), folder, content["key"], content["file_rows"])
    content |= {"files": [f for f in content["files"] if f["path"] not in touched] + new, "tokens": ([*content["tokens"], token] if token is not None else content["tokens"])[-TOKENS:], "removed": sorted(touched)}
    try:
        files.commit(spark, folder, number + 1, content)
    except files.Conflict:
        for f in {f["path"].rsplit("/", 1)[0] for f in new} | {f["blooms"] for f in new}:
            files.deleted(spark, f)
        if token is not None and token in files.entry(spark, folder, version(spark, folder))["tokens"]:
            return version(spark, folder)  # the other writer was a run of this very write
        raise
    return number + 1


def upsert(spark: SparkSession, folder: str, rows: DataFrame, token: str | None = None, base: int | None = None) -> int:
    """Rows added or put in place of those with their key (of several the one with the largest values): the new version's number.

    ``base``: the version that the rows were made from, if not the latest; a commit since then is a conflict.
    """
    from wayfold.operators.mutate import upserted

    content = files.entry(spark, folder, base or version(spark, folder))
    return _committed(spark, folder, rows.select(content["key"]), lambda held: upserted(held, rows, content["key"]).select(*held.columns), token, base)


def patch(spark: SparkSession, folder: str, patches: DataFrame, columns: list[str], token: str | None = None, base: int | None = None) -> int:
    """Non-null values of the patches' columns on the rows with their key."""
    from wayfold.operators.mutate import patched

    content = files.entry(spark, folder, base or version(spark, folder))
    return _committed(spark, folder, patches.select(content["key"]), lambda held: patched(held, patches, content["key"], columns), token, base)


def delete(spark: SparkSession, folder: str, keys: DataFrame, token: str | None = None, base: int | None = None) -> int:
    """The table without the rows of the keys (a frame with the key's column)."""
    content = files.entry(spark, folder, base or version(spark, folder))
    return _committed(spark, folder, keys.select(content["key"]), lambda held: held.join(keys.select(content["key"]).distinct(), content["key"], "left_anti").select(*held.columns), token, base)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> None:
    """Delete the files that none of the last ``keep`` versions has. Not while others write or read older versions."""
    last = version(spark, folder)
    entries = [files.entry(spark, folder, n) for n in range(max(1, last - keep + 1), last + 1)]
    live = {f["path"] for e in entries for f in e["files"]}
    for n in range(1, last - keep + 1):
        for f in files.entry(spark, folder, n)["files"]:
            if f["path"] not in live:
                files.deleted(spark, f["path"])
