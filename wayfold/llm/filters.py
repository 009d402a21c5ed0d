"""What each filter of a chain removes, in every order of the filters.

1. One pass over the texts evaluates every filter but that of repeats and writes a narrow table: key, part, the letters of the filters
   that a document fails, a 64-bit hash of its text.
2. A counting Bloom filter over those hashes, in segments of about ``SEGMENT_TEXTS`` texts: every task adds its hashes to saturating
   counters and sends the cells that it touched; merged, a segment is a bitmap of the cells that were touched twice or more. A text with
   a cell that was touched once is unique for certain.
3. Only texts that the sketch does not clear are shuffled: grouped by the full text, each gives its least key, and the narrow rows that
   are not that first one fail the filter of repeats. A sketch larger than ``SKETCH_BYTES`` is not sent to the executors: then rows meet
   the hashes that occur twice in a join.
4. Labels join the narrow rows, which become counts for each part and set of failed filters (a few dozen numbers a part, whatever the
   input). Everything reported for an order and a step is a sum of some of these.

Cases: null and empty texts are both empty, and repeat each other; a null part is the empty string; a null key is no smaller than any
other and no larger, so such a row repeats nothing, nothing repeats it, and it has no labels; rows with the same key and text do not repeat each
other, but all repeat a smaller key's; several labels of a key count as one that is set where any is; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import bounded_batches, materialize, mix, scratch

#: Texts for each segment of the sketch, cells for each text, cells that a text touches.
SEGMENT_TEXTS, CELLS, TOUCHED = 8192, 16, 3
#: A larger sketch is not broadcast.
SKETCH_BYTES = 64 << 20
#: Hashes that a task adds up before it sends them on.
HELD = 1 << 18


def _cells(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash, and its cells there (a row for each)."""
    mixed = mix(hashes)
    segment = (mixed % np.uint64(segments)).astype(np.int64)
    cells = [(mix(mixed ^ np.uint64(0x9E3779B97F4A7C15 >> j)) % np.uint64(SEGMENT_TEXTS * CELLS)).astype(np.int64) for j in range(TOUCHED)]
    return segment, np.stack(cells, axis=1)


def _sent(hashes: np.ndarray, segments: int) -> pa.RecordBatch:
    """The touched cells of each segment; those touched twice or more have a flag."""
    distinct, times = np.unique(hashes, return_counts=True)
    segment, cells = _cells(distinct, segments)
    places = (segment[:, None] * (SEGMENT_TEXTS * CELLS) + np.sort(cells, axis=1)).ravel()
    first = np.ones(cells.shape, bool)
    first[:, 1:] = np.diff(np.sort(cells, axis=1), axis=1) > 0  # a text counts once in a cell
    weights = (np.minimum(times, 2)[:, None] * first).ravel()
    at, inverse = np.unique(places, return_inverse=True)
    counts = np.minimum(np.bincount(inverse, weights=weights).astype(np.int64), 2)
    owner = at // (SEGMENT_TEXTS * CELLS)
    coded = ((at % (SEGMENT_TEXTS * CELLS)) * 2 + (counts > 1)).astype(np.int32)
    bounds = np.flatnonzero(np.diff(owner, prepend=-1))
    rows = [zlib.compress(x.tobytes(), 1) for x in np.split(coded, bounds[1:])] if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(owner[bounds], pa.int64()), pa.array(rows, pa.binary())], ["segment", "cells"])


def sketch(hashes: DataFrame, segments: int) -> DataFrame:
    """The merged sketch of the column ``hash``: a row for each segment, its bitmap of cells touched twice or more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield _sent(np.concatenate(held), segments)
                held = []
        if held:
            yield _sent(np.concatenate(held), segments)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(SEGMENT_TEXTS * CELLS, np.uint8)
        for raw in pdf["cells"]:
            coded = np.frombuffer(zlib.decompress(raw), np.int32)
            counts[coded >> 1] = np.minimum(counts[coded >> 1] + 1 + (coded & 1), 2)
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bits": [zlib.compress(np.packbits(counts > 1).tobytes(), 1)]})

    return hashes.select("hash").mapInArrow(add, "segment long, cells binary").groupBy("segment").applyInPandas(merge, "segment long, bits binary")


def uncleared(bitmaps: dict[int, bytes], segments: int, spark: SparkSession) -> Column:
    """True for hashes (of the column ``hash``) whose cells were all touched twice or more."""
    sent = spark.sparkContext.broadcast(bitmaps)
    opened: dict[int, np.ndarray] = {}

    @F.pandas_udf("boolean")
    def judge(hashes: pd.Series) -> pd.Series:
        values = hashes.to_numpy(np.int64).view(np.uint64)
        segment, cells = _cells(values, segments)
        out = np.zeros(len(values), bool)
        order = np.argsort(segment, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(segment[order])) + 1) if len(order) else []:
            s = int(segment[rows[0]])
            if s not in opened:
                opened[s] = np.frombuffer(zlib.decompress(sent.value[s]), np.uint8) if s in sent.value else np.zeros(SEGMENT_TEXTS * CELLS // 8, np.uint8)
            bits = opened[s]
            out[rows] = ((bits[cells[rows] >> 3] >> (7 - (cells[rows] & 7))) & 1).all(axis=1)
        return pd.Series(out)

    return judge("hash")


def repeats(narrow: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``narrow`` (id, hash, ...) with ``repeat``: whether ``texts`` (id, text, hash) has the row's text with a smaller id."""
    spark = narrow.sparkSession
    segments = max(1, -(-narrow.count() // SEGMENT_TEXTS))
    if segments * SEGMENT_TEXTS * CELLS // 8 <= SKETCH_BYTES:
        merged = materialize(sketch(narrow, segments), "filters-sketch")
        possible = uncleared({r.segment: bytes(r.bits) for r in merged.collect()}, segments, spark)  # SKETCH_BYTES at most
        marked, suspects = narrow.withColumn("possible", possible), texts.where(possible)
    else:
        twice = materialize(narrow.groupBy("hash").count().where("count > 1").select("hash", F.lit(True).alias("possible")), "filters-twice")
        marked, suspects = narrow.join(twice, "hash", "left"), texts.join(twice, "hash", "left_semi")
    firsts = materialize(suspects.where("id IS NOT NULL").groupBy("text").agg(F.min("id").alias("id"), F.first("hash").alias("hash")).select("id", "hash", F.lit(True).alias("first")).distinct(), "filters-firsts")
    later = F.coalesce("possible", F.lit(False)) & F.col("id").isNotNull() & F.col("first").isNull()
    return marked.join(firsts, ["id", "hash"], "left").withColumn("repeat", later).drop("possible", "first")


@scratch("filters-audit")
def audit(docs: DataFrame, key: str, text: str, part: str, checks: dict[str, Column | None], labels: DataFrame, marks: dict[str, Column], once: dict[str, Column] | None = None) -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, redundant, failed by this filter alone, lost, and the filter's Shapley sum.

    ``checks``: letters of the filters and when a row fails them, by the column ``text`` and the columns that ``once`` makes of it; None stands for the
    filter of repeats. ``marks``: names and conditions on ``labels`` (a table with the key); of the rows removed, those with a mark are counted
    as ``<name>_lost``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    letters = "".join(checks)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    failed = F.concat(F.lit(""), *[F.when(fails, letter).otherwise("") for letter, fails in checks.items() if fails is not None])
    rows = materialize(texts.withColumns(once or {}).select("id", "part", "hash", failed.alias("failed")), "filters-narrow")
    again = next((letter for letter, fails in checks.items() if fails is None), None)
    if again:
        rows = repeats(rows, texts.select("id", "text", "hash")).withColumn("failed", F.when(F.col("repeat"), F.concat("failed", F.lit(again))).otherwise(F.col("failed")))
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(*[F.max(F.when(condition, 1).otherwise(0)).alias(name) for name, condition in marks.items()])
    counted = rows.join(told, "id", "left").groupBy("part", "failed").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in marks])
    return _by_order(materialize(counted, "filters-counts"), letters, list(marks))


def _by_order(counted: DataFrame, letters: str, marks: list[str]) -> DataFrame:
    """The report from the counts for each part and set of failed letters: their sums over the orders and steps."""
    orders = ["".join(p) for p in permutations(letters)]
    rows = counted.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    before, now = "translate(failed, substring(filter_order, 1, step - 1), '') = failed", "instr(failed, substring(filter_order, step, 1)) > 0"
    after = "translate(failed, substring(filter_order, 1, step), '') = failed"

    def over(condition: str, column: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col(column))), F.lit(0))

    # the first in an order of the letters that a document fails removes it: each of them in an equal share of the orders
    share = F.col("n") * F.lit(len(orders)) / F.length("failed")
    return rows.groupBy("part", "filter_order", "step").agg(
        over(after).alias("kept"), over(f"{before} AND {now}").alias("removed"), over(f"NOT {before} AND {now}").alias("redundant"), over(f"{now} AND length(failed) = 1").alias("unique_fails"),
        *[over(f"{before} AND {now}", name).alias(f"{name}_lost") for name in marks], F.coalesce(F.sum(F.when(F.expr(now), share.cast("long"))), F.lit(0)).alias("shapley"),
    )


def word_column() -> dict[str, Column]:
    """Words stand between white space."""
    return {"words": F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")}


def text_checks() -> dict[str, Column | None]:
    """Few words, words that repeat, many capitals, odd symbols, and repeats of a text."""
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    return {"A": F.size("words") < 50, "B": 100 * F.size(F.array_distinct("words")) < 65 * F.size("words"), "C": 100 * capitals > 5 * F.length("text"), "D": F.col("text").rlike(r"[#$%&*|]"), "E": None}


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents by source, in all 120 orders."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(docs, "doc_id", "text", "source", text_checks(), labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, word_column())
