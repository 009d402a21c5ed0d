"""Ranked lexical search with K2-treaps over grids of terms and documents.

1. Two numbers for the whole corpus: documents that have terms, and their terms.
2. Each task cuts its documents into shards (``SHARD_DOCS`` documents or ``SHARD_BYTES`` bytes of text at most, one longer text alone) and
   makes a grid of each: rows are terms, columns are documents in the order of their ids, a point holds the impact of the term in
   the document. The grid is a K2-treap: every level quarters the cells of the one above, empty quarters are left out, and a cell
   holds the largest impact in it, stored as the difference from its parent's. Frequent terms take the first rows, the others follow in the
   order of the documents in which they first stand, so that points lie together.
3. The index is a table, a row for each shard. What a term weighs is summed up from the shards' dictionaries.
4. Items come in blocks of ``BLOCK_TERMS`` terms at most. For an item the row paths of its terms descend the treap together: a range of
   documents carries the cell of each path, and the weighted sum of their maxima bounds every score in it. Ranges are taken best
   first, ``WIDTH`` at a time, and none whose bound is below the k-th best score that the task has found in this or earlier shards.

A term is known by a 64-bit hash of its bytes. Scores are integers and results exact; ties go to the smaller id.

Cases: null and empty texts and texts without terms are neither counted nor found; an item without terms, or whose terms no document
holds, finds nothing; equal item rows are one, other rows of the same item id are items of their own with ranks of their own; repeated
documents are found each by itself; a null document id is found like any other and comes last among ties; empty tables give an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import SYMBOLS, bounded_batches, materialize, pieces, scratch, text_bytes, words_of

SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20
#: Terms of the items searched for at once, and ranges of documents looked at together.
BLOCK_TERMS, WIDTH = 1 << 18, 512
#: Inner cells hold impacts in units of this, rounded up, so that 16 bits hold them; points hold them exactly.
UNIT = 16
#: A term in more than this share of a shard's documents is frequent.
FREQUENT = 1 / 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NO_ID = np.iinfo(np.int64).max
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term that stands tf times in a document of n terms counts, before the term's weight."""
    m = 100 - 25 + (25 * n * documents) // max(1, terms)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _spaced(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each number with a zero before each bit."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """A shard's index in memory. ``below[l]``, ``first[l]``: which quarters of a cell of level l are there, and the first one's place in the level
    below; ``top[l]``: the largest impact in a cell. Each level ends with an empty cell."""

    ids: np.ndarray
    terms: np.ndarray
    rows: np.ndarray
    df: np.ndarray
    below: list[np.ndarray]
    first: list[np.ndarray]
    top: list[np.ndarray]


def grid(data: np.ndarray, ends: np.ndarray, documents: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted term hashes, each one's row and document frequency, and the points: row, column, impact."""
    doc, hashed, n = words_of(data, ends, SYMBOLS)
    width = len(ends) - 1
    terms, which = np.unique(hashed, return_inverse=True)
    points, tf = np.unique(which * width + doc, return_counts=True)
    term, column = points // width, points % width
    df = np.bincount(term, minlength=len(terms))
    earliest = column[np.flatnonzero(np.diff(term, prepend=-1))] if len(term) else term
    often = df > max(1, FREQUENT * width)
    rows = np.empty(len(terms), np.int64)
    rows[np.lexsort((np.where(often, -df, earliest), ~often))] = np.arange(len(terms))
    return terms, rows, df, rows[term], column, impacts(tf.astype(np.int64), n[column].astype(np.int64), documents, total)


def quarters(row: np.ndarray, column: np.ndarray, impact: np.ndarray, height: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Levels from the root to the points: for each cell the quarters that are there, and (also of the points) its largest impact."""
    code = (_spaced(row) << np.uint64(1)) | _spaced(column)
    order = np.argsort(code)
    code, top = code[order], impact[order]
    below, tops = [], [top]
    top = -(-top // UNIT)
    for _ in range(height):
        quarter = np.left_shift(1, (code & np.uint64(3)).astype(np.int64))
        code = code >> np.uint64(2)
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        below.append(np.bitwise_or.reduceat(quarter, start).astype(np.uint8))
        top = np.maximum.reduceat(top, start)
        tops.append(top)
        code = code[start]
    return below[::-1], tops[::-1]


def _planes(x: np.ndarray) -> bytes:
    """Numbers of several bytes by byte, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


_INDEX = "ids binary, terms binary, rows binary, df binary, cells array<binary>, tops array<binary>"


def _packed(ids: np.ndarray, data: np.ndarray, ends: np.ndarray, documents: int, total: int) -> pa.RecordBatch | None:
    """A shard's row of the index; none if it has no terms."""
    terms, rows, df, row, column, impact = grid(data, ends, documents, total)
    if not len(terms):
        return None
    height = max(1, int(max(len(terms) - 1, len(ids) - 1)).bit_length())
    below, tops = quarters(row, column, impact, height)
    cells, steps = [], [_planes(tops[0].astype(np.uint16))]
    for level in range(height):
        parent = np.repeat(tops[level], _BITS[below[level]])
        last = level == height - 1
        steps.append(_planes((parent * UNIT - tops[-1]).astype(np.uint32) if last else (parent - tops[level + 1]).astype(np.uint16)))
        half = np.append(below[level], 0) if len(below[level]) % 2 else below[level]
        cells.append(np.append(half[::2] | half[1::2] << 4, np.uint8(len(below[level]) % 2)).astype(np.uint8).tobytes())
    values = [ids.tobytes(), _planes(terms), _planes(rows.astype(np.uint32)), _planes(df.astype(np.uint32))]
    columns = [pa.array([v], pa.binary()) for v in values] + [pa.array([v], pa.list_(pa.binary())) for v in (cells, steps)]
    return pa.RecordBatch.from_arrays(columns, ["ids", "terms", "rows", "df", "cells", "tops"])


def opened(row: dict) -> Treap:
    """A row of the index in memory."""
    below, first, top = [], [], [_from_planes(row["tops"][0], np.uint16).astype(np.int64)]
    height = len(row["cells"])
    for level, raw in enumerate(row["cells"]):
        packed = np.frombuffer(raw, np.uint8)
        cells = np.stack([packed[:-1] & 15, packed[:-1] >> 4], axis=1).ravel()
        cells = cells[: len(cells) - int(packed[-1])]
        counts = _BITS[cells]
        parent = np.repeat(top[level], counts)
        last = level == height - 1
        step = _from_planes(row["tops"][level + 1], np.uint32 if last else np.uint16).astype(np.int64)
        top.append(parent * UNIT - step if last else parent - step)
        below.append(np.append(cells, np.uint8(0)))
        first.append(np.append(np.cumsum(counts) - counts, 0))
    top = [np.append(t * (1 if level == height else UNIT), 0) for level, t in enumerate(top)]
    return Treap(np.frombuffer(row["ids"], np.int64), _from_planes(row["terms"], np.uint64), _from_planes(row["rows"], np.uint32).astype(np.int64), _from_planes(row["df"], np.uint32), below, first, top)


def best(treap: Treap, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best documents of a shard with scores above 0 and of ``floor`` at least."""
    at = np.minimum(np.searchsorted(treap.terms, terms), len(treap.terms) - 1)
    known = (treap.terms[at] == terms) & (weights > 0)
    rows, weights = treap.rows[at[known]], weights[known]
    found_scores, found_columns = np.zeros(0, np.int64), np.zeros(0, np.int64)
    height, floor = len(treap.below), max(1, floor)
    if not len(rows):
        return found_columns, found_scores
    start = int(treap.top[0][0] * weights.sum())
    queue = [(-start, 0, 0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64), np.array([start]))]
    number = 1
    while queue:
        negative, _, level, ranges, cells, bounds = heapq.heappop(queue)
        if -negative < floor:
            break
        fine = bounds >= floor
        if not fine.all():
            ranges, cells, bounds = ranges[fine], cells[fine], bounds[fine]
        if len(ranges) > WIDTH:
            order = np.argsort(-bounds, kind="stable")
            rest = order[WIDTH:]
            heapq.heappush(queue, (-int(bounds[rest[0]]), number, level, ranges[rest], cells[rest], bounds[rest]))
            number += 1
            ranges, cells = ranges[order[:WIDTH]], cells[order[:WIDTH]]
        there, place = treap.below[level][cells].astype(np.int64), treap.first[level][cells]
        bit, top, empty = (rows >> (height - 1 - level)) & 1, treap.top[level + 1], len(treap.top[level + 1]) - 1
        made = []
        for half in (0, 1):
            quarter = 2 * bit + half
            own = np.where((there >> quarter) & 1, place + _BITS[there & ((1 << quarter) - 1)], empty)
            made.append((2 * ranges + half, own, top[own] @ weights))
        ranges, cells, bounds = (np.concatenate([a, b]) for a, b in zip(*made, strict=True))
        fine = bounds >= floor
        ranges, cells, bounds = ranges[fine], cells[fine], bounds[fine]
        if not len(ranges):
            continue
        if level + 1 < height:
            heapq.heappush(queue, (-int(bounds.max()), number, level + 1, ranges, cells, bounds))
            number += 1
            continue
        found_columns, found_scores = np.concatenate([found_columns, ranges]), np.concatenate([found_scores, bounds])
        order = np.lexsort((found_columns, -found_scores))[:k]  # columns stand in the order of the ids
        found_columns, found_scores = found_columns[order], found_scores[order]
        if len(found_scores) == k:
            floor = max(floor, int(found_scores[-1]))
    return treap.ids[found_columns], found_scores


def statistics(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents that have terms, and their terms."""
    told = docs.select(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TERM)).cast("long").alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    return int(told.documents), int(told.terms or 0)


def index(docs: DataFrame, key: str, text: str, documents: int, total: int) -> DataFrame:
    """The index: a row for each shard."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch | None:
            ids = np.concatenate([h[0] for h in held])
            data = np.concatenate([h[1] for h in held])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
            order = np.argsort(ids, kind="stable")
            if (order != np.arange(len(ids))).any():
                data = np.concatenate([data[ends[i] : ends[i + 1]] for i in order])
                ends = np.concatenate([[0], np.cumsum(np.diff(ends)[order])])
            return _packed(ids[order], data, ends, documents, total)

        for piece in pieces(batches, "text"):
            data, ends = text_bytes(piece.column("text"))
            if held and (sum(len(h[0]) for h in held) + piece.num_rows > SHARD_DOCS or sum(len(h[1]) for h in held) + len(data) > SHARD_BYTES):
                row, held = shard(), []
                if row is not None:
                    yield row
            held.append((np.asarray(piece.column("id").fill_null(_NO_ID)), data, ends))
        if held and (row := shard()) is not None:
            yield row

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''").mapInArrow(shards, _INDEX)


def _asked(items: DataFrame, key: str, text: str) -> DataFrame:
    """The terms of each item row: number, item, hashes of its distinct terms, how often each stands there."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            doc, hashed, n = words_of(*text_bytes(piece.column("text")), SYMBOLS)
            every = [np.unique(x, return_counts=True) for x in np.split(hashed, np.cumsum(n)[:-1])]
            columns = [piece.column("row"), piece.column("item"), pa.array([t.view(np.int64) for t, _ in every], pa.list_(pa.int64())), pa.array([c for _, c in every], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "item", "terms", "times"])

    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").distinct().withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(split, f"row long, item {items.schema[key].dataType.simpleString()}, terms array<long>, times array<long>").where(F.size("terms") > 0)


def _weights(shards: DataFrame, wanted: np.ndarray, documents: int) -> np.ndarray:
    """The weight of each wanted term, from the document frequencies in the shards."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for raw_terms, raw_df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                terms = _from_planes(raw_terms, np.uint64)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                df += np.where(terms[at] == wanted, _from_planes(raw_df, np.uint32)[at], 0)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(df[there], pa.int64())], ["at", "df"])

    out = np.zeros(len(wanted), np.int64)
    for r in shards.select("terms", "df").mapInArrow(counted, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():  # a row for each wanted term
        out[r.at] = weight(documents, r.df)
    return out


def search(shards: DataFrame, asked: list[tuple[int, list[int], list[int]]], documents: int, k: int) -> DataFrame:
    """row, doc_id and score: the k best of each task for each of ``asked`` (row, terms, times), a block of bounded size."""
    wanted = np.unique(np.concatenate([np.array(t, np.int64) for _, t, _ in asked]).view(np.uint64))
    weights = _weights(shards, wanted, documents)
    block = []
    for row, terms, times in asked:
        own = np.array(terms, np.int64).view(np.uint64)
        block.append((row, own, weights[np.searchsorted(wanted, own)] * np.array(times, np.int64)))
    sent = shards.sparkSession.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {row: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for row, _, _ in sent.value}
        for batch in batches:
            for at in range(batch.num_rows):
                treap = opened({c: batch.column(c)[at].as_py() for c in batch.schema.names})
                for row, terms, own in sent.value:
                    ids, scores = held[row]
                    more_ids, more_scores = best(treap, terms, own, k, int(scores[-1]) if len(scores) == k else 1)
                    if len(more_ids):
                        ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more_scores])
                        order = np.lexsort((ids, -scores))[:k]
                        held[row] = ids[order], scores[order]
        for row, (ids, scores) in held.items():
            if len(ids):
                columns = [pa.array(np.full(len(ids), row)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "score"])

    return shards.mapInArrow(find, "row long, doc_id long, score long")


@scratch("treap-found")
def top_k(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, k: int) -> DataFrame:
    """The k best documents for each item: the item's key as item_id, rank, doc_id, score."""
    bounded_batches(docs.sparkSession)
    documents, total = statistics(docs, text)
    shards = materialize(index(docs, key, text, documents, total), "treap-index", large_rows=True)
    asked = materialize(_asked(items, item_key, item_text), "treap-items")
    blocks = max(1, -(-int(asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0) // BLOCK_TERMS))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        some = [(r.row, r.terms, r.times) for r in numbered.where(F.col("block") == block).select("row", "terms", "times").orderBy("row").collect()]
        if some:
            more = materialize(search(shards, some, documents, k), "treap-best")
            found = more if found is None else found.unionByName(more)
    if found is None:
        return asked.select(F.col("item").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", F.col("item").alias("item_id")), "row").select("item_id", "rank", "doc_id", "score")


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return top_k(docs, "doc_id", "text", items, "item_id", "text", 20)
