"""Lexical retrieval packing: documents that belong together by BM25 share training windows.

1. Texts become token ids once, written to a table with the per-token document counts of each task. Summed over all
   tasks these give the BM25 statistics (a table as long as the vocabulary, whatever the input).
2. Documents are put in an order in which like stands by like: vectors of token weights projected to ``DIMS`` dimensions, the nearest of centroids that
   were fitted on a bounded sample (``SAMPLE`` documents), and within a centroid's cell the signs of what is left. One sort by ranges deals
   that order out to tasks; a hot cell is split by row numbers.
3. Each task goes through its part in shards of ``SHARD_DOCS`` documents (or ``SHARD_TOKENS`` tokens): it builds the shard's inverted index and scores
   every document as a query with its whole vocabulary, by the statistics of the whole corpus. Then windows are filled greedily: the seed asks
   for its best unused neighbour again and again until the window is full, however many that takes. A neighbour that is cut at the
   border opens the next window as its seed. The last window of a shard is filled by the next shard.
4. Only the last window of a task is short, so hardly any padding is needed.

The work grows with the documents (each is compared with its shard), not with their square; a neighbour in another shard is not found. How
many of the best neighbours stand in the same shard is stated in README.

Cases: a null or empty text consists of the end id alone; ties go to the document of the least place in the order (equal ones by row number);
repeated rows are packed one by one; a null key is packed like any other; a document without neighbours opens windows or fills up the current
one; an empty table gives an empty result; columns other than the key and the text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import bounded_batches, delete, materialize, pieces, thinned
from wayfold.sources.shared import new_path

WINDOW, END_ID, VOCABULARY = 2048, 1, 50_257
#: Documents and tokens of a shard, at most (one longer document is a shard of its own).
SHARD_DOCS, SHARD_TOKENS = 512, 2 << 20
#: Dimensions of the vectors that documents are ordered by, documents that centroids are fitted on, centroids, and steps of the fit.
DIMS, SAMPLE, CENTROIDS, STEPS = 128, 4096, 1024, 8
#: Tokens that a larger share of a shard's documents hold are scored by matrix products.
DENSE = 0.04
#: Such tokens, and pairs of places in the postings of the others, that are looked at together.
COLUMNS, PAIRS = 2048, 1 << 20
K1, B = 1.2, 0.75
#: The added token of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}
_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ranks file; the added token is recognised in plain text, as tokenizers do."""
    if path not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _encoders[path]


_place = np.zeros(VOCABULARY, np.int64)


def distinct(ids: np.ndarray) -> np.ndarray:
    """The different tokens of a document, each at its last place; nothing is sorted."""
    at = np.arange(len(ids))
    _place[ids] = at
    return ids[_place[ids] == at]


def tokenized(df: DataFrame, key: str, text: str, ranks: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables, in the files at ``path``: (row, a number of its own, doc, ids as little-endian 16-bit numbers), and (token, docs) summed over all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(ranks).encode_to_numpy, allowed_special="all")
        seen, tokens = np.zeros(VOCABULARY, dtype=np.int64), 0
        schema = ["doc", "ids", "row", "seen", "n_docs", "n_tokens"]
        n_docs, first = 0, (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for part in pieces(batches, text):
            packed = []
            for one in part.column(text).to_pylist():
                ids = np.append(encode(one), END_ID).astype("<u2") if one else np.array([END_ID], "<u2")
                seen[distinct(ids)] += 1
                tokens += len(ids)
                packed.append(ids.tobytes())
            rows = pa.array(range(first + n_docs, first + n_docs + len(packed)), pa.int64())
            n_docs += len(packed)
            none = pa.nulls(len(packed), pa.binary()), pa.nulls(len(packed), pa.int64()), pa.nulls(len(packed), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(packed, pa.binary()), rows, *none], schema)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.int64()), pa.array([seen.astype("<i8").tobytes()], pa.binary()), pa.array([n_docs], pa.int64()), pa.array([tokens], pa.int64())], schema)

    spark, path = df.sparkSession, path or new_path(df.sparkSession, "packing-ids")
    fields = "doc long, ids binary, row long, seen binary, n_docs long, n_tokens long"
    made = df.select(F.col(key).cast("long").alias(key), text).mapInArrow(work, fields)
    made.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(fields).parquet(path)
    return table.where("ids IS NOT NULL").select("row", "doc", "ids"), table.where("seen IS NOT NULL").select("seen", "n_docs", "n_tokens")


@dataclass
class Statistics:
    """Of all documents: the weight of each token, how many hold it, the mean length, and the totals."""

    idf: np.ndarray
    held: np.ndarray
    mean_tokens: float
    tokens: int
    docs: int


def statistics(counts: DataFrame) -> Statistics:
    """BM25 statistics from the tasks' counts, added up by Spark."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, dtype=np.int64)
        for part in batches:
            for seen in part.column("seen").to_pylist():
                total += np.frombuffer(seen, dtype="<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "docs"])

    whole = counts.agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).first()
    if not whole.d:
        return Statistics(np.zeros(VOCABULARY, np.float32), np.zeros(VOCABULARY), 1.0, 0, 0)
    sums = counts.select("seen").mapInArrow(spread, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs")).toPandas()
    docs = np.zeros(VOCABULARY)
    docs[sums["token"]] = sums["docs"]
    return Statistics(np.log(1 + (whole.d - docs + 0.5) / (docs + 0.5)).astype(np.float32), docs, whole.t / whole.d, whole.t, whole.d)


class Shard:
    """The inverted index of some documents: for every token its documents and their BM25 weights, by token."""

    def __init__(self, texts: list[np.ndarray], stats: Statistics):
        lengths = np.array([len(t) for t in texts])
        doc = np.repeat(np.arange(len(texts)), lengths)
        both = np.sort((np.concatenate(texts).astype(np.int64) << 20) | doc)
        new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        times = np.diff(np.append(new, len(both)))
        self.token, self.doc, self.n = both[new] >> 20, both[new] & ((1 << 20) - 1), len(texts)
        norm = K1 * (1 - B + B * lengths / stats.mean_tokens)
        self.weight = (stats.idf[self.token] * times * (K1 + 1) / (times + norm[self.doc])).astype(np.float32)

    def scores(self) -> np.ndarray:
        """The score of each document (column) for the whole vocabulary of each (row); 0 for itself."""
        begin = np.flatnonzero(np.diff(self.token, prepend=-1))
        held = np.diff(np.append(begin, len(self.token)))
        out = np.zeros((self.n, self.n), np.float32)
        often, rare = np.flatnonzero(held > DENSE * self.n), np.flatnonzero(held <= DENSE * self.n)
        for low in range(0, len(often), COLUMNS):
            some = often[low : low + COLUMNS]
            column = np.repeat(np.arange(len(some)), held[some])
            at = np.concatenate([np.arange(b, b + n) for b, n in zip(begin[some], held[some], strict=True)])
            has, weigh = (np.zeros((len(some), self.n), np.float32) for _ in range(2))
            has[column, self.doc[at]], weigh[column, self.doc[at]] = 1, self.weight[at]
            out += has.T @ weigh
        # pairs of places in the postings of each rare token, so many at once
        for some in np.split(rare, np.flatnonzero(np.diff(np.cumsum(held[rare] ** 2) // PAIRS)) + 1) if len(rare) else []:
            size = held[some]
            pairs = size * size
            first, width = np.repeat(begin[some], pairs), np.repeat(size, pairs)
            nth = np.arange(len(first)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            asks, told = first + nth // width, first + nth % width
            out += np.bincount(self.doc[asks] * self.n + self.doc[told], weights=self.weight[told], minlength=out.size).reshape(out.shape).astype(np.float32)
        np.fill_diagonal(out, 0)
        return out


def _projection() -> np.ndarray:
    """A fixed random direction for each token."""
    return np.random.default_rng(20260301).choice(np.array([-1, 1], np.float32), (VOCABULARY, DIMS))


def vector(ids: np.ndarray, stats: Statistics, directions: np.ndarray) -> np.ndarray:
    """The unit vector by which a document is ordered: the weights of its tokens, projected."""
    kinds = distinct(ids)
    made = stats.idf[kinds] @ directions[kinds]
    size = np.sqrt((made * made).sum())
    return made / size if size > 0 else made


def centroids(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors that the sampled ones gather around, each followed by the nearest that is left."""
    n = max(1, min(CENTROIDS, len(vectors) // 4))
    held = vectors[np.random.default_rng(31).permutation(len(vectors))[:n]]
    for _ in range(STEPS):
        near = (vectors @ held.T).argmax(axis=1)
        sums = np.zeros_like(held)
        np.add.at(sums, near, vectors)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        held = np.where(size > 0, sums / np.maximum(size, 1e-9), held)
    order, left = [0], set(range(1, n))
    while left:
        rest = np.array(sorted(left))
        order.append(int(rest[(held[rest] @ held[order[-1]]).argmax()]))
        left.remove(order[-1])
    return held[order]


def ordered(texts: DataFrame, stats: Statistics) -> DataFrame:
    """The rows (row, doc, ids) with the cell and the code that put like by like."""
    rows = thinned(texts, ["row"], SAMPLE, seed=37).select("ids").collect() if stats.docs else []  # a bounded sample
    directions = _projection()
    held = centroids(np.stack([vector(np.frombuffer(r.ids, "<u2"), stats, directions) for r in rows])) if rows else np.zeros((1, DIMS), np.float32)
    weights = 1 << np.arange(30, -1, -1, dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _projection()
        for part in batches:
            if not part.num_rows:
                continue
            own = np.stack([vector(np.frombuffer(i, "<u2"), stats, directions) for i in part.column("ids").to_pylist()])
            cell = (own @ held.T).argmax(axis=1)
            code = ((own - held[cell])[:, : len(weights)] > 0) @ weights
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(code)], [*part.schema.names, "cell", "code"])

    return texts.select("row", "doc", "ids").mapInArrow(place, "row long, doc long, ids binary, cell int, code long")


@dataclass
class Writer:
    """The pieces of documents laid one after the other into windows."""

    window: int
    sequence: int
    offset: int = 0

    def __post_init__(self) -> None:
        self.pieces: list[tuple] = []

    def lay(self, doc: int | None, ids: np.ndarray, start: int, stop: int) -> None:
        """The ids from ``start`` on before ``stop``."""
        while start < stop:
            n = min(stop - start, self.window - self.offset)
            piece = ids[start : start + n].astype("<u4").tobytes()
            self.pieces.append((doc, start, n, zlib.crc32(piece), len(ids), self.sequence, self.offset, piece))
            start, self.offset = start + n, self.offset + n
            if self.offset == self.window:
                self.sequence, self.offset = self.sequence + 1, 0


def filled(docs: list[tuple[int | None, np.ndarray]], scores: np.ndarray, writer: Writer) -> list[bool]:
    """Lay all documents (key, ids) of a shard; for each in the order laid, whether a seed asked for it."""
    unused, seed, told = np.ones(len(docs), bool), None, []

    def lay(at: int, asked: bool) -> bool:
        """Whether the document goes on in a window after the one where it began."""
        before, unused[at] = writer.sequence, False
        told.append(asked)
        writer.lay(*docs[at], 0, len(docs[at][1]))
        return writer.sequence != before

    while unused.any():
        if seed is None:
            seed = int(unused.argmax())
            lay(seed, False)
        while seed is not None and writer.offset:
            own = np.where(unused, scores[seed], 0)
            best = int(own.argmax())
            if own[best] <= 0:
                break
            if lay(best, True):
                seed = best
        seed = None
    return told


def pack(df: DataFrame, key: str, text: str, ranks: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The pieces of all documents: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves."""
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    path = new_path(spark, "packing-ids")
    texts, counts = tokenized(df, key, text, ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), path)
    stats = statistics(counts)
    placed = materialize(ordered(texts, stats), "packing-ordered", 1)  # the sort looks at the rows twice
    delete(path)
    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, held, tokens = Writer(window, (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0), [], 0

        def shard() -> pa.RecordBatch:
            filled(held, Shard([ids for _, ids in held], stats).scores(), writer)
            columns, writer.pieces = list(zip(*writer.pieces, strict=True)), []
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:7]], pa.array(columns[7], pa.binary())], names)

        for part in batches:
            for doc, raw in zip(part.column("doc").to_pylist(), part.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype="<u2")
                if held and (len(held) >= shard_docs or tokens + len(ids) > SHARD_TOKENS):
                    yield shard()
                    held, tokens = [], 0
                held.append((doc, ids))
                tokens += len(ids)
        if held:
            yield shard()

    # tasks of 256 windows or more, so that their short last windows hardly count, and of 16384 at most
    windows = -(-stats.tokens // window)
    parts = max(1, min(windows // 256, max(int(spark.conf.get("spark.sql.shuffle.partitions")), windows // 16384)))
    dealt = placed.repartitionByRange(parts, "cell", "code", "row").sortWithinPartitions("cell", "code", "row")
    return dealt.select("doc", "ids").mapInArrow(work, "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, "doc_id", "text").drop("ids").withColumnRenamed("doc", "doc_id")
