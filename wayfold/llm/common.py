"""Helpers shared by the operators: shared folders, batches of bounded size, word and shingle hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.shared import new_path

#: Bytes of text handled at once in a Python worker; one longer text forms a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20
#: Bytes of a row group in tables of large rows. Readers hold a row group at once, and writers one that is not yet full.
GROUP_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in Arrow batches of ``BATCH_BYTES`` at most from now on (one longer row: a batch of its own)."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Paths of the tables written inside each scratch function that runs.
_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str, level: int = 3, large_rows: bool = False) -> DataFrame:
    """Cut the lineage with a table written in the shared folder, which outlives lost executors.

    ``large_rows``: for rows of megabytes. Row groups end after ``GROUP_BYTES``, and sizes are looked at after every row (else only after a
    hundred), so that neither writing nor reading holds all rows of a task.
    """
    path = new_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
    if large_rows:
        writer = writer.options(**{"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"})
        writer = writer.options(**{"parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"})
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(path: str) -> None:
    """Remove a folder written in the shared folder."""
    system, folder = fs.FileSystem.from_uri(path)
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


def scratch(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For functions that return a frame: it is materialised, and then the tables written on the way are deleted."""

    def decorate(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(*args, **options) -> DataFrame:
            written: list[str] = []
            _scopes.append(written)
            try:
                out = f(*args, **options)
                _scopes.pop()
                return materialize(out, name)
            finally:
                if _scopes and _scopes[-1] is written:
                    _scopes.pop()
                for path in written:
                    delete(path)

        return run

    return decorate


def unclashed(keep: list[str], *results: str) -> list[str]:
    """The columns to keep: once each, and without those that a result column replaces."""
    return [c for c in dict.fromkeys(keep) if c not in results]


def utf8(col: str | Column) -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.encode(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), "UTF-8")


def is_held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the key as text leaves 1 when divided by 3 (a null key: none)."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def thinned(df: DataFrame, keys: list[str], bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows at most (all rows where there are fewer), chosen by a hash of ``keys``, alike in every run.

    Only for fitting models on a bounded sample; a null key hashes like any other value.
    """
    total = df.count()
    if total <= bound:
        return df
    share = bound / total
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 30)) < int(share * (1 << 30)))


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``most`` bytes of ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(text))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins (and the last ends); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _powers[int(base)] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, ends: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are no separators: where each begins and ends, and its document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    full = ends[:-1] < ends[1:]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[ends[:-1][full]] = False
    first = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[ends[1:][full] - 1] = False
    last = np.flatnonzero(inside & ~after) + 1
    return first, last, np.searchsorted(ends, first, "right") - 1


def run_hashes(data: np.ndarray, first: np.ndarray, *lasts: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes (A-Z as a-z) of the runs of bytes that begin at ``first``, for each array of ends."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[LOWER[data]] * _powers_of(_ODD, len(data)), out=sums[1:])
    shift = _powers_of(_INVERSE, max(1, len(data)))[first]
    return [mix((sums[last] - sums[first]) * shift + (last - first).astype(np.uint64) * _STEP) for last in lasts]


def words_of(data: np.ndarray, ends: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are no separators): their document, 64-bit hash, and the words of each document."""
    first, last, doc = word_bounds(data, ends, separator)
    return doc, run_hashes(data, first, last)[0], np.bincount(doc, minlength=len(ends) - 1)


def grams(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on, in order; the last k - 1 places run into the following document."""
    n = max(0, len(hashed) - k + 1)
    total = np.full(n, k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for j in range(k):
        total += hashed[j : j + n] * np.uint64(pow(int(_STEP), j, 1 << 64))
    return mix(total)


def shingle_sets(data: np.ndarray, ends: np.ndarray, separator: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; fewer words form one shingle, none form none."""
    _, hashed, counts = words_of(data, ends, separator)
    every = grams(hashed, k)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(every[at : at + n - k + 1]))
        elif n:
            out.append(grams(hashed[at : at + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def separators(pattern_bytes: bytes) -> np.ndarray:
    """A table that is true at the bytes given."""
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: Everything in ASCII but letters and digits.
SYMBOLS = separators(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Separators of words `[^\x20\x09-\x0D]+`.
SPACES = separators(bytes([0x20, *range(0x09, 0x0E)]))
