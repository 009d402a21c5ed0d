"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram binds its letters' vectors, each permuted by its place; a
text bundles (sums) the vectors of its trigrams; a language's prototype bundles the unit vectors of its training texts.
A text is given to the language whose prototype has the largest cosine. Runs of anything but letters count as one space.

Training adds up all rows given, task by task, unless a number of rows is asked for; prediction is per row and needs no shuffle.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned; ties go to
the language that sorts first; rows with a null language teach nothing; repeated rows are predicted alike; empty tables
give empty results; extra columns are kept, those named ``lang_pred`` or ``score`` replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import is_held_out, pieces, thinned

DIMS = 1024
#: Letters up to this code have a vector of their own; the others share vectors by hash.
OWN, LETTERS, SPACE = 0x300, 1024, 32
_CHUNK = 1 << 18
_tables: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """The vector number of every code point."""
    if "letters" not in _tables:
        table = np.full(0x110000, SPACE, dtype=np.int64)
        codes = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        table[codes] = np.where(codes < OWN, codes, OWN + (codes * 2654435761 >> 7) % (LETTERS - OWN))
        _tables["letters"] = table
    return _tables["letters"]


def _items(dims: int) -> np.ndarray:
    if f"items{dims}" not in _tables:
        _tables[f"items{dims}"] = np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.int8), (LETTERS, dims))
    return _tables[f"items{dims}"]


def bundle(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """The bundled trigram vectors of each text, a row of zeros where a text has no letter."""
    table = _letter_table()
    coded, doc = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        ids = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
        ids = np.concatenate(([SPACE], ids, [SPACE]))
        ids = ids[np.concatenate(([True], (ids[1:] != SPACE) | (ids[:-1] != SPACE)))]
        if len(ids) > 2:
            coded.append(ids)
            doc.append((i, len(ids) - 2))
    out = np.zeros((len(texts), dims), dtype=np.float32)
    if not coded:
        return out
    letters = np.flatnonzero(np.bincount(np.concatenate(coded), minlength=LETTERS))
    small = np.zeros(LETTERS, dtype=np.int64)
    small[letters] = np.arange(len(letters))
    n = len(letters)
    grams = np.concatenate([(small[x[:-2]] * n + small[x[1:-1]]) * n + small[x[2:]] for x in coded])
    if n**3 <= 1 << 22:
        kinds = np.flatnonzero(np.bincount(grams, minlength=n**3))
        place = np.zeros(n**3, dtype=np.int64)
        place[kinds] = np.arange(len(kinds))
        at = place[grams]
    else:
        kinds, at = np.unique(grams, return_inverse=True)
    row = np.repeat(np.arange(len(doc)), [m for _, m in doc])
    items = _items(dims)
    first, second, third = (items[letters[x]] for x in (kinds // (n * n), kinds // n % n, kinds % n))
    found = np.zeros((len(doc), dims), dtype=np.float32)
    for lo in range(0, len(kinds), 8192):  # bounded memory, however many kinds
        here = (at >= lo) & (at < lo + 8192) if len(kinds) > 8192 else slice(None)
        width = min(8192, len(kinds) - lo)
        counts = np.bincount(row[here] * width + at[here] - lo, minlength=len(doc) * width).reshape(len(doc), width).astype(np.float32)
        bound = np.roll(first[lo : lo + width], 2, axis=1) * np.roll(second[lo : lo + width], 1, axis=1) * third[lo : lo + width]
        found += counts @ bound.astype(np.float32)
    out[[i for i, _ in doc]] = found
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def fit(df: DataFrame, text: str, lang: str, key: str, train_rows: int | None = None, dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """The languages of the rows and their unit prototypes, from all rows or about ``train_rows`` of them, chosen by a hash of ``key``."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if train_rows is None else thinned(rows, [key], train_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(dims))
        for part in pieces(batches, text, _CHUNK):
            for name, vector in zip(part.column(lang).to_pylist(), unit(bundle(part.column(text).to_pylist(), dims)), strict=True):
                sums[name] += vector
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    parts = rows.select(F.col(text), F.col(lang).cast("string").alias(lang)).mapInArrow(work, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("vs")).select("lang", "vs.v").orderBy("lang").collect()
    found = [r for r in found if any(r.v)]
    vectors = np.array([r.v for r in found], dtype=np.float32).reshape(len(found), dims)
    # rounded: the order in which Spark sums must not show
    return [r.lang for r in found], np.round(unit(vectors), 5)


def predict(df: DataFrame, text: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, the cosine with that language's prototype (0 to 1)."""
    langs, prototypes = model
    dims = prototypes.shape[1]
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text, _CHUNK):
            vectors = unit(bundle(part.column(text).to_pylist(), dims))
            if langs:
                near = np.round(vectors @ prototypes.T, 6)
                best = near.argmax(axis=1)
                names = np.where(vectors.any(axis=1), np.array(langs, dtype=object)[best], "und")
                score = np.where(names == "und", 0.0, np.clip(near[np.arange(len(best)), best], 0, 1))
            else:
                names, score = np.full(part.num_rows, "und", dtype=object), np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*kept).mapInArrow(work, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~is_held_out()), "text", "lang", "doc_id")
    told = predict(docs.select("doc_id", "text"), "text", model)
    return told.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
