"""License scans by diagonal voting.

The hashes of all rolling k-word grams of the texts are joined with the template positions that hold the same gram (the
templates are a fixed, small list, so that side is broadcast and the grams are not shuffled). A hit votes for the diagonal
``place in text - place in template``. A diagonal with all of a template's grams is an exact place. For longer templates,
diagonals up to ``SHIFT`` words apart are merged, which bridges words put in or left out, and a span counts once enough
of the template's grams vote for it within a length like the template's.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z as a-z; the gram hashes have 64 bits.

Cases: null and empty texts have no words and no labels; repeated rows are scanned one by one; several templates may
hold the same place; empty tables give empty results; columns beside ``keep`` are dropped, and of these a column named
like one of the result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wayfold.llm.common import SYMBOLS, bounded_batches, grams, mix, pieces, text_bytes, unclashed, words_of

GRAM, SHIFT, COVER = 2, 4, 0.7

# Phrases that count at exact places only.
BASE = {"cc-by": ["cc by"], "gpl": ["general public license"], "reserved": ["all rights reserved"]}
# Longer wordings of public licences; merged diagonals count.
WORDINGS = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license"],
    "public-domain": ["this work is dedicated to the public domain"],
}
_DOCUMENT = np.uint64(0)  # the gram of the row that stands for a whole document


def _words(phrase: str) -> np.ndarray:
    raw = np.frombuffer(phrase.encode(), dtype=np.uint8)
    return words_of(raw, np.array([0, len(raw)]), SYMBOLS)[1]


def templates(spark: SparkSession, base: dict[str, list[str]], wordings: dict[str, list[str]], k: int = GRAM) -> DataFrame:
    """The grams of all templates: gram, template, label, exact, place, grams in the template; and the row for documents."""
    rows = [(int(_DOCUMENT), -1, "", False, 0, 0)]
    for exact, phrases in ((True, base), (False, wordings)):
        for label, texts in sorted(phrases.items()):
            for phrase in texts:
                found = grams(_words(phrase), k).view(np.int64).tolist()
                if not found:
                    raise ValueError(f"shorter than {k} words: {phrase}")
                number = rows[-1][1] + 1
                rows += [(g, number, label, exact, at, len(found)) for at, g in enumerate(found)]
    return spark.createDataFrame(rows, "gram long, template int, label string, exact boolean, at int, size int")


def text_grams(df: DataFrame, text: str, keep: list[str], k: int = GRAM) -> DataFrame:
    """A row for each document (gram 0, place: its words) with its kept columns, and one for each gram at its place."""
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("gram", T.LongType()), T.StructField("place", T.LongType()), *[T.StructField(c, df.schema[c].dataType) for c in keep]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for part in pieces(batches, text):
            doc, hashed, counts = words_of(*text_bytes(part.column(text)), SYMBOLS)
            n_docs = part.num_rows
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            inside = doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :]
            places = np.flatnonzero(inside)
            found = grams(hashed, k)[places]
            found[found == _DOCUMENT] = mix(np.array([1], np.uint64))[0]
            ids = np.concatenate((np.arange(n_docs), doc[places]))
            place = np.concatenate((counts, places - starts[doc[places]]))
            gram = np.concatenate((np.full(n_docs, _DOCUMENT), found)).view(np.int64)
            kept = [pa.concat_arrays([part.column(c), pa.nulls(len(places), part.column(c).type)]) for c in keep]
            yield pa.RecordBatch.from_arrays([pa.array(uid + ids), pa.array(gram), pa.array(place), *kept], schema.names)
            uid += n_docs

    return df.select(text, *[c for c in keep if c != text]).mapInArrow(work, schema)


def scan(df: DataFrame, text: str, keep: list[str], base: dict[str, list[str]] | None = None, wordings: dict[str, list[str]] | None = None, k: int = GRAM, shift: int = SHIFT, cover: float = COVER) -> DataFrame:
    """A row for each document: kept columns, n_words, and ``spans``: label, exact, first_word, n_words, score."""
    bounded_batches(df.sparkSession)
    keep = unclashed(keep, "n_words", "spans")
    # kept columns travel in one structure, whose name alone must be unlike the others
    df = df.select(F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"))
    known = templates(df.sparkSession, BASE if base is None else base, WORDINGS if wordings is None else wordings, k)
    hits = text_grams(df, "text", ["kept"], k).join(F.broadcast(known), "gram")  # a fixed list
    diagonal = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("place") - F.col("at"))
    one = hits.groupBy("uid", "template", diagonal.alias("diagonal")).agg(
        F.any_value("label").alias("label"), F.any_value("exact").alias("exact"), F.any_value("size").alias("size"), F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"),
        F.any_value("kept", True).alias("kept"),
    )
    own = Window.partitionBy("uid", "template").orderBy("diagonal")
    # a diagonal with enough grams of its own is a span of its own: lines that repeat a short wording are no single long span
    alone = F.col("exact") | (F.size("ats") >= F.col("size") * cover)
    apart = F.coalesce(alone | F.lag(alone).over(own) | (F.col("diagonal") - F.lag("diagonal").over(own) > shift), F.lit(True))
    grouped = one.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(own))
    merged = grouped.groupBy("uid", "template", "span").agg(
        F.any_value("label").alias("label"), F.any_value("exact").alias("exact"), F.any_value("size").alias("size"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.any_value("kept", True).alias("kept"),
    )
    score = F.col("votes") / F.col("size")
    length = F.col("high") - F.col("low") + 1
    sure = F.when(F.col("exact"), F.col("votes") == F.col("size")).otherwise((score >= cover) & (length <= F.col("size") * 1.5 + shift))
    span = F.when((F.col("template") >= 0) & sure, F.struct("label", "exact", F.col("low").alias("first_word"), (length + k - 1).alias("n_words"), score.alias("score")))
    whole = F.col("template") < 0
    told = merged.groupBy("uid").agg(F.any_value("kept", True).alias("kept"), F.max(F.when(whole, F.col("low"))).alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans"))
    return told.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence phrases and wordings of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, "text", ["doc_id"])
    base = F.filter("spans", lambda s: s.exact)
    starts = F.transform(base, lambda s: s.first_word)
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"),
    )
