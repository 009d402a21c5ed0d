"""A training corpus in four stages: toxicity, language, near duplicates, packing.

Each stage takes the documents that its predecessor kept, as a table; all but the last return the columns of documents, with the
values they came with, whatever their names. Rows with a null id pass every filter that needs the id. An empty table passes through as
an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import jaccard, language, packing, toxicity
from wayfold.llm.common import is_held_out, materialize

#: Texts of a length (to a power of two) are rejected when they resemble every learned language less than this share of what the least of
#: the training documents of that length does, where there are so many.
KNOWN, RESEMBLES = 20, 0.5
WORDS, PERCENT = 5, 80


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows of ``docs`` that ``keep`` holds for once ``judge`` has added its columns. Their own columns travel in one, out of its way."""
    own = F.struct(F.lit(0).alias("n"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    told = judge(docs.select("text", own.alias("own"))).where(keep)
    return told.select(*[F.col("text") if c == "text" else F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from those that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out())
    model = toxicity.fit(docs.where(~is_held_out()), labels, "text", "doc_id")
    return _judged(docs, lambda rows: toxicity.score(rows, "text", model), F.col("predicted") == 0)


def _floors(docs: DataFrame, model: tuple) -> dict[int, float]:
    """The least score, by powers of two of the length, that training documents lead one to expect; all of them tell."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    told = language.predict(rows.select("text"), "text", model).where("lang_pred <> 'und'")
    least = told.groupBy(_length().alias("size")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = {r["size"]: RESEMBLES * r.least for r in least.where(F.col("n") >= KNOWN).collect()}  # a row for each power of two
    if not known:
        return {}
    floors = dict(known)
    for size in range(max(known), -1, -1):  # shorter texts resemble less: half as much is enough at each step down
        floors.setdefault(size, floors.get(size + 1, 0.0) / 2)
    return floors | {size: known[max(known)] for size in range(max(known) + 1, 32)}


def _length() -> Column:
    return F.floor(F.log2(F.greatest(F.length("text"), F.lit(1)))).cast("int")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go, and those that resemble every learned language less than texts of their length do.

    What training documents of too few lengths tell holds for longer ones as well, and halved at each step for shorter ones.
    """
    train = docs.where(~is_held_out())
    model = language.fit(train, "text", "lang", "doc_id")
    floors = _floors(train, model)
    floor = F.coalesce(F.create_map(*[F.lit(x) for pair in floors.items() for x in pair])[_length()], F.lit(0.0)) if floors else F.lit(0.0)
    return _judged(docs, lambda rows: language.predict(rows, "text", model), (F.col("lang_pred") != "und") & (F.col("score") >= floor))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id.

    Where ids repeat, every row is a document of its own: of a component the row with the least id, of equal ids the one whose
    values hash least, stays, so that equal rows become one and rows with other texts are kept. Rows with a null id all stay.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        return _by_row(docs)
    found = jaccard.link(docs, "doc_id", "text", WORDS, PERCENT)
    gone = materialize(found.where("doc <> component").select(F.col("doc").alias("doc_id")), "pipeline-gone")
    small = gone.count() <= jaccard.BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


def _by_row(docs: DataFrame) -> DataFrame:
    """The same with a number for each row in place of the id, settled in a table so that it stays the row's own."""
    rows = materialize(docs.select(F.struct("*").alias("own"), "doc_id", "text", F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    known = rows.where("doc_id IS NOT NULL")
    found = jaccard.link(known, "row", "text", WORDS, PERCENT).select(F.col("doc").alias("row"), "component", (F.col("n_shingles") > 0).alias("worded"))
    # rows without words link with nothing, but equal rows are one all the same
    group = F.when(F.col("worded"), F.col("component")).otherwise(F.xxhash64("own"))
    order = F.struct("doc_id", F.xxhash64("own").alias("h"), "row")
    kept = known.join(found, "row").groupBy("worded", group.alias("g")).agg(F.min(order).alias("least")).select("least.row")
    stay = known.join(kept, "row", "left_semi").unionByName(rows.where("doc_id IS NULL"))
    return stay.select("own.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training windows."""
    return packing.pack(docs, "doc_id", "text").drop("ids").withColumnRenamed("doc", "doc_id")


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", drop_near_duplicates), ("packing", pack_windows)]
#: SQL has no classifiers and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
