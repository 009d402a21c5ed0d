"""Searches by the trigram index: the rows of the plain condition, from candidate blocks only."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import directory, textindex

COLUMNS, TAGS = ["name", "town"], ["tags"]


def _frame(spark, n, seed, first=0):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abÉx ") for _ in range(draw.randint(0, 7)))
    return spark.createDataFrame([(first + i, word() or None, word(), draw.choice([None, [], [word()], [word(), word()]])) for i in range(n)], "id int, name string, town string, tags array<string>")


def test_searches_equal_scans_over_generations(spark, tmp_path):
    folder, parts = str(tmp_path / "index"), []
    for seed in range(3):
        parts.append(_frame(spark, 120, seed, seed * 1000).repartition(3))
        textindex.add(parts[-1], folder, textindex.haystack(COLUMNS, TAGS), block=16)
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for query in ("abx", "BAé", "a", "", "xxxx", "b a", "éab ", "nowhere at all"):
        condition = directory.contains_any(query, COLUMNS, TAGS)
        assert sorted(r.id for r in textindex.search(spark, folder, query, condition).collect()) == sorted(r.id for r in every.where(condition).collect()), query


def test_one_haystack_spans_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "An", "na", None), (2, "Ann", "a", ["z"])], "id int, name string, town string, tags array<string>")
    folder = str(tmp_path / "index")
    textindex.add(df, folder, F.lower(F.concat_ws(" ", "name", "town", F.array_join("tags", " "))))
    query = "n na"
    assert [r.id for r in textindex.search(spark, folder, query, directory.contains_in_all(query, ["name", "town"], "tags")).collect()] == [1]


def test_only_candidate_blocks_are_read(spark, tmp_path):
    folder = str(tmp_path / "index")
    df = spark.range(2000).select("id", F.format_string("row %05d of many", "id").alias("name")).coalesce(1)
    textindex.add(df, folder, F.lower("name"), block=100)
    out = textindex.search(spark, folder, "ROW 01234", F.lower("name").contains("row 01234"))
    plan = out._jdf.queryExecution().executedPlan()
    assert [r.id for r in out.collect()] == [1234]
    scans = json.dumps(out.inputFiles())
    metrics = [m for m in _leaves(plan)]
    assert sum(metrics) == 100, (metrics, scans)


def _leaves(plan):
    """Rows that each scan of an executed plan read."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from _leaves(plan.executedPlan())
        return
    children = plan.children()
    if children.isEmpty() and plan.metrics().contains("numOutputRows"):
        yield plan.metrics().apply("numOutputRows").value()
    for i in range(children.size()):
        yield from _leaves(children.apply(i))


def test_no_index_and_empty_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        textindex.search(spark, str(tmp_path / "none"), "abc", F.lit(True))
    folder = str(tmp_path / "empty")
    textindex.add(_frame(spark, 0, 1), folder, textindex.haystack(COLUMNS, TAGS))
    assert textindex.search(spark, folder, "abc", F.lit(True)).count() == 0
    textindex.add(_frame(spark, 9, 1), folder, textindex.haystack(COLUMNS, TAGS))
    assert textindex.search(spark, folder, "", F.lit(True)).count() == 9
