"""Pages of arranged lists: the same rows as from a sort, and how many rows a page reads."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import pages
from wayfold.sources import files
from tests.test_textindex import _leaves


def test_pages_equal_slices_of_the_sorted_list(spark, tmp_path):
    draw, folder = random.Random(6), str(tmp_path / "list")
    held = [(i, draw.choice([None, 1, 2, 3]), draw.choice("xyz")) for i in range(300)]
    pages.arrange(spark.createDataFrame(held, "id int, v int, s string").repartition(5), {"v": False, "s": True, "id": True}, folder, block=16)
    ordered = sorted(held, key=lambda r: (-(r[1] if r[1] is not None else -1), r[2], r[0]))
    for number, size in ((1, 7), (2, 50), (18, 17), (300, 1), (3, 100), (4, 100), (0, 0), (1, 1000)):
        out = sorted((r.nth, r.id, r.v, r.s, r.total, r.pages) for r in pages.page(spark, folder, number, size).collect())
        n, k = max(number, 1), max(size, 1)
        assert out == [(i + 1, *ordered[i], 300, -(-300 // k)) for i in range((n - 1) * k, min(n * k, 300))], (number, size)


def test_a_deep_page_reads_one_block(spark, tmp_path):
    folder = str(tmp_path / "list")
    pages.arrange(spark.range(100_000).select("id", (F.col("id") * 7 % 100_000).alias("k")), {"k": True}, folder, block=500)
    out = pages.page(spark, folder, 10_000, 10)
    plan = out._jdf.queryExecution().executedPlan()
    assert sorted((r.nth, r.k) for r in out.collect()) == [(i + 1, i) for i in range(99_990, 100_000)]
    assert sum(_leaves(plan)) <= 500
    assert len(files.entry(spark, folder, 1)["blocks"]) >= 200


def test_empty_lists_and_new_arrangements(spark, tmp_path):
    folder = str(tmp_path / "list")
    pages.arrange(spark.range(0), {"id": True}, folder)
    assert pages.page(spark, folder, 1, 10).count() == 0
    pages.arrange(spark.range(3), {"id": False}, folder)
    assert [r.id for r in pages.page(spark, folder, 1, 10).orderBy("nth").collect()] == [2, 1, 0]
    with pytest.raises(files.Conflict):
        files.commit(spark, folder, 2, {})
