"""Versioned tables: which files a write touches, conflicts, reruns, failures."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.sources import files, versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    folder = str(tmp_path / "table")
    versions.create(spark.range(1000).select("id", F.format_string("n%d", "id").alias("name"), F.lit(0).alias("v")), folder, "id", file_rows=50)
    return folder


def _paths(spark, folder, number):
    return {f["path"] for f in files.entry(spark, folder, number)["files"]}


def test_only_files_that_hold_a_key_are_rewritten(spark, table):
    one_percent = spark.range(420, 430).select("id", F.lit("new").alias("name"), F.lit(1).alias("v"))
    assert versions.upsert(spark, table, one_percent) == 2
    before, after = _paths(spark, table, 1), _paths(spark, table, 2)
    assert len(before) >= 20 and 1 <= len(before - after) <= 2
    assert files.entry(spark, table, 2)["removed"] == sorted(before - after)
    expected = [(i, "new" if 420 <= i < 430 else f"n{i}", int(420 <= i < 430)) for i in range(1000)]
    assert rows(versions.read(spark, table)) == sorted(expected, key=repr)
    assert versions.read(spark, table, 1).where("v = 1").count() == 0  # the old version is still there
    # keys in the range of files, but in none of them: nothing is rewritten
    sparse = str(table) + "-sparse"
    versions.create(spark.range(0, 4000, 4).select("id"), sparse, "id", file_rows=100)
    versions.upsert(spark, sparse, spark.createDataFrame([(401,), (2002,)], "id long"))
    assert files.entry(spark, sparse, 2)["removed"] == [] and versions.read(spark, sparse).count() == 1002


def test_any_sequence_of_writes_equals_a_plain_table(spark, tmp_path):
    draw, folder = random.Random(4), str(tmp_path / "t")
    state = {f"k{i}": i for i in range(60)}
    versions.create(spark.createDataFrame(list(state.items()), "k string, v int"), folder, "k", file_rows=7)
    for step in range(6):
        some = {f"k{draw.randint(0, 80)}": draw.randint(100, 999) for _ in range(draw.choice([1, 9]))}
        frame = spark.createDataFrame(list(some.items()), "k string, v int")
        kind = step % 3
        if kind == 0:
            versions.upsert(spark, folder, frame)
            state |= some
        elif kind == 1:
            versions.delete(spark, folder, frame.select("k"))
            state = {k: v for k, v in state.items() if k not in some}
        else:
            versions.patch(spark, folder, frame, ["v"])
            state |= {k: v for k, v in some.items() if k in state}
        assert rows(versions.read(spark, folder)) == sorted(state.items(), key=repr)
    versions.vacuum(spark, folder)
    assert rows(versions.read(spark, folder)) == sorted(state.items(), key=repr)


def test_two_writers_from_one_version_are_in_conflict(spark, table):
    change = lambda i: spark.createDataFrame([(i, "w", 9)], "id long, name string, v int")
    assert versions.upsert(spark, table, change(1), base=1) == 2
    with pytest.raises(files.Conflict):
        versions.upsert(spark, table, change(2), base=1)
    assert rows(versions.read(spark, table).where("v = 9").select("id")) == [(1,)]
    assert versions.upsert(spark, table, change(2)) == 3


def test_a_rerun_changes_nothing(spark, table):
    row = spark.createDataFrame([(5, "once", 1)], "id long, name string, v int")
    assert versions.upsert(spark, table, row, token="job-1") == 2
    versions.upsert(spark, table, row.withColumn("name", F.lit("later")), token="job-2")
    assert versions.upsert(spark, table, row, token="job-1") == 3
    assert versions.read(spark, table).where("id = 5").first().name == "later"
    assert versions.upsert(spark, table, row, token="job-2", base=1) == 3  # from an old version, but already done


def test_a_failed_write_leaves_the_old_version(spark, table):
    broken = spark.createDataFrame([(5, "x", 1)], "id long, name string, v int").withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        versions.upsert(spark, table, broken)
    assert versions.version(spark, table) == 1 and versions.read(spark, table).count() == 1000


def test_null_keys_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "t")
    versions.create(spark.createDataFrame([], "k long, v int"), folder, "k")
    assert versions.read(spark, folder).count() == 0
    versions.upsert(spark, folder, spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k long, v int"))
    versions.upsert(spark, folder, spark.createDataFrame([(None, 4), (1, 5)], "k long, v int"))
    assert rows(versions.read(spark, folder)) == sorted([(None, 1), (None, 2), (None, 4), (1, 5)], key=repr)
