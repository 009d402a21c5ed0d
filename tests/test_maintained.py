"""Maintained counts equal a recount after any changes, and replays change nothing."""

import random

from pyspark.sql import functions as F

from wayfold.sources import versions
from wayfold.streaming import maintained

FIELDS, GROUPS = "id int, status string, clinic string", ["status", "clinic"]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _recount(spark, state):
    return _rows(spark.createDataFrame(list(state.values()), FIELDS).groupBy(*GROUPS).agg(F.count("*").alias("n")))


def _changed(draw, state):
    """Some inserts, updates and deletes of a table, and the feed that tells of them."""
    feed, new = [], dict(state)
    for _ in range(draw.randint(1, 15)):
        i = draw.randint(0, 40)
        before, after = new.get(i), None if draw.random() < 0.3 else (i, draw.choice(["open", "closed", None]), draw.choice("ab"))
        if before or after:
            feed.append((before, after))
            new.pop(i, None)
            if after:
                new[i] = after
    return feed, new


def test_any_sequence_of_changes_and_replays(spark, tmp_path):
    draw, folder = random.Random(3), str(tmp_path / "counts")
    state = {i: (i, "open", "ab"[i % 2]) for i in range(20)}
    maintained.start(spark, folder, spark.createDataFrame(list(state.values()), FIELDS), GROUPS)
    kind = f"before struct<{FIELDS.replace(' ', ':')}>, after struct<{FIELDS.replace(' ', ':')}>".replace(",:", ",")
    batches = []
    for n in range(5):
        feed, state = _changed(draw, state)
        batches.append(spark.createDataFrame(feed, kind))
        maintained.apply(spark, folder, batches[-1], GROUPS, f"b{n}")
        maintained.apply(spark, folder, batches[draw.randint(0, n)], GROUPS, f"b{n}")  # the number counts, not the rows
        assert _rows(maintained.counts(spark, folder).select(*GROUPS, "n")) == _recount(spark, state)
    last = versions.version(spark, folder)
    for n, batch in enumerate(batches):
        assert maintained.apply(spark, folder, batch, GROUPS, f"b{n}") == last


def test_states_make_a_feed(spark):
    old = spark.createDataFrame([(1, "open", "a"), (2, None, "b"), (3, "open", "a")], FIELDS)
    new = spark.createDataFrame([(1, "closed", "a"), (2, None, "b"), (4, "open", "b")], FIELDS)
    feed = maintained.changes(old, new, "id")
    assert feed.count() == 3
    assert _rows(maintained.differences(feed, ["status"])) == sorted([("closed", 1), ("open", -1)], key=repr)


def test_a_stream_that_is_started_twice_counts_once(spark, tmp_path):
    folder, source = str(tmp_path / "counts"), str(tmp_path / "feed")
    empty = spark.createDataFrame([], FIELDS)
    maintained.start(spark, folder, empty, ["status"])
    spark.createDataFrame([(None, (1, "open", "a")), (None, (2, "open", "b")), ((1, "open", "a"), (1, "closed", "a"))], f"before struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>, after struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>").write.parquet(source)
    schema = spark.read.parquet(source).schema
    for checkpoint in ("one", "two"):  # a stream that lost its checkpoint replays its first batch
        query = maintained.keep(spark.readStream.schema(schema).parquet(source), folder, ["status"], "referrals").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert _rows(maintained.counts(spark, folder)) == [("closed", 1), ("open", 1)]
