"""Listings read by many ranges of bytes: the same rows as from one range, or as Python's csv reads them."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from wayfold.sources import listings, ranges

SETTINGS = ["spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes"]


@pytest.fixture
def small_ranges(spark):
    def put(size, parts=120):
        for k, v in zip(SETTINGS, (0, parts, size), strict=True):
            spark.conf.set(k, str(v))

    yield put
    for k in SETTINGS:
        spark.conf.unset(k)


def test_quotes_across_ranges_as_python_reads_them(spark, tmp_path, small_ranges):
    draw = random.Random(3)
    value = lambda: "".join(draw.choice(["a", "é", '"', "\n", ",", ";", "\r\n", "b\\"]) for _ in range(draw.randint(1, 9)))
    made = [[f"r{i}", "x" + value() + "x", "x" + value() * draw.choice([1, 1, 30]) + "x"] for i in range(150)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([["Key", "First", "Second"], *made])
    path = tmp_path / "one.csv"
    path.write_text("﻿" + text.getvalue(), encoding="utf-8", newline="")
    small_ranges(path.stat().st_size // 110)
    assert ranges.lines_of(spark, str(path)).rdd.getNumPartitions() >= 100
    out = listings.read_csv(spark, str(path), ["Key", "First", "Second"])
    assert sorted(tuple(r) for r in out.collect()) == sorted(map(tuple, made))


def test_short_long_and_blank_rows_and_doubled_quotes(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('K,V\r\n1," say ""hi"", "\r\n\r\n2\r\n3,c,extra\r\n 4 , d \r\n5,"open\r\nto the end', encoding="utf-8", newline="")
    small_ranges(7, 5)
    rows = sorted(tuple(r) for r in listings.read_csv(spark, str(tmp_path / "a.csv"), ["K", "V"]).collect())
    assert rows[:3] == [("1", 'say "hi",'), ("3", "c"), ("4", "d")] and rows[3][0] == "5"


def test_a_folder_is_one_listing_in_parts(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i, text in enumerate(["K,V\n1,\"a\n", "b\"\n2,", "c\n"]):
        (folder / f"part-{i}").write_text(text, newline="")
    # a part ends its last line, as Spark's own parts do
    out = listings.read_csv(spark, str(folder), ["K", "V"])
    assert sorted(tuple(r) for r in out.collect()) == [("1", "a\nb"), ("2", "")]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        listings.read_csv(spark, str(empty), ["K"])


def test_markdown_from_many_ranges(spark, tmp_path, small_ranges):
    draw = random.Random(8)
    lines = []
    for i in range(400):
        kind = draw.random()
        lines.append(f"# Region {i}" if kind < 0.03 else f"## County {i}" if kind < 0.1 else f"**{i}. Clinic {i}**" if kind < 0.35 else f"- \U0001f4cd {i} Main St" if kind < 0.6 else f"\U0001f4de {i}" if kind < 0.7 else f"\U0001f310 w{i}" if kind < 0.8 else "" if kind < 0.9 else "remark")
    path = tmp_path / "list.md"
    path.write_text("\n".join(lines), encoding="utf-8")
    expected, region, county, record = [], None, None, None
    for line in lines:
        if line.startswith("# "):
            region, county = line[2:], None
        elif line.startswith("## "):
            county = line[3:]
        elif line.startswith("**"):
            record = {"name": line.strip("*").split(". ")[1], "addresses": [], "phone": None, "website": None, "region": region, "county": county}
            expected.append(record)
        elif record and "\U0001f4cd" in line:
            record["addresses"].append(line[4:])
        elif record and line[:1] in "\U0001f4de\U0001f310" and line:
            key = "phone" if line[0] == "\U0001f4de" else "website"
            record[key] = record[key] or line[2:]
    small_ranges(path.stat().st_size // 100)
    lines_read = ranges.lines_of(spark, str(path))
    assert lines_read.rdd.getNumPartitions() >= 100
    out = listings.read_markdown(spark, str(path)).select("name", "addresses", "phone", "website", "region", "county")
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(repr(tuple(r.values())) for r in expected if r["addresses"])


def test_two_lists_in_a_folder_do_not_mix(spark, tmp_path):
    (tmp_path / "a.md").write_text("# South\n1. One\n\U0001f4cd 1 A St\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("2. Two\n\U0001f4cd 2 B St\n", encoding="utf-8")
    out = lambda whole: sorted((r.name, r.region) for r in listings.read_markdown(spark, str(tmp_path), whole).collect())
    assert out(False) == [("One", "South"), ("Two", None)]
    assert out(True) == [("One", "South"), ("Two", "South")]
    assert ranges.lines_of(spark, str(tmp_path)).where(F.col("text") == "").count() == 0
