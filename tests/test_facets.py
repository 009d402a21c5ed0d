"""Facet counts from bitmaps equal counts over the rows."""

import random

from wayfold.operators import facets

UNDER = {"region": [], "county": ["region"], "tags": ["region", "county"], "free": ["tags", "region"]}


def _plain(rows, choices):
    has = lambda r, f, v: v in (r[f] or []) if f == "tags" else r[f] is not None and str(r[f]).lower() == v.lower()
    out = {}
    for facet, rulers in UNDER.items():
        for r in rows:
            values = set(r["tags"] or []) if facet == "tags" else {r[facet]}
            met = all(has(r, g, choices[g]) for g in rulers if choices.get(g))
            for v in values - {None, ""}:
                key = facet, str(v).lower() if facet == "free" else v
                out[key] = out.get(key, 0) + met
    for f, v in choices.items():
        if v:
            out.setdefault((f, v), 0)
    return {k: (n, choices.get(k[0]) == k[1], choices.get(k[0]) == k[1] and n > 0) for k, n in out.items()}


def test_counts_under_choices(spark):
    draw = random.Random(2)
    rows = [{"region": draw.choice(["N", "S", "", None]), "county": draw.choice("abcde"), "tags": draw.choice([None, [], ["x"], ["x", "y", "x"], ["z", None, ""]]), "free": draw.choice([True, False, None])} for _ in range(500)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "region string, county string, tags array<string>, free boolean").repartition(7)
    held = facets.index(df, list(UNDER))
    for choices in ({}, {"region": "N"}, {"region": "N", "county": "a"}, {"region": "S", "county": "b", "tags": "y"}, {"region": "W", "county": "a"}, {"region": None, "county": "", "tags": "z"}):
        out = {(r.facet, r.value): (r.n, r.chosen, r.kept) for r in facets.counts(held, choices, UNDER).collect()}
        assert out == _plain(rows, choices), choices


def test_blocks_and_empty_tables(spark):
    df = spark.range(100_000).selectExpr("CAST(id % 3 AS STRING) AS a", "CAST(id % 50000 AS STRING) AS b").coalesce(1)
    held = facets.index(df.selectExpr("a", "CASE WHEN b < '2' THEN b ELSE 'rest' END AS b"), ["a", "b"])
    assert held.select("block").distinct().count() >= 4
    out = {r.value: r.n for r in facets.counts(held, {"b": "1"}, {"a": ["b"]}).where("facet = 'a'").collect()}
    assert out == {"0": 1, "1": 1, "2": 0}  # rows 1 and 50001
    none = facets.index(df.where("a = 'no'"), ["a", "b"])
    assert facets.counts(none, {}, {}).count() == 0
    assert [tuple(r) for r in facets.counts(none, {"a": "1"}, {"b": ["a"]}).collect()] == [("a", "1", 0, True, False)]
