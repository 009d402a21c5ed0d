"""The nearest places of every point against all pairs."""

import math
import random

import pytest

from wayfold.functions import geo
from wayfold.operators import nearby


def _miles(a, b, c, d):
    chord = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.EARTH_MILES * math.atan2(math.sqrt(chord), math.sqrt(1 - chord))


@pytest.mark.parametrize("shape", ["world", "poles", "date line", "crowd", "few"])
def test_equal_to_all_pairs(spark, shape, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 8)
    monkeypatch.setattr(nearby, "SHELF", 3)
    draw = random.Random(shape)
    spot = {
        "world": lambda: (draw.uniform(-90, 90), draw.uniform(-180, 180)), "poles": lambda: (draw.choice([-1, 1]) * draw.uniform(88, 90), draw.uniform(-180, 180)),
        "date line": lambda: (draw.uniform(-5, 5), draw.choice([-179.5, 179.5, 180.0, -180.0]) + draw.uniform(0, 0.4)),
        "crowd": lambda: (27.0, -80.0) if draw.random() < 0.6 else (27 + draw.gauss(0, 0.01), -80 + draw.gauss(0, 3)), "few": lambda: (draw.uniform(-90, 90), draw.uniform(-180, 180)),
    }[shape]
    places = [(i % 3, i, *spot()) for i in range(3 if shape == "few" else 150)]
    points = [(i, *spot()) for i in range(40)]
    out = nearby.nearest_to_each(spark.createDataFrame(points, "point int, lat double, lng double"), spark.createDataFrame(places, "kind int, id int, lat double, lng double"), 5, order=["kind", "id"])
    found = {}
    for r in out.collect():
        found.setdefault(r.point, []).append((r.nth, r.miles, r.kind, r.id))
    for p, a, b in points:
        away = sorted((_miles(a, b, c, d), kind, i) for kind, i, c, d in places)
        own = sorted(found[p])
        assert [n for n, *_ in own] == list(range(1, len(own) + 1)) and len(own) == min(5, len(places))
        assert [m for _, m, _, _ in own] == pytest.approx([m for m, _, _ in away[:5]], abs=2e-5)
        assert [own[i][1:] for i in range(len(own))] == sorted(own[i][1:] for i in range(len(own)))
        assert {(k, i) for _, m, k, i in own if m < away[min(5, len(away)) - 1][0] - 1e-4} == {(k, i) for m, k, i in away[:5] if m < away[min(5, len(away)) - 1][0] - 1e-4}


def test_odd_rows(spark):
    places = spark.createDataFrame([(1, None, 2.0), (2, 1.0, float("nan")), (3, 95.0, 0.0), (4, 1.0, 1.0), (5, 1.0, 1.0)], "id int, lat double, lng double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 1.0), (3, -1.0, -179.0)], "point int, lat double, lng double")
    out = sorted((r.point, r.nth, r.id) for r in nearby.nearest_to_each(points, places, 1).collect())
    assert out == [(1, 1, 4), (1, 1, 4), (3, 1, 4)]
    assert nearby.nearest_to_each(points, places.where("false"), 2).columns == ["point", "nth", "miles", "id"]
    assert nearby.nearest_to_each(points.where("false"), places, 2).count() == 0
