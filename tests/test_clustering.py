"""Screen clusters against a plain greedy run."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import clustering


def _plain(rows, zoom, finest):
    """rows: (order, lat, lng, kind, id)."""

    def at(lat, lng, level):
        side = 256 << level
        north = math.radians(max(min(lat, 85.0511287798), -85.0511287798))
        return (lng + 180) / 360 * side, (0.5 - math.log(math.tan(math.pi / 4 + north / 2)) / (2 * math.pi)) * side

    grain, cells = 60 / 8, {}
    for r in sorted(rows):
        x, y = at(r[1], r[2], finest)
        cells.setdefault((math.floor(x / grain), math.floor(y / grain)), []).append(r)
    items = [(c[0][0], c[0][1], c[0][2], list(c)) for c in cells.values()]
    for level in range(finest, zoom - 1, -1):
        middles = []
        for order, lat, lng, held in sorted(items):
            x, y = at(lat, lng, level)
            home = next((m for m in middles if (m[4] - x) ** 2 + (m[5] - y) ** 2 <= 3600), None)
            if home:
                home[3].extend(held)
            else:
                middles.append([order, lat, lng, list(held), x, y])
        items = [tuple(m[:4]) for m in middles]
    return sorted((m[0][1], m[0][2], len(m[3]), sum(r[3] == "clinic" for r in m[3])) for m in items)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_a_plain_greedy_run(spark, seed):
    draw = random.Random(seed)
    spots = [(draw.uniform(25, 31), draw.uniform(-87, -80)) for _ in range(4)]
    near = lambda: (lambda s: (s[0] + draw.gauss(0, 0.2), s[1] + draw.gauss(0, 0.2)))(draw.choice(spots))
    rows = [(draw.choice(["clinic", "lawyer"]), i, *(near() if draw.random() < 0.8 else (draw.uniform(24, 32), draw.uniform(-88, -79)))) for i in range(90)]
    rows += [("clinic", 200 + i, 27.0, -81.0) for i in range(9)] + [("lawyer", 300, None, 1.0), ("clinic", 200, 27.0, -81.0)]
    df = spark.createDataFrame(rows, "kind string, id long, lat double, lng double").repartition(3)
    told = [r for r in df.where("lat IS NOT NULL").dropDuplicates(["kind", "id"]).select(F.xxhash64("kind", "id").alias("h"), "kind", "id", "lat", "lng").collect()]
    out = clustering.screen_clusters(df, 6, 8)
    found = sorted((r.kind, r.id, r.places, r.clinics) for r in out.collect())
    assert found == _plain([((r.h, r.kind, r.id), r.lat, r.lng, r.kind, r.id) for r in told], 6, 8)
    assert sum(f[2] for f in found) == 99


def test_no_places(spark):
    assert clustering.screen_clusters(spark.createDataFrame([], "kind string, id long, lat double, lng double"), 6, 7).count() == 0
