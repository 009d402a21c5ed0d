"""Learned partitions, filter orders and K2-treaps: brute force, recall, odd rows."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm import filters, routing, treap
from wayfold.llm.common import text_bytes

ODD = [(None, "a null id"), (7001, None), (7002, ""), (7003, "\t \n"), (7004, "é ñ ÀB c"), (7005, "word " * 4000), (7006, "twin twin"), (7006, "twin twin"), (7006, "other")]


# ---- learned partitions


def _nearest(vectors, query, k):
    q, v = query
    away = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), i) for i, w in vectors if i != q)
    return away[:k]


def _recall(spark, held, step, k=10):
    df = spark.createDataFrame(held, "vec_id long, embedding array<double>").repartition(4)
    found = defaultdict(list)
    for r in routing.top_k(df, "vec_id", "embedding", F.col("vec_id") % step == 0, k).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i, v in held:
        if i % step == 0:
            true = _nearest(held, (i, v), k)
            own = sorted(found[i])
            assert [x[0] for x in own] == list(range(1, len(own) + 1))
            assert [(s, n) for _, n, s in own] == sorted((s, n) for _, n, s in own)
            by = dict(held)
            assert all(s == pytest.approx(math.dist(v, by[n]), rel=1e-12) for _, n, s in own)
            hits, total = hits + len({n for _, n, _ in own} & {n for _, n in true}), total + len(true)
    return hits / total


@pytest.mark.parametrize("shape", ["clusters", "sphere"])
def test_recall_against_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(routing, "SHARD_ROWS", 64)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 16)) + (rng.normal(size=(12, 16)) * 6)[rng.integers(0, 12, 1500)] if shape == "clusters" else rng.normal(size=(1500, 16))
    if shape == "sphere":
        points /= np.linalg.norm(points, axis=1)[:, None]
    assert _recall(spark, [(i, p.tolist()) for i, p in enumerate(points)], 25) >= 0.9


def test_clustered_queries_search_few_parts():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(3000, 16)) + (rng.normal(size=(30, 16)) * 8)[rng.integers(0, 30, 3000)]
    router = routing.fit(points, 10)
    assert router.searched(points[:200]).sum(axis=1).mean() < 0.35 * router.layers[3].shape[0]


def test_parts_are_balanced_and_cut_few_links():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(960, 8)) + (rng.normal(size=(16, 8)) * 5)[rng.integers(0, 16, 960)]
    links = routing.neighbours(points, points, 10, True)
    own = routing.partition(points, links, 16)
    assert np.bincount(own, minlength=16).max() <= math.ceil(960 / 16 * (1 + routing.ROOM))
    shuffled = np.random.default_rng(1).permutation(own)
    assert (own[links] == own[:, None]).mean() > 3 * (shuffled[links] == shuffled[:, None]).mean()
    assert all(i not in row for i, row in enumerate(links))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    held = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [1.0]), (2, [0.0, 1.0]), (9, [1e200, 1e200]), (10, [5.0, 5.0]), (10, [1.0, 0.5])]
    df = spark.createDataFrame(held, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("part", F.lit(1))
    out = {r.query_id: [] for r in df.select(F.col("vec_id").alias("query_id")).collect()}
    for r in routing.top_k(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, 3).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, round(r.score, 6)))
    assert out[0] == [(1, 0.0), (10, 0.5), (2, round(math.sqrt(2), 6))]
    assert [x[0] for x in out[10]] == [0, 1, 2] and out[10][0][1] == 0.5
    assert routing.top_k(df.where("false"), "vec_id", "embedding", F.lit(True), 3).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>")
    found = routing.top_k(ties, "vec_id", "embedding", F.col("vec_id") == 5, 4).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [0, 1, 2, 3]


# ---- filter orders


def _audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    failed = []
    for i, part, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")
        f += "E" if i is not None and any((u or "") == t and j is not None and j < i for j, _, u in docs) else ""
        failed.append((part or "", f, i))
    out = {}
    for part in {p for p, _, _ in failed}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                letter, before = order[step - 1], set(order[: step - 1])
                own = [(f, i) for p, f, i in failed if p == part]
                removed = [(f, i) for f, i in own if letter in f and not before & set(f)]
                shapley[letter] += len(removed)
                out[part, order, step] = [sum(not (before | {letter}) & set(f) for f, _ in own), len(removed), sum(letter in f for f, _ in own) - len(removed), sum(f == letter for f, _ in own), sum(i in good for _, i in removed), sum(i in toxic for _, i in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("sketch_bytes", [filters.SKETCH_BYTES, 0])
def test_orders_equal_brute_force(spark, sketch_bytes, monkeypatch):
    monkeypatch.setattr(filters, "SKETCH_BYTES", sketch_bytes)
    draw = random.Random(1)
    texts = [" ".join(draw.choice(["one", "two", "Three", "FOUR", "five$", "six", *map(str, range(300))]) for _ in range(draw.choice([3, 60, 200]))) for _ in range(60)]
    docs = [(i, draw.choice(["a", "b", None, ""]), draw.choice(texts[:6]) if draw.random() < 0.4 else texts[i % 60]) for i in range(150)]
    docs += [(i, "a", t) for i, t in ODD] + [(None, "b", texts[0])]
    labels = [(i, draw.randint(0, 1), draw.randint(0, 1)) for i in range(0, 150, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5).withColumn("hash", F.lit(1)).withColumn("part", F.lit("clash"))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filters.audit(df, "doc_id", "text", "source", filters.text_checks(), told, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, filters.word_column())
    found = {(r["part"], r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}
    assert found == _audit(docs, labels)
    empty = filters.audit(df.where("false"), "doc_id", "text", "source", filters.text_checks(), told, {"good": F.col("quality") == 1}, filters.word_column())
    assert empty.count() == 0 and "good_lost" in empty.columns


def test_the_sketch_clears_unique_texts_and_no_others(spark):
    n = 20_000
    hashes = spark.range(n).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 500).otherwise(F.col("id"))).alias("hash"), "id").repartition(6)
    segments = -(-n // filters.SEGMENT_TEXTS)
    merged = {r.segment: bytes(r.bits) for r in filters.sketch(hashes, segments).collect()}
    told = hashes.withColumn("possible", filters.uncleared(merged, segments, spark))
    counts = told.withColumn("times", F.count("*").over(Window.partitionBy("hash"))).groupBy(F.col("times") > 1, "possible").count().collect()
    sums = {(r[0], r[1]): r[2] for r in counts}
    assert (True, False) not in sums  # a repeat is never cleared
    assert sums.get((False, True), 0) < 0.03 * n


# ---- ranked search


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, k):
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, total, df = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n_docs) // max(1, total)
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in Counter(_terms(text)).items() if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_docs", [4096, 7])
def test_ranks_equal_brute_force(spark, shard_docs, monkeypatch):
    monkeypatch.setattr(treap, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(treap, "BLOCK_TERMS", 60)
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ñandú", "A1", "x-y", "don't"]
    text = lambda most: " ".join(vocabulary[min(int(draw.expovariate(0.15)), 34)] for _ in range(draw.randint(0, most)))
    docs = [(i, text(50)) for i in range(120)] + [(500 + i, "the same Words again") for i in range(30)] + ODD
    items = [(i, text(12)) for i in range(15)] + [(20, "same words"), (21, None), (22, "- . !"), (23, "unheard"), (24, "twin"), (24, "twin"), (25, "null"), (None, "again the")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("score", F.lit(0))
    out = treap.top_k(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 20)
    assert sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == _ranked(docs, list(dict.fromkeys(items)), 20)
    assert treap.top_k(df.where("false"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 20).count() == 0
    assert treap.top_k(df, "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text", 20).count() == 0


def test_quarters_hold_the_maxima_of_the_grid():
    rng = np.random.default_rng(3)
    grid = np.where(rng.random((13, 13)) < 0.3, rng.integers(1, 10**6, (13, 13)), 0)
    row, column = np.nonzero(grid)
    below, tops = treap.quarters(row, column, grid[row, column], 4)
    whole = np.zeros((16, 16), np.int64)
    whole[:13, :13] = grid
    for level in range(5):
        side = 16 >> level
        cells = whole.reshape(1 << level, side, 1 << level, side).max(axis=(1, 3))
        if level < 4:
            cells = -(-cells // treap.UNIT)
        assert sorted(tops[level].tolist()) == sorted(cells[cells > 0].tolist())
        if level < 4:
            assert treap._BITS[below[level]].sum() == len(tops[level + 1])


@pytest.mark.parametrize("width", [1, 3, 512])
def test_best_first_descent_finds_the_best_of_a_shard(width, monkeypatch):
    monkeypatch.setattr(treap, "WIDTH", width)
    rng = np.random.default_rng(width)
    texts = [" ".join(f"t{int(x)}" for x in rng.exponential(20, int(rng.integers(0, 60)))) for _ in range(90)]
    data, ends = text_bytes(pa.array(texts))
    row = treap._packed(np.arange(90), data, ends, 90, 2000)
    opened = treap.opened({c: row.column(c)[0].as_py() for c in row.schema.names})
    terms, rows, _, point_row, point_column, impact = treap.grid(data, ends, 90, 2000)
    table = np.zeros((len(terms), 90), np.int64)
    table[point_row, point_column] = impact
    for _ in range(20):
        some = rng.permutation(len(terms))[: int(rng.integers(1, 12))]
        weights = rng.integers(0, 5, len(some))
        scores = weights @ table[rows[some]]
        true = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)[:5]
        ids, found = treap.best(opened, terms[some], weights, 5, 1)
        assert [(-s, i) for s, i in zip(found.tolist(), ids.tolist(), strict=True)] == true
        floor = -true[2][0] if len(true) > 2 else 1
        ids, found = treap.best(opened, terms[some], weights, 5, floor)
        assert [(-s, i) for s, i in zip(found.tolist(), ids.tolist(), strict=True)] == [x for x in true if -x[0] >= floor]


def test_row_groups_of_the_index_end_by_bytes(spark, monkeypatch):
    """Neither the writer nor a reader of the index holds all shards of a task."""
    from pyarrow import parquet

    from wayfold.llm import common

    monkeypatch.setattr(common, "GROUP_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(treap, "SHARD_DOCS", 100)
    groups, real = [], treap.materialize

    def seen(df, name, *more, **options):
        out = real(df, name, *more, **options)
        if name == "treap-index":
            for path in out.inputFiles():
                told = parquet.read_metadata(path.removeprefix("file://"))
                groups.extend(told.row_group(i).num_rows for i in range(told.num_row_groups))
        return out

    monkeypatch.setattr(treap, "materialize", seen)
    docs = spark.range(3000).select("id", F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{i}"))) for i in range(10)]).alias("text")).coalesce(1)
    items = docs.where("id < 3")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = treap.top_k(docs, "id", "text", items, "id", "text", 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.item_id, r.doc_id) for r in got) == [(0, 0), (1, 1), (2, 2)]
    assert sum(groups) == 30 and max(groups) <= 3
