"""Exact top-k by inner product with M-trees.

Integer vectors get one more coordinate, ``sqrt(largest squared norm - own squared norm)``; then the largest inner product
with a query is the least Euclidean distance, and a metric tree applies. The vectors are dealt to the nearest of ``PIVOTS``
pivots at most, in shards of ``SHARD_ROWS`` at most, and every shard becomes an M-tree of pages: each entry holds its routing vector, its
covering radius and its distance to the parent. A search takes pages in the order of their least possible distance, stops
beyond the k-th best so far, and leaves out entries whose stored parent distance already shows that they are too far.
Scores are integers, so results are exact; the bounds are floating point with some slack.

The query set goes through the shards in blocks of ``BLOCK`` queries of like pivots, twice: first only through those of each query's
own pivot, which tells how good the k-th best is at least; then through those of the pivots whose ball of vectors can hold a
better one (a table of a row for each pivot decides that before any shard is read). A first bound comes from a bounded pool.

Shards and blocks meet in a grid: a lane has ``LANE_SHARDS`` shards at most, a part about ``PART_BLOCKS`` blocks. A block is sent once to each
lane that has a shard for it (not to each pivot), a shard once to each part; a task holds one lane and one part. Neither side is ever
broadcast, and a lane returns of each query the k best that can still be among its results.

Vectors whose squared norm is beyond ``NARROW`` are too long for exact floating point. They take part by Python's integers, block by
block, as queries and as candidates; their scores beyond 64 bits rank by their true value and are shown as the nearest
64-bit number.

Cases: vectors that are null, of another length than most (of lengths equally common, the least), or hold null or non-finite
components take no part; of equal vectors only the k + 1 least ids can be among k results, the others are left out before the
shuffle; ties go to the smaller id; repeated rows are one; an id with several vectors is a candidate once with each, never its own
query's, and asks with all of them together; null ids take no part; with fewer candidates than k all are returned; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import bounded_batches, materialize, thinned

SHARD_ROWS, PIVOTS, PAGE, BLOCK, POOL = 4096, 1024, 16, 1024, 2048
#: Shards of a lane and blocks of a part at most; up to so many lanes each shard is a lane of its own, for more tasks.
LANE_SHARDS, PART_BLOCKS, LEAST_LANES = 32, 64, 64
#: Squared norms of vectors in trees: no score is larger, and sums of so large products are exact in double precision.
NARROW = float(1 << 41)
#: Blocks of the rare long vectors, and lanes in which they meet the others.
WIDE_BLOCK, WIDE_LANES = 256, 32
_DIGITS = 640
_SLACK = 1e-6
#: Places of a shard in the low digits of a number whose high digits are a score.
_PLACES, _NONE = 1 << 20, np.iinfo(np.int64).min


def usable(vector: str) -> Column:
    """Vectors without null and non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def scaled(vector: str, factor: int = 256) -> Column:
    """Every component as floor(factor * x)."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def lifted(vectors: np.ndarray, most: int) -> np.ndarray:
    """The vectors with the coordinate that makes all norms equal."""
    rest = most - (vectors * vectors).sum(axis=1)
    return np.hstack([vectors.astype(float), np.sqrt(np.maximum(rest, 0))[:, None]])


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of n points far from each other: each the farthest from those before; fewer if points are equal."""
    chosen, near = [0], _distances(points, points[0])
    while len(chosen) < n:
        at = int(near.argmax())
        if near[at] <= 0:
            break
        chosen.append(at)
        near = np.minimum(near, _distances(points, points[at]))
    return np.array(chosen)


def grow(points: np.ndarray, members: np.ndarray, parent: np.ndarray) -> dict:
    """A page over the members: a leaf, or routing entries with radii; all with their distances to the parent."""
    own = points[members]
    if len(members) <= PAGE:
        return {"leaf": members, "parent": _distances(own, parent)}
    chosen = spread(own, PAGE)
    if len(chosen) == 1:  # equal points: any split will do
        groups, chosen = np.array_split(np.arange(len(members)), PAGE), np.zeros(PAGE, np.int64)
    else:
        nearest = np.stack([_distances(own, own[c]) for c in chosen]).argmin(axis=0)
        groups = [np.flatnonzero(nearest == j) for j in range(len(chosen))]
    kept = [(c, g) for c, g in zip(chosen, groups, strict=True) if len(g)]
    routing = own[[c for c, _ in kept]]
    radii = np.array([_distances(own[g], own[c]).max() for c, g in kept])
    return {"routing": routing, "radius": radii, "parent": _distances(routing, parent), "pages": [grow(points, members[g], own[c]) for c, g in kept]}


def narrowed(vectors: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes that hold them all."""
    reach = int(np.abs(vectors).max(initial=0))
    return vectors.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if reach <= np.iinfo(t).max))


def walk(tree: dict, queries: np.ndarray, query_ids: np.ndarray, k: int, bounds: np.ndarray) -> np.ndarray:
    """A row for each query with the k best of a tree within the distance ``bounds``: score and place in one number, or none.

    The queries of a block walk the tree together: a page is taken in the order of its least possible distance from any
    of them, and is seen by those queries that it can still serve. ``tree``: root, centre, ids (ascending), vectors, most.
    """
    ids, vectors = tree["ids"], tree["vectors"].astype(float)  # products of such integers are exact in double precision
    asked = queries.astype(float)
    sizes = (asked * asked).sum(axis=1) + tree["most"]
    points = np.hstack([asked, np.zeros((len(asked), 1))])
    limits = bounds * (1 + _SLACK) + _SLACK
    best = np.full((len(asked), k), _NONE, dtype=np.int64)  # score and place in one number: larger scores, then smaller ids
    queue: list[tuple[float, int, dict, np.ndarray, np.ndarray]] = [(0.0, 0, tree["root"], np.zeros(len(asked)), _distances(points, tree["centre"]))]
    number = 1
    while queue:
        _, _, page, lower, to_parent = heapq.heappop(queue)
        served = np.flatnonzero(lower <= limits)
        if not len(served):
            continue
        away, reach = to_parent[served], limits[served]
        if "leaf" in page:
            # entries that the stored distances already show to be too far from every query served are not looked at
            lo, hi = page["parent"][:, None] - away <= reach, away - page["parent"][:, None] <= reach
            members = page["leaf"][(lo & hi).any(axis=1)]
            scores = np.rint(asked[served] @ vectors[members].T).astype(np.int64)
            made = scores * _PLACES + (_PLACES - 1 - members)
            made[query_ids[served][:, None] == ids[members]] = _NONE
            own = np.hstack([best[served], made])
            best[served] = np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k :]
            worst = best[served].min(axis=1)
            full = worst > _NONE
            far = np.sqrt(np.maximum(sizes[served] - 2.0 * (worst // _PLACES), 0)) * (1 + _SLACK) + _SLACK
            limits[served] = np.where(full, np.minimum(reach, far), reach)
        else:
            for entry in range(len(page["pages"])):
                radius, parent = page["radius"][entry], page["parent"][entry]
                near = served[np.abs(parent - away) - radius <= reach]
                if not len(near):
                    continue
                d = np.full(len(asked), np.inf)
                d[near] = _distances(points[near], page["routing"][entry])
                least = np.maximum(d - radius, 0)
                heapq.heappush(queue, (float(least[near].min()), number, page["pages"][entry], least, d))
                number += 1
    return best


def search(tree: dict, queries: np.ndarray, query_ids: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a tree for each query, within the distance ``bounds``: query, id and score."""
    best = walk(tree, queries, query_ids, k, bounds)
    row, column = np.nonzero(best > _NONE)
    found = best[row, column]
    return query_ids[row], tree["ids"][_PLACES - 1 - found % _PLACES], found // _PLACES


def _nearest(pivots: np.ndarray, most: int, lift: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, v) with the nearest pivot and the distance from it; queries are not lifted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                vectors = _matrix(part.column("v"))
                points = lifted(vectors, most) if lift else np.hstack([vectors.astype(float), np.zeros((len(vectors), 1))])
                near = ((points**2).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(axis=1)[None]).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(near.astype(np.int32)), pa.array(_distances(points, pivots[near]))], ["id", "v", "pivot", "away"])

    return work


_DEALT = "id long, v array<long>, pivot int, away double"


def laid_out(counts: dict[int, int]) -> dict[int, range]:
    """The numbers of the shards in which each pivot's vectors are dealt."""
    out, at = {}, 0
    for pivot, n in sorted(counts.items()):
        out[pivot] = range(at, at := at + -(-n // SHARD_ROWS))
    return out


def build(dealt: DataFrame, most: int, layout: dict[int, range], lanes: int) -> DataFrame:
    """A row for each shard: its lane, its pivot and its tree."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id"], kind="stable")
        vectors = np.array(pdf["v"].tolist(), dtype=np.int64)
        points = lifted(vectors, most)
        centre = points[0]
        made = {"root": grow(points, np.arange(len(points)), centre), "centre": centre, "ids": pdf["id"].to_numpy(), "vectors": narrowed(vectors), "most": most}
        return pd.DataFrame({"lane": [int(pdf["shard"].iloc[0]) % lanes], "pivot": [int(pdf["pivot"].iloc[0])], "tree": [pickle.dumps(made)]})

    first, parts = (F.create_map(*[F.lit(x) for pair in told.items() for x in pair])[F.col("pivot")] for told in ({p: r.start for p, r in layout.items()}, {p: len(r) for p, r in layout.items()}))
    return dealt.select("id", "v", "pivot", (first + F.pmod(F.xxhash64("id", "v"), parts)).alias("shard")).groupBy("shard").applyInPandas(tree, "lane int, pivot int, tree binary")


def _limits(vectors: np.ndarray, kth: np.ndarray, most: int) -> np.ndarray:
    """The distances beyond which nothing beats the scores ``kth``."""
    return np.sqrt(np.maximum((vectors * vectors).sum(axis=1) + most - 2.0 * kth, 0))


def _by_trees(rows: DataFrame, k: int, dims: int) -> DataFrame:
    """query_id, vec_id and score of at least the k best for each query, among (id, v, q) of vectors that fit."""
    spark, schema = rows.sparkSession, "query_id long, vec_id long, score long"
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("most")).first()
    if not facts.n:
        return spark.createDataFrame([], schema)
    most = facts.most
    first = Window.partitionBy("v").orderBy("id")
    candidates = materialize(rows.select("id", "v").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("id", "v"), "mtree-candidates")
    pool = thinned(candidates, ["id"], POOL, seed=5).orderBy("id", "v").toPandas()
    pool_ids, pool_vectors = pool["id"].to_numpy(dtype=np.int64), np.array(pool["v"].tolist(), dtype=np.int64).reshape(len(pool), dims)
    points = lifted(pool_vectors, most)
    n_pivots = max(1, min(PIVOTS, facts.n // (SHARD_ROWS // 2), len(points)))
    pivots = points[np.random.default_rng(3).permutation(len(points))[:n_pivots]] if len(points) else np.zeros((1, dims + 1))
    dealt = materialize(candidates.mapInArrow(_nearest(pivots, most, True), _DEALT), "mtree-dealt")
    balls = {r.pivot: (r.n, r.radius) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    radius = np.array([balls.get(p, (0, -np.inf))[1] for p in range(len(pivots))])
    layout = laid_out({p: n for p, (n, _) in balls.items()})
    n_shards = sum(len(r) for r in layout.values())
    lanes = max(1, min(n_shards, LEAST_LANES), -(-n_shards // LANE_SHARDS))
    lanes_of = {p: {n % lanes for n in r} for p, r in layout.items()}
    trees = materialize(build(dealt, most, layout, lanes), "mtree-trees", large_rows=True) if layout else spark.createDataFrame([], "lane int, pivot int, tree binary")
    nothing = np.iinfo(np.int64).min // 4

    def reached(vectors: np.ndarray, near: np.ndarray, kth: np.ndarray, p: int) -> np.ndarray:
        """Queries to which a vector of another pivot than their own can be as near as their k-th best."""
        asked = np.hstack([vectors.astype(float), np.zeros((len(vectors), 1))])
        return (near != p) & (_distances(asked, pivots[p]) - radius[p] <= _limits(vectors, kth, most) * (1 + _SLACK) + _SLACK)

    def sent(again: bool, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Blocks of queries with the bounds that they have by now, once for each lane with shards of the pivots that they need."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    some = batch.slice(low, BLOCK)
                    ids, vectors, near = np.asarray(some.column("id")), _matrix(some.column("v")), np.asarray(some.column("pivot"))
                    scores = vectors @ pool_vectors.T
                    scores[ids[:, None] == pool_ids[None]] = nothing
                    kth = np.sort(scores, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(ids), nothing)
                    if again:
                        kth = np.maximum(kth, np.asarray(some.column("kth").fill_null(nothing)))
                        wanted = [p for p in lanes_of if reached(vectors, near, kth, p).any()]
                    else:
                        wanted = [p for p in np.unique(near).tolist() if p in lanes_of]
                    block = pickle.dumps((ids, narrowed(vectors), near, kth))
                    for lane in sorted(set().union(*[lanes_of[p] for p in wanted])):
                        yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([zlib.crc32(block) % parts], pa.int32()), pa.array([block], pa.binary())], ["lane", "part", "block"])

        return work

    def found_in_lane(again: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def work(blocks: pa.Table, shards: pa.Table) -> pa.Table:
            trees = [(p.as_py(), pickle.loads(t.as_py())) for p, t in zip(shards.column("pivot"), shards.column("tree"), strict=True)]
            out = []
            for raw in blocks.column("block"):
                ids, vectors, near, least = pickle.loads(raw.as_py())
                vectors, kth = vectors.astype(np.int64), least.copy()
                held_scores, held_ids = np.full((len(ids), k), _NONE), np.zeros((len(ids), k), np.int64)
                for pivot, tree in trees:
                    mine = np.flatnonzero(reached(vectors, near, kth, pivot) if again else near == pivot)
                    if not len(mine):
                        continue
                    best = walk(tree, vectors[mine], ids[mine], k, _limits(vectors[mine], kth[mine], most))
                    there = best > _NONE
                    scores = np.hstack([held_scores[mine], np.where(there, best // _PLACES, _NONE)])
                    of = np.hstack([held_ids[mine], np.where(there, tree["ids"][np.where(there, _PLACES - 1 - best % _PLACES, 0)], 0)])
                    order = np.lexsort((of, -np.maximum(scores, _NONE + 1)), axis=-1)[:, :k]
                    held_scores[mine], held_ids[mine] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(of, order, axis=1)
                    kth[mine] = np.maximum(kth[mine], held_scores[mine, k - 1])
                row, column = np.nonzero((held_scores > _NONE) & (held_scores >= least[:, None]))
                out.append(pa.table([pa.array(x, pa.int64()) for x in (ids[row], held_ids[row, column], held_scores[row, column])], ["query_id", "vec_id", "score"]))
            return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

        return work

    def searched(asked: DataFrame, again: bool) -> DataFrame:
        blocks = asked.mapInArrow(sent(again, parts), "lane int, part int, block binary")
        shards = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return blocks.groupBy("lane", "part").cogroup(shards.groupBy("lane", "part")).applyInArrow(found_in_lane(again), schema)

    asked = materialize(rows.where("q").select("id", "v").distinct().mapInArrow(_nearest(pivots, most, False), _DEALT).repartitionByRange("pivot", "id").sortWithinPartitions("pivot", "id"), "mtree-asked")
    parts = max(1, -(-asked.count() // (BLOCK * PART_BLOCKS)))
    near = materialize(searched(asked, False).distinct(), "mtree-near")
    # an id with several vectors asks with all of them: the bound of one holds for it alone, so such ids keep none
    single = asked.groupBy(F.col("id").alias("query_id")).agg(F.count("*").alias("n")).where("n = 1").select("query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.join(single, "query_id").withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    again = asked.join(kth, "id", "left").repartitionByRange("pivot", "id").sortWithinPartitions("pivot", "id").select("id", "v", "pivot", "kth")
    return near.unionByName(searched(again, True))


def _whole(column: pa.Array, factor: int) -> list[list[int]]:
    """floor(factor * x) of each component, in Python's integers."""
    return [[int(x) * factor if abs(x) >= 1 << 60 else math.floor(factor * x) for x in row] for row in column.to_pylist()]


def _sortable(score: int) -> str:
    """Digits in the order of the numbers."""
    return "1" + str(score).zfill(_DIGITS) if score >= 0 else "0" + str(10**_DIGITS + score).zfill(_DIGITS)


def _by_integers(asked: DataFrame, held: DataFrame, k: int, factor: int) -> DataFrame:
    """The k best of blocks of ``held`` for each query in ``asked``: query_id, vec_id, score, and sortable digits. Both have id and v (doubles)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for low in range(0, part.num_rows, WIDE_BLOCK):
                some = part.slice(low, WIDE_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((some.column("id").to_pylist(), _whole(some.column("v"), factor)))], pa.binary())], ["block"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for raw_asked, raw_held in zip(part.column("block").to_pylist(), part.column("other").to_pylist(), strict=True):
                (queries, wanted), (ids, vectors) = pickle.loads(raw_asked), pickle.loads(raw_held)
                out = []
                for q, w in zip(queries, wanted, strict=True):
                    scores = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in zip(ids, vectors, strict=True) if i != q)
                    out += [(q, i, -s) for s, i in scores[:k]]
                columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([max(-(1 << 63), min((1 << 63) - 1, x[2])) for x in out], pa.int64()), pa.array([_sortable(x[2]) for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "digits"])

    lanes = F.explode(F.sequence(F.lit(0), F.lit(WIDE_LANES - 1)))
    one = asked.select("id", "v").mapInArrow(blocks, "block binary").select("block", lanes.alias("lane"))
    other = held.select("id", "v").mapInArrow(blocks, "block binary").select(F.col("block").alias("other"), F.pmod(F.xxhash64("block"), F.lit(WIDE_LANES)).cast("int").alias("lane"))
    return one.join(other, "lane").select("block", "other").mapInArrow(find, "query_id long, vec_id long, score long, digits string")


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int, factor: int = 256) -> DataFrame:
    """For each query row the k largest inner products with other rows: query_id, rank, vec_id, score."""
    bounded_batches(df.sparkSession)
    good = df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dims = sizes.d if sizes else 0
    good = good.where(F.size("v") == dims)
    fits = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * float(factor)) * (x * float(factor))) + F.lit(4.0 * dims) < NARROW / 2
    rows = materialize(good.where(fits).select("id", scaled("v", factor).alias("v"), "q").distinct(), "mtree-rows")
    wide = materialize(good.where(~fits).distinct(), "mtree-wide")
    found = _by_trees(rows, k, dims)
    order = [F.desc("score")]
    if not wide.isEmpty():
        digits = F.when(F.col("score") >= 0, F.concat(F.lit("1"), F.lpad(F.col("score").cast("string"), _DIGITS, "0"))).otherwise(F.concat(F.lit("0" + "9" * (_DIGITS - 19)), F.lpad((F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("score")).cast("string"), 19, "0")))
        every = good.select("id", "v").distinct()
        found = found.withColumn("digits", digits).unionByName(_by_integers(good.where(fits & F.col("q")).select("id", "v").distinct(), wide, k, factor)).unionByName(_by_integers(wide.where("q"), every, k, factor))
        order = [F.desc("digits")]
    best = Window.partitionBy("query_id").orderBy(*order, "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)
