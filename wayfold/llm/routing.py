"""Approximate nearest neighbours by learned partitions.

1. A bounded sample of the vectors (``SAMPLE`` rows, drawn by a hash) is linked to a graph of nearest neighbours, and the graph is cut
   into ``PARTS`` parts of nearly equal size with few links between them: a start from k-means under a size limit, then moves of
   vectors to the part where most of their neighbours are, while there is room.
2. A small classifier (one hidden layer) learns, for a vector, in which parts its neighbours are. A quarter of the sample is kept from it
   and tells how much probability the parts that are searched must add up to so that ``RECALL`` of the true neighbours in the sample are found.
3. Every vector goes to the index, in its most probable part; parts with many vectors are split into shards of ``SHARD_ROWS``.
4. A query is routed to its most probable parts, as many as that probability takes, and all their vectors are ranked by their exact distance.

Among vectors without structure neighbours spread over many parts, and the rule of step 2 then searches many: it buys recall with
work, not the other way round. Distances are those of the original vectors in double precision; one that overflows is infinite.

Cases: vectors that are null, zero, of another length than most (of lengths equally common, the least), or hold null or non-finite
components take no part; of equal vectors only the k + 1 least ids can be among k results, the others are left out before the shuffle;
ties go to the smaller id; repeated rows are one; an id with several vectors is a candidate with its nearest, never its own
query's, and asks with all of them; null ids take no part; with fewer candidates than k all are returned that the parts searched
hold, and all parts are searched where there are no more rows than a few for each part; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import bounded_batches, materialize, scratch, thinned
from wayfold.llm.mtree import usable

#: Rows that the model is fitted on, at most; parts, at most, and sampled rows for each at least.
SAMPLE, PARTS, PART_SAMPLE = 8192, 32, 32
#: Links of a vector in the graph, its room above the mean size of a part, rounds of moves.
LINKS, ROOM, MOVES = 30, 0.05, 20
HIDDEN, EPOCHS, BATCH, RATE = 128, 12, 256, 0.003
#: The share of the true neighbours that the held-out sample must find.
RECALL = 0.94
SHARD_ROWS, BLOCK = 8192, 256
#: Relative error of a distance from products of norms; what it cannot rule out is measured exactly.
_SLACK = 1e-9


def neighbours(points: np.ndarray, to: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Places in ``to`` of the k nearest to each point (leaving out the point itself if both are the same rows)."""
    out = []
    for low in range(0, len(points), 128):
        some = points[low : low + 128]
        away = (to**2).sum(axis=1)[None] - 2 * some @ to.T
        if same:
            away[np.arange(len(some)), low + np.arange(len(some))] = np.inf
        out.append(np.argpartition(away, k - 1, axis=1)[:, :k].copy())  # a view would keep the whole row
    return np.concatenate(out)


def _within(gain: np.ndarray, limit: int) -> np.ndarray:
    """The best column for each row, no column more than ``limit`` times: rows choose in the order of what they have to gain."""
    order = np.argsort(-(np.partition(gain, -1, axis=1)[:, -1] - np.partition(gain, -2, axis=1)[:, -2]) if gain.shape[1] > 1 else np.zeros(len(gain)), kind="stable")
    wish, out, load = np.argsort(-gain, axis=1, kind="stable"), np.zeros(len(gain), np.int64), np.zeros(gain.shape[1], np.int64)
    for row in order:
        column = next(c for c in wish[row] if load[c] < limit)
        out[row] = column
        load[column] += 1
    return out


def partition(points: np.ndarray, links: np.ndarray, parts: int) -> np.ndarray:
    """The part of each point: nearly equal sizes, few links between parts."""
    limit = int(np.ceil(len(points) / parts * (1 + ROOM)))
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:parts]]
    own = np.zeros(len(points), np.int64)
    for _ in range(5):
        own = _within(2 * points @ centres.T - (centres**2).sum(axis=1)[None], limit)
        centres = np.stack([points[own == p].mean(axis=0) if (own == p).any() else centres[p] for p in range(parts)])
    source, target = np.repeat(np.arange(len(points)), links.shape[1]), links.ravel()
    both = np.concatenate([source, target]), np.concatenate([target, source])
    load = np.bincount(own, minlength=parts)
    for _ in range(MOVES):
        held = np.bincount(both[0] * parts + own[both[1]], minlength=len(points) * parts).reshape(len(points), parts)
        wish = held.argmax(axis=1)
        gain = held[np.arange(len(points)), wish] - held[np.arange(len(points)), own]
        movers, moved = np.flatnonzero(gain > 0), 0
        for at in movers[np.argsort(-gain[movers], kind="stable")]:
            if load[wish[at]] < limit:
                load[own[at]] -= 1
                load[wish[at]] += 1
                own[at], moved = wish[at], moved + 1
        if not moved:
            break
    return own


@dataclass
class Router:
    """A classifier of vectors and the probability that the searched parts add up to."""

    mean: np.ndarray
    scale: float
    layers: tuple[np.ndarray, ...]
    mass: float

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors - self.mean) / self.scale
        w1, b1, w2, b2 = self.layers
        scores = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def searched(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and part, whether the part is searched: the most probable ones until their sum reaches ``mass``."""
        probable = self.probabilities(vectors)
        order = np.argsort(-probable, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(probable, order, axis=1), axis=1)
        ahead = np.hstack([np.zeros((len(sums), 1)), sums[:, :-1]])
        out = np.zeros(probable.shape, bool)
        np.put_along_axis(out, order, ahead < self.mass, axis=1)
        return out


def _trained(x: np.ndarray, goals: np.ndarray) -> tuple[np.ndarray, ...]:
    """One hidden layer, fitted to the shares ``goals`` by Adam."""
    rng = np.random.default_rng(11)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, goals.shape[1])), np.zeros(goals.shape[1])]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            hidden = np.maximum(x[rows] @ layers[0] + layers[1], 0)
            scores = hidden @ layers[2] + layers[3]
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = (scores / scores.sum(axis=1, keepdims=True) - goals[rows]) / len(rows)
            back = (error @ layers[2].T) * (hidden > 0)
            step += 1
            for i, slope in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def fit(sample: np.ndarray, k: int) -> Router:
    """The router from sampled vectors (a row each)."""
    mean = sample.mean(axis=0)
    with np.errstate(over="ignore"):
        scale = float(np.sqrt(((sample - mean) ** 2).mean())) or 1.0
    points = (sample - mean) / scale
    parts = max(1, min(PARTS, len(points) // PART_SAMPLE))
    if parts == 1 or not np.isfinite(points).all():
        return Router(np.zeros(sample.shape[1]), 1.0, (np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 2.0)
    links = neighbours(points, points, min(LINKS, len(points) - 1), True)
    own = partition(points, links, parts)
    goals = np.zeros((len(points), parts))
    np.add.at(goals, (np.repeat(np.arange(len(points)), links.shape[1] + 1), np.hstack([own[:, None], own[links]]).ravel()), 1)
    goals /= goals.sum(axis=1, keepdims=True)
    told = np.random.default_rng(13).permutation(len(points))
    held, learned = told[: len(told) // 4], told[len(told) // 4 :]
    router = Router(mean, scale, _trained(points[learned], goals[learned]), 2.0)
    probable = router.probabilities(sample)
    place = probable.argmax(axis=1)
    true = neighbours(points, points, min(k, len(points) - 1), True)[held]
    order = np.argsort(-probable[held], axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(probable[held], order, axis=1), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None].repeat(len(held), axis=0), axis=1)
    at = np.take_along_axis(rank, place[true], axis=1)
    before = np.where(at > 0, np.take_along_axis(sums, np.maximum(at - 1, 0), axis=1), 0.0)  # found once the mass exceeds what stands ahead
    needed = np.sort(before.ravel())
    router.mass = float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))], 2))
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and distance of the k nearest vectors for each query, ties to the smaller id; a query's own id is left out."""
    norms, out = (vectors**2).sum(axis=1), ([], [], [])
    with np.errstate(over="ignore", invalid="ignore"):
        rough = norms[None] - 2 * queries @ vectors.T
        slack = _SLACK * (norms.max(initial=0) + (queries**2).sum(axis=1))
        for q in range(len(queries)):
            others = np.flatnonzero(ids != query_ids[q])
            if not len(others):
                continue
            row = rough[q, others]
            if len(others) > k and np.isfinite(row).all() and np.isfinite(slack[q]):
                others = others[row <= np.partition(row, k - 1)[k - 1] + 2 * slack[q]]
            away = np.sqrt(((vectors[others] - queries[q]) ** 2).sum(axis=1))
            order = np.lexsort((ids[others], away))[:k]
            out[0].append(np.full(len(order), query_ids[q]))
            out[1].append(ids[others[order]])
            out[2].append(away[order])
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, float), strict=True))


def index(candidates: DataFrame, router: Router) -> DataFrame:
    """Every vector in its most probable part: a row for each shard of a part, its vectors and their ids."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.probabilities(_matrix(batch.column("v"))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(part.astype(np.int32))], ["id", "v", "part"])

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        made = pickle.dumps((pdf["id"].to_numpy(np.int64), np.array(pdf["v"].tolist(), dtype=np.float64)))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "shard": [made]})

    placed = materialize(candidates.mapInArrow(place, "id long, v array<double>, part int"), "routing-placed")
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # PARTS rows at most
    split = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, -(-n // SHARD_ROWS))])[F.col("part")] if sizes else F.lit(1)
    return placed.groupBy("part", F.pmod(F.xxhash64("id"), split).alias("nth")).applyInPandas(lambda pdf: shard(pdf), "part int, shard binary")


def _routed(router: Router) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of queries for each part that they are routed to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                some = batch.slice(low, BLOCK)
                ids, vectors = np.asarray(some.column("id")), _matrix(some.column("v"))
                wanted = router.searched(vectors)
                for part in np.flatnonzero(wanted.any(axis=0)).tolist():
                    block = pickle.dumps((ids[wanted[:, part]], vectors[wanted[:, part]]))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.binary())], ["part", "block"])

    return work


@scratch("routing-found")
def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """For each query row the k nearest rows found: query_id, rank, vec_id, score (the Euclidean distance)."""
    bounded_batches(df.sparkSession)
    not_zero = F.exists(vector, lambda x: x != 0)
    good = df.where(F.col(key).isNotNull() & usable(vector)).where(not_zero).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = materialize(good.where(F.size("v") == (sizes.d if sizes else 0)).distinct(), "routing-rows")
    equal = Window.partitionBy("v").orderBy("id")
    candidates = materialize(rows.select("id", "v").distinct().withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1).select("id", "v"), "routing-candidates")
    sample = thinned(candidates, ["id"], SAMPLE, seed=23).orderBy("id", "v").select("v").toPandas()
    router = fit(np.array(sample["v"].tolist(), dtype=np.float64).reshape(len(sample), sizes.d if sizes else 1), k) if len(sample) else fit(np.zeros((1, 1)), k)
    shards = materialize(index(candidates, router), "routing-shards")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, block in zip(batch.column("shard"), batch.column("block"), strict=True):
                (ids, vectors), (query_ids, queries) = pickle.loads(raw.as_py()), pickle.loads(block.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in nearest(queries, query_ids, vectors, ids, k)], ["query_id", "vec_id", "score"])

    asked = rows.where("q").select("id", "v").distinct().repartition("id").mapInArrow(_routed(router), "part int, block binary")
    found = asked.join(shards, "part").select("shard", "block").mapInArrow(find, "query_id long, vec_id long, score double")
    # an id with several vectors: its nearest
    least = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return least.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors for every vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)
