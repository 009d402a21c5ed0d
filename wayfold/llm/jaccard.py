"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, and sorted-array intersection.

A document's set is that of its distinct k-word shingles (hashes of 64 bits); two documents link when
``100 * intersection >= percent * union``. Result: for each document the size of its set and its component.

1. Documents with equal sets stand for one another; from here on each set counts once.
2. Sets are ordered by (commonness in a bounded sample, hash). Linked sets share one of the first
   ``n - ceil(percent * n / 100) + 1`` shingles of either, so a tile holds the sets with the same such shingle. The sample
   only shapes the order: any order loses no link.
3. ``ROUNDS`` times every tile names a representative, and every set is compared with the few representatives it shares
   most tiles with; verified links join components. Tiles whose sets are all in one component need no further look, so
   a large group of near copies does not come down to its pairs.
4. Tiles whose pairs of different components are more than ``CROWDED`` times their sets stand for common passages. Their shingles move to the
   end of the order, for all documents alike, and what comes after them in the order takes their places in the heads
   (``_thinned_tiles``), so that no tile is left whose pairs grow with the square of a passage's documents. Tiles with the very same
   sets are alike in this: one of them is looked at for all.
5. Of tiles with the very same sets one is kept. In what tiles are left, all pairs from different components in the same size
   band are compared.

To compare is to bound the overlap from the bit counts of two bitmaps first, and then to intersect the sorted arrays (48 bits of
each hash). One bitmap has a bit for every shingle, in a size that suits the set: a bit that only one set has stands for a
shingle that the other lacks. The other has 512 bits of parities: where two differ, an odd number of shingles, so at least one,
is in one set only. That one is compared inside the join that makes the pairs of step 5, so that no other pair leaves it.

Cases: null and empty texts (or without words) have an empty set and link with nothing; repeated rows and copies are in one
component; rows that repeat a key with another text count as one document with all its sets; a null key has a null component;
ties cannot arise; an empty table gives an empty result; only the key and the text are read, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import SPACES, bounded_batches, materialize, mix, pieces, scratch, shingle_sets, text_bytes, thinned

ROUNDS, NEAREST = 3, 3
#: A tile with so many pairs of different components for each of its sets is a common passage. Heads are longer than they must by one in
#: ``SPARE``, so that a few shingles of passages can be left out of them.
CROWDED, SPARE = 4, 4
#: The order of shingles is learned from about so many documents, and knows so many common shingles at most.
SAMPLE, COMMON, OFTEN = 4096, 1 << 18, 3
#: A list of keys is broadcast up to so many rows (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Tiles are named by 48 bits of a shingle's hash, which shuffle in fewer bytes: tiles that fall together only add pairs to verify.
_TILE_BITS = np.uint64(0xFFFFFFFFFFFF0000)


def _sets(part: pa.RecordBatch, text: str, k: int) -> list[np.ndarray]:
    return shingle_sets(*text_bytes(part.column(text)), SPACES, k)


@dataclass
class Common:
    """The common shingles by value, and the rank of each (from 1, the rarest first)."""

    values: np.ndarray
    ranks: np.ndarray


def head_size(n: int, percent: int) -> int:
    """So many first shingles of a set, in any order, hold one that a linked set holds too."""
    return n - -(-percent * n // 100) + 1 if n else 0


def with_spare(size: int) -> int:
    return size + size // SPARE + 2 if size else 0


def ordered_tiles(values: np.ndarray, common: Common) -> np.ndarray:
    """The tile names of a sorted set in the order of (commonness, hash)."""
    rank = np.zeros(len(values), dtype=np.int64)
    if len(common.values):
        at = np.minimum(np.searchsorted(common.values, values), len(common.values) - 1)
        rank = np.where(common.values[at] == values, common.ranks[at], 0)
    return (values[np.argsort(rank, kind="stable")] & _TILE_BITS).view(np.int64)


def common_shingles(df: DataFrame, key: str, text: str, k: int) -> Common:
    """Shingles that several sampled documents hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *_sets(part, text, k)]).view(np.int64))], ["x"])

    counts = thinned(df.select(key, text), [key], SAMPLE).select(text).mapInArrow(work, "x long").groupBy("x").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "x").limit(COMMON).toPandas()
    rarest_first = found["x"].to_numpy(dtype=np.int64)[::-1].view(np.uint64)
    by_value = np.argsort(rarest_first)
    return Common(rarest_first[by_value], by_value + 1)


def bitmap(values: np.ndarray) -> bytes:
    """A bit for each value, in a power of two of bits that is at least the number of values."""
    bits = np.zeros(max(64, 1 << (len(values) - 1).bit_length()), dtype=np.uint8)
    bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def parities(values: np.ndarray) -> list[int]:
    """512 bits in eight numbers: whether an odd number of values falls on each."""
    odd = np.bincount((values >> np.uint64(40) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def differ_little(percent: int) -> Column:
    """No more parities differ than shingles may, for pairs with sizes na, nb and parities pa, pb."""
    differing = sum((F.bit_count(F.col(f"pa{i}").bitwiseXOR(F.col(f"pb{i}"))) for i in range(1, 8)), F.bit_count(F.col("pa0").bitwiseXOR(F.col("pb0"))))
    return differing * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def overlap_bound(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """No intersection is larger: a bit of one set only stands for at least one shingle that the other lacks."""
    a, b = np.unpackbits(np.frombuffer(bits_a, np.uint8)), np.unpackbits(np.frombuffer(bits_b, np.uint8))
    width = min(len(a), len(b))
    a, b = a.reshape(-1, width).any(axis=0), b.reshape(-1, width).any(axis=0)
    return min(n_a - int(np.count_nonzero(a & ~b)), n_b - int(np.count_nonzero(b & ~a)))


def signatures(df: DataFrame, key: str, text: str, k: int, percent: int, common: Common) -> DataFrame:
    """For each row: doc, n, a 128-bit hash of the set, its tiles' shingles, its bitmap and its parities."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            sets = _sets(part, text, k)
            n = np.array([len(s) for s in sets])
            h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            h2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            heads, bits = [], []
            for s in sets:
                heads.append(ordered_tiles(s, common)[: with_spare(head_size(len(s), percent))])
                bits.append(bitmap(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))], ["doc", "n", "h1", "h2", "head", "bits", "odd"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(work, "doc long, n long, h1 long, h2 long, head array<long>, bits binary, odd array<long>")


def listed(keys: DataFrame) -> DataFrame:
    """For the narrow side of a join: a short list is broadcast, a long one shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``keys.doc``."""
    return df.join(listed(keys.select(F.col("doc").alias(column))), column, "left_semi")


def firsts_of(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row for each set: those in ``firsts``. A short list of the others is broadcast, so that the wide rows stay where they are."""
    key = ["doc", "n", "h1", "h2"]
    full = rows.where("n > 0 AND doc IS NOT NULL")
    copies = materialize(full.select(key).join(firsts, key, "left_anti").distinct(), "jaccard-copies")
    if copies.count() <= BROADCAST_ROWS:
        return full.join(F.broadcast(copies), key, "left_anti")
    return full.join(firsts, key, "left_semi")


def alike(a: str, b: str, percent: int) -> Column:
    """Sizes that allow a link."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


@scratch("jaccard-links")
def verified(pairs: DataFrame, sets: DataFrame, df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. ``sets`` has doc, n and bits; ``df`` the texts."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield from (part.slice(low, 256) for low in range(0, part.num_rows, 256))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            columns = [part.column(c).to_pylist() for c in ("na", "bits_a", "nb", "bits_b")]
            most = np.array([overlap_bound(*x) for x in zip(*columns, strict=True)], dtype=np.int64)
            sizes = np.array(columns[0], dtype=np.int64) + np.array(columns[2], dtype=np.int64)
            keep = pa.array(100 * most >= percent * (sizes - most))
            yield part.select(["a", "b"]).filter(keep)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            keep = []
            for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
                u, v = _unpack(x), _unpack(y)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array([_pack(s) for s in _sets(part, text, k)], pa.binary())], ["doc", "packed"])

    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "jaccard-ends")
    sets = among(sets.select("doc", "n", "bits"), "doc", ends)
    one = pairs.join(sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
    two = one.join(sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
    likely = materialize(two.where(alike("na", "nb", percent)).select("a", "b", "na", "bits_a", "nb", "bits_b").mapInArrow(bound, "a long, b long"), "jaccard-likely")
    wanted = materialize(likely.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "jaccard-wanted")
    packed = among(df.select(F.col(key).cast("long").alias(key), text), key, wanted).mapInArrow(pack, "doc long, packed binary")
    packed = materialize(packed, "jaccard-sets")
    held = likely.join(packed.select(F.col("doc").alias("a"), F.col("packed").alias("set_a")), "a").join(packed.select(F.col("doc").alias("b"), F.col("packed").alias("set_b")), "b")
    return held.select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long").distinct()


def _pack(values: np.ndarray) -> bytes:
    """The high 48 bits of each value: enough to tell the shingles of two documents apart."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    wide[:, 2:] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return np.unique(wide.reshape(-1).view(">u8").astype(np.uint64))


@scratch("graph-components")
def components(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph given as edges (a, b): the least node of its component, by minima of neighbours and jumps."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
    labels = materialize(labels, "graph-labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        near = labels.join(told, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("via"))
        jump = near.join(labels.select(F.col("node").alias("via"), F.col("root").alias("far")), "via", "left")
        new = materialize(jump.select("node", F.least("via", F.coalesce("far", "via")).alias("root"), (F.least("via", F.coalesce("far", "via")) != F.col("old")).alias("moved")), "graph-labels")
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (doc, comp) with the components that the links (a, b) join made one, under its least name."""
    named = links.join(members.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), "a").join(members.select(F.col("doc").alias("b"), F.col("comp").alias("cb")), "b")
    edges = materialize(named.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "jaccard-edges")
    if edges.isEmpty():
        return members
    roots = components(edges).withColumnRenamed("node", "comp")
    return materialize(members.join(roots, "comp", "left").select("doc", F.coalesce("root", "comp").alias("comp")), "jaccard-members")


def _orders(df: DataFrame, key: str, text: str, k: int, docs: DataFrame, common: Common) -> DataFrame:
    """All tile names of the documents in ``docs`` in their order: doc, tiles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            tiles = [ordered_tiles(s, common) for s in _sets(part, text, k)]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(tiles, pa.list_(pa.int64()))], ["doc", "tiles"])

    return among(df.select(F.col(key).cast("long").alias(key), text), key, docs).mapInArrow(work, "doc long, tiles array<long>")


def _crowding(tiles: DataFrame) -> DataFrame:
    """The tiles (a row with x and comp for each set) of several components, and whether their pairs of different components are more than ``CROWDED`` times their sets."""
    of_one = tiles.groupBy("x", "comp").agg(F.count("*").alias("c"))
    whole = of_one.groupBy("x").agg(F.sum("c").alias("docs"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count("*").alias("comps"))
    return whole.where("comps > 1").select("x", (F.col("docs") * F.col("docs") - F.col("within") > 2 * CROWDED * F.col("docs")).alias("crowded"))


@scratch("jaccard-thinned")
def _thinned_tiles(tiles: DataFrame, kinds: DataFrame, sets: DataFrame, members: DataFrame, order: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(x, doc, comp) of the tiles that are still of several components, without crowded ones.

    ``tiles`` (x, doc, comp) has one tile of each kind, ``kinds`` all tiles of each: where one is crowded, all of them are. The order of
    shingles becomes (crowded, order before). Heads with enough other shingles just lose the crowded ones. Of a document with fewer all
    shingles are looked at (``order``), and those that crowd among such documents are crowded too, until that moves no more heads. Only
    documents that consist of crowded shingles for the most part keep some.
    """
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    lasting = materialize(_crowding(tiles), "jaccard-lasting")
    light = lasting.where("NOT crowded").select("x")
    crowded = lasting.where("crowded").select("x")
    if crowded.isEmpty():
        return tiles.join(light, "x", "left_semi")
    kind = ["s1", "s2", "docs"]
    named = materialize(kinds.join(listed(crowded), "x", "left_semi").select(kind), "jaccard-named")
    of_kind = materialize(kinds.join(listed(named), kind, "left_semi"), "jaccard-crowded")
    times = materialize(of_kind.groupBy(kind).agg(F.min("x").alias("x"), F.count("*").alias("lost")).select("x", "lost"), "jaccard-times")
    lost = materialize(tiles.join(listed(times), "x").groupBy("doc").agg(F.sum("lost").alias("lost")), "jaccard-lost")
    crowded = of_kind.select("x")
    heads = sets.select("doc", F.explode(F.array_distinct("head")).alias("x"))
    deep = None
    while True:
        told = sets.select("doc", "n", F.size(F.array_distinct("head")).alias("held")).join(lost, "doc").where(F.col("held") - F.col("lost") < size).select("doc").distinct()
        short = materialize(told if deep is None else told.join(deep, "doc", "left_anti"), "jaccard-short")
        if short.isEmpty():
            break
        seen = materialize(order(short).join(listed(among(members, "doc", short)), "doc"), "jaccard-orders")
        deep = seen if deep is None else deep.unionByName(seen)
        more = _crowding(deep.select("comp", F.explode("tiles").alias("x"))).where("crowded").select("x").join(crowded, "x", "left_anti")
        more = materialize(more, "jaccard-crowded")
        if more.isEmpty():
            break
        crowded = materialize(crowded.unionByName(more), "jaccard-crowded")
        # also the heads in which such a shingle stands alone: it may crowd among deep documents only
        touched = among(heads, "x", more.select(F.col("x").alias("doc"))).groupBy("doc").agg(F.count("*").alias("lost"))
        lost = materialize(lost.unionByName(touched).groupBy("doc").agg(F.sum("lost").alias("lost")), "jaccard-lost")
    if deep is None:
        return tiles.join(light, "x", "left_semi")
    names = deep.select("doc", F.explode("tiles").alias("x"))
    out = among(names, "x", crowded.select(F.col("x").alias("doc"))).groupBy("doc").agg(F.collect_set("x").alias("out"))
    last = F.coalesce("out", F.array().cast("array<long>"))
    firsts = deep.join(out, "doc", "left").withColumn("n", F.size("tiles")).select("doc", F.explode(F.slice(F.concat(F.array_except("tiles", last), F.array_intersect("tiles", last)), F.lit(1), size.cast("int"))).alias("x"))
    firsts = materialize(firsts.select("x", "doc"), "jaccard-heads")
    # whatever else has a shingle of those heads: also sets that were alone in their tiles
    met = materialize(firsts.select("x").distinct().join(crowded, "x", "left_anti"), "jaccard-met")
    wide = among(heads, "x", met.select(F.col("x").alias("doc"))).select("x", "doc").join(deep.select("doc"), "doc", "left_anti")
    rest = tiles.join(light.join(met, "x", "left_anti"), "x", "left_semi").join(deep.select("doc"), "doc", "left_anti")
    moved = wide.select("x", "doc").unionByName(firsts).join(members, "doc")
    return rest.select("x", "doc", "comp").unionByName(moved.select("x", "doc", "comp"))


def _kinds(tiles: DataFrame, *more: Column) -> DataFrame:
    """For each x what tells its set of documents from others: s1, s2, docs (and ``more``)."""
    sums = [F.sum(F.xxhash64("doc").bitwiseAND(F.lit((1 << 32) - 1))).alias("s1"), F.sum(F.shiftrightunsigned(F.xxhash64("doc"), 32)).alias("s2"), F.count("*").alias("docs")]
    return tiles.groupBy("x").agg(*sums, *more)


def _unlike(kinds: DataFrame) -> DataFrame:
    """One x for each different set of documents."""
    return materialize(kinds.groupBy("s1", "s2", "docs").agg(F.min("x").alias("x")).select("x"), "jaccard-unlike")


@scratch("jaccard-links")
def _left_over(tiles: DataFrame, kinds: DataFrame, sets: DataFrame, members: DataFrame, df: DataFrame, key: str, text: str, k: int, percent: int, common: Common) -> DataFrame:
    """The links between components that tiles still have after the rounds."""
    tiles = materialize(tiles.select("x", "doc").join(members, "doc").select("x", "doc", "comp"), "jaccard-rest")
    rest = _thinned_tiles(tiles, kinds, sets, members, lambda docs: _orders(df, key, text, k, docs, common), percent)
    unlike = _unlike(_kinds(rest, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi"))
    rest = rest.join(unlike, "x", "left_semi")
    rest = materialize(rest.join(sets.select("doc", "n", *[F.col("odd")[i].alias(f"p{i}") for i in range(8)]), "doc"), "jaccard-tiles")
    # bands four times as wide as their least size: few sets can pair with larger ones of the next band
    band = lambda n: F.floor(F.log(n) / math.log(4)).cast("int")
    bands = F.sequence(band(F.col("n")), band(F.col("n") * 100 / percent + 0.001))
    large = rest.select("x", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), band(F.col("n")).alias("band"), *[F.col(f"p{i}").alias(f"pa{i}") for i in range(8)])
    small = rest.select("x", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.explode(bands).alias("band"), *[F.col(f"p{i}").alias(f"pb{i}") for i in range(8)])
    in_order = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    across = large.join(small, ["x", "band"]).where((F.col("ca") != F.col("cb")) & in_order & alike("na", "nb", percent) & differ_little(percent))
    pairs = materialize(across.select("a", "b").distinct(), "jaccard-pairs")
    return verified(pairs, sets, df, key, text, k, percent)


def _sets_of_one_key(owned: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of rows that have one key."""
    firsts = owned.where("doc IS NOT NULL AND first IS NOT NULL").select("doc", "first")
    several = materialize(firsts.groupBy("doc").agg(F.min("first").alias("a"), F.max("first").alias("hi")).where("a < hi").select("doc", "a"), "jaccard-several")
    return materialize(firsts.join(several, "doc").where("a < first").select("a", F.col("first").alias("b")).distinct(), "jaccard-links")


@scratch("jaccard-result")
def link(df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """For each row of ``df``: the key as ``doc``, ``n_shingles`` and ``component``."""
    if not 0 < percent <= 100:
        raise ValueError(f"a percentage from 1 to 100: {percent}")
    bounded_batches(df.sparkSession)
    common = common_shingles(df, key, text, k)
    rows = materialize(signatures(df, key, text, k, percent, common), "jaccard-signatures")
    same = materialize(rows.where("n > 0 AND doc IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc").alias("first")), "jaccard-same")
    firsts = same.select(F.col("first").alias("doc"), "n", "h1", "h2")
    sets = firsts_of(rows, firsts)
    tiles = sets.select("doc", "n", F.explode("head").alias("x"))
    # the first round sees every tile: its rows are kept as narrow as they get, and the least document stands for a tile
    mixed = materialize(tiles.groupBy("x").agg(F.min("doc").alias("rep"), F.max("doc").alias("hi")).where("rep < hi").select("x", "rep"), "jaccard-mixed")
    tiles = materialize(tiles.withColumn("n", F.col("n").cast("int")).join(mixed, "x"), "jaccard-tiles")
    members = materialize(firsts.select("doc").distinct().withColumn("comp", F.col("doc")), "jaccard-members")
    members = merged(members, verified(_closest(tiles.where("doc <> rep")), sets, df, key, text, k, percent))
    # tiles of the same sets make the same pairs: one of them is enough
    kinds = materialize(_kinds(tiles), "jaccard-kinds")
    tiles = materialize(tiles.select("x", "doc", "n").join(_unlike(kinds), "x", "left_semi"), "jaccard-tiles")
    for nth in range(1, ROUNDS):
        tiles = materialize(tiles.select("x", "doc", "n").join(members, "doc"), "jaccard-tiles")
        # representatives are drawn by a hash: another one each time
        picked = F.min(F.struct(F.xxhash64(F.lit(nth), "doc").alias("h"), F.col("doc").alias("rep"), F.col("comp").alias("rep_comp"), F.col("n").alias("rep_n")))
        mixed = tiles.groupBy("x").agg(picked.alias("r"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("x", "r.rep", "r.rep_comp", "r.rep_n")
        tiles = materialize(tiles.join(materialize(mixed, "jaccard-mixed"), "x"), "jaccard-tiles")
        pairs = _closest(tiles.where((F.col("comp") != F.col("rep_comp")) & alike("n", "rep_n", percent)))
        members = merged(members, verified(pairs, sets, df, key, text, k, percent))
    members = merged(members, _left_over(tiles, kinds, sets, members, df, key, text, k, percent, common))
    owned = rows.select("doc", "n", "h1", "h2").join(same, ["n", "h1", "h2"], "left").select("doc", "n", "first")
    members = merged(members, _sets_of_one_key(owned))
    named = owned.join(members.withColumnRenamed("doc", "first"), "first", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("comp", "first", "doc"))
    return named.select("doc", F.col("n").alias("n_shingles"), component.alias("component"))


def _closest(tiles: DataFrame) -> DataFrame:
    """The pairs (a, b) of each set with the few representatives that it shares most tiles with."""
    shared = tiles.groupBy("doc", "rep").agg(F.count("*").alias("times"))
    best = Window.partitionBy("doc").orderBy(F.desc("times"), "rep")
    near = shared.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= NEAREST)
    return materialize(near.select(F.col("doc").alias("a"), F.col("rep").alias("b")), "jaccard-pairs")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents by 4-word shingles at a Jaccard similarity of 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = link(docs, "doc_id", "text", 4, 85)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
