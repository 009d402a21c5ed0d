"""Sharding, archives, vectors and sound: brute force, round trips, odd rows."""

import base64
import fractions
import hashlib
import io
import math
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import mtree, sharding, telephony, warc

RNG = np.random.default_rng(9)


# ---- sharding


def test_shards_differ_by_one_row_and_slots_have_no_gaps(spark):
    docs = spark.range(1003).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("doc_id"), F.lit("x").alias("slot"))
    docs = docs.unionByName(spark.range(400).select(F.lit(5).cast("long").alias("doc_id"), F.lit("y").alias("slot")))  # a key with many rows
    out = sharding.assign(docs, ["doc_id"], 24).collect()
    by = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(24)}
    assert len(out) == 1403 and {len(x) for x in by.values()} == {58, 59}
    assert all(x == list(range(len(x))) for x in by.values())
    assert sharding.assign(docs.where("false"), ["doc_id"], 24).collect() == []


def test_rows_follow_the_ring_until_shards_are_full():
    points = sorted((int(RNG.integers(64)), s % 5) for s in range(40))
    counts = {c: int(RNG.integers(0, 30)) for c in range(64)}
    for slack in (0.0, 0.25):
        pieces = sharding.plan(counts, points, 5, slack)
        load = [0] * 5
        bound = -int(-sum(counts.values()) * (1 + slack) // 5) if slack else None
        for cell in sorted(counts):  # one row after the other, by the rule itself
            expected = []
            for _ in range(counts[cell]):
                order = [s for c, s in points if c >= cell] + [s for c, s in points if c < cell]
                total = sum(counts.values())
                limit = lambda s, t=total: bound if slack else t // 5 + (s < t % 5)
                shard = next(s for s in order if load[s] < limit(s))
                load[shard] += 1
                expected.append(shard)
            got = [p["shard"] for p in pieces if p["cell"] == cell for _ in range(p["high"] - p["low"])]
            assert got == expected


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"))
    old = sharding.assign(docs, ["doc_id"], 8, slack=0.25).select("doc_id", F.col("shard").alias("a"))
    new = sharding.assign(docs, ["doc_id"], 9, slack=0.25).select("doc_id", F.col("shard").alias("b"))
    moved = old.join(new, "doc_id").where("a <> b").count()
    assert moved < 0.4 * 6000  # 8 of 9 would move by a plain remainder


# ---- archives


def test_archives_read_back(spark):
    rows = [(1, "http://www.Example.org/a?b=1", "<p>é</p>"), (2, "https://example.org/x", None), (3, None, ""), (4, "http://b.example.org", "<p>é</p>"), (9, "http://www.Example.org/a?b=1", "other"), (5, "http://a.org/\nx", "other")]
    rows += [(100 + i, "http://hot.example/page", f"body {i % 50}") for i in range(700)] + [(None, "http://null.example/", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive(pages, "page_id", "url", "html")
    got = {r.page_id: r for r in warc.lookup(pages.select(warc.url_key("url").alias("surt"), "page_id"), index).collect()}
    assert len(got) == len(rows)
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    for i, _, html in rows:
        raw, r = (html or "").encode(), got[i]
        first = best[html or ""] == i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", best[html or ""]))
        assert r.payload == (raw if first else None)
    same = warc.lookup(spark.createDataFrame([("example,hot)/page",), ("org,example)/x",), ("no,such)",)], "surt string"), index, any_id=True)
    assert same.groupBy("surt").count().orderBy("surt").collect() == [("example,hot)/page", 700), ("org,example)/x", 1)]


def test_repeated_rows_and_ids_under_any_names(spark):
    long = "é" * 3_000_000
    rows = [(1, "http://a.org/", "x"), (1, "http://a.org/", "x"), (9, "http://b.org/", "x"), (9, "http://c.org/", "x"), (4, None, long), (5, "http://d.org/", long), (6, "", None), (7, "", "")]
    pages = spark.createDataFrame(rows, "winner long, raw string, sha string").withColumn("surt", F.lit("z")).withColumn("refers_to", F.lit(3))
    index = warc.archive(pages, "winner", "raw", "sha")
    asked = pages.select(warc.url_key("raw").alias("surt"), F.col("winner").alias("page_id"))
    got = sorted((r.page_id, r.surt, r.record_type, r.refers_to, r.payload_bytes, len(r.payload or b"")) for r in warc.lookup(asked, index).collect())
    size = len(long.encode())
    a, b, c, d = "org,a)/", "org,b)/", "org,c)/", "org,d)/"
    assert got == sorted([(1, a, "revisit", 9, 1, 0), (1, a, "revisit", 9, 1, 0), (9, b, "response", None, 1, 1), (9, c, "response", None, 1, 1), (4, "", "revisit", 5, size, 0), (5, d, "response", None, size, size), (6, "", "revisit", 7, 0, 0), (7, "", "response", None, 0, 0)], key=lambda r: r[:2])


def test_the_sharding_query_equals_plain_python(spark, tmp_path):
    texts = ["", None, "é" * 10, "x" * 70_000, "a", "a"] * 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op7_sharding(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in out} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(24)}
    assert all(x == list(range(5)) for x in slots.values()) and {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def test_no_pages_no_records(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.archive(pages, "page_id", "url", "html")
    assert warc.lookup(pages.select(warc.url_key("url").alias("surt"), "page_id"), index).collect() == []


# ---- vectors


@pytest.mark.parametrize("n", [3, 40, 1500])
def test_top_k_equals_brute_force(spark, n):
    vectors = RNG.normal(size=(n, 8))
    vectors[n // 3 : n // 2] = vectors[0]  # a group of copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    odd = [(n, None, "x"), (n + 1, [1.0, None] + [0.0] * 6, "x"), (n + 2, [float("nan")] * 8, "x"), (n + 3, [float("inf")] * 8, "x"), (n + 4, [1.0], "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows + odd, "id long, v array<float>, rank string")
    got = sorted(tuple(r) for r in mtree.top_k(df, "id", "v", F.col("id") % 5 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    whole = np.floor(256 * vectors.astype(np.float32).astype(float)).astype(np.int64)
    expected = []
    for q in range(0, n, 5):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(n), -scores)).tolist() if i != q][:5]
        expected += [(q, rank, i, int(scores[i])) for rank, i in enumerate(order, 1)]
    assert got == sorted(expected)


def test_long_vectors_take_part_exactly(spark):
    vectors = {0: [1.0, 2.0], 1: [9000.0, -3.0], 2: [1e30, 1.0], 3: [-1e30, 5.5], 5: [3e38, 3e38], 10: [0.5, 0.25], 11: [1e30, 1.0], 15: [-2e5, 7.0]}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<float>")
    got = sorted(tuple(r) for r in mtree.top_k(df, "id", "v", F.col("id") % 5 == 0, 3).select("query_id", "rank", "vec_id", "score").collect())
    whole = {i: [math.floor(fractions.Fraction(float(np.float32(x))) * 256) for x in v] for i, v in vectors.items()}
    expected = []
    for q in (0, 5, 10, 15):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        expected += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores[:3], 1)]
    assert got == sorted(expected)


def test_repeated_ids_and_ties_between_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0]), (2, [0.0, 9.0]), (3, [2.0, 1.0]), (4, [1.0, 1.0, 1.0]), (6, [7.0] * 3), (7, [7.0] * 3), (8, [7.0] * 3), (9, [7.0] * 3), (10, [7.0] * 3)]
    df = spark.createDataFrame(rows[:9], "id long, v array<double>")  # five of two components, four of three
    got = [tuple(r) for r in mtree.top_k(df, "id", "v", F.col("id") == 2, 2).orderBy("rank").select("query_id", "rank", "vec_id", "score").collect()]
    unit = 256 * 256
    assert got == [(2, 1, 3, 10 * unit), (2, 2, 3, 9 * unit)]
    even = spark.createDataFrame([rows[0], rows[2], rows[5], rows[6]], "id long, v array<double>")
    assert {r.vec_id for r in mtree.top_k(even, "id", "v", F.lit(True), 5).collect()} == {1, 2}


def test_clustered_vectors_skip_most_pivots(spark, monkeypatch):
    """Many small shards; far groups are left out before their trees are read, and the results stay those of brute force."""
    monkeypatch.setattr(mtree, "SHARD_ROWS", 64)
    monkeypatch.setattr(mtree, "BLOCK", 16)
    vectors = np.concatenate([RNG.normal(0, 0.3, size=(150, 6)) + c for c in RNG.normal(0, 6, size=(8, 6))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<float>")
    got = sorted(tuple(r) for r in mtree.top_k(df, "id", "v", F.col("id") % 10 == 0, 4).select("query_id", "rank", "vec_id", "score").collect())
    whole = np.floor(256 * vectors.astype(float)).astype(np.int64)
    expected = []
    for q in range(0, len(whole), 10):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(whole)), -scores)).tolist() if i != q][:4]
        expected += [(q, n, i, int(scores[i])) for n, i in enumerate(order, 1)]
    assert got == sorted(expected)


def test_blocks_of_queries_are_never_broadcast(spark, monkeypatch):
    """The driver sees neither blocks nor trees, however small the planner takes them to be; lanes and parts change no result."""
    monkeypatch.setattr(mtree, "SHARD_ROWS", 16)
    monkeypatch.setattr(mtree, "BLOCK", 8)
    monkeypatch.setattr(mtree, "PART_BLOCKS", 2, raising=False)
    monkeypatch.setattr(mtree, "LEAST_LANES", 4, raising=False)
    plans, real = [], mtree.materialize

    def seen(df, name, *more):
        if name == "mtree-near":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *more)

    monkeypatch.setattr(mtree, "materialize", seen)
    vectors = RNG.normal(size=(400, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<float>")
    got = sorted(tuple(r) for r in mtree.top_k(df, "id", "v", F.col("id") % 4 == 0, 3).select("query_id", "rank", "vec_id", "score").collect())
    whole = np.floor(256 * vectors.astype(float)).astype(np.int64)
    expected = []
    for q in range(0, len(whole), 4):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(whole)), -scores)).tolist() if i != q][:3]
        expected += [(q, n, i, int(scores[i])) for n, i in enumerate(order, 1)]
    assert got == expected
    assert plans and not any("Broadcast" in plan for plan in plans)


def test_bounds_leave_out_pages():
    points = np.concatenate([RNG.normal(c, 0.5, size=(300, 6)) for c in (-40, 0, 40)]).round().astype(np.int64)
    most = int((points**2).sum(axis=1).max())
    high = mtree.lifted(points, most)
    tree = {"root": mtree.grow(high, np.arange(len(points)), high[0]), "centre": high[0], "ids": np.arange(len(points)), "vectors": points, "most": most}
    calls, real = [], mtree._distances
    mtree._distances = lambda p, t: calls.append(len(p)) or real(p, t)
    try:
        _, ids, found = mtree.search(tree, points[5:6], np.array([5]), 3, np.array([np.inf]))
    finally:
        mtree._distances = real
    scores = points @ points[5]
    assert sorted(found.tolist(), reverse=True) == sorted(np.delete(scores, 5).tolist(), reverse=True)[:3]
    assert scores[ids].tolist() == found.tolist()
    assert sum(calls) < 120


def test_no_vectors_no_results(spark):
    assert mtree.top_k(spark.createDataFrame([], "id long, v array<float>"), "id", "v", F.lit(True), 5).collect() == []


# ---- sound


def step_by_step(block):
    """ADPCM by the book: one nibble after the other."""
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            move = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            sample = max(-32768, min(32767, sample - move if code & 8 else sample + move))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[code])))
            out.append(sample)
    return out


def test_adpcm_blocks_decode_together():
    blocks = RNG.integers(0, 256, (20, telephony.BLOCK)).astype(np.uint8)
    assert [x.tolist() for x in telephony.decode_adpcm(blocks)] == [step_by_step(b.tolist()) for b in blocks]


def test_tables_are_symmetric_and_reach_their_ends():
    assert sorted(telephony.MULAW.tolist()) == sorted((-telephony.MULAW.astype(int)).tolist()) and telephony.MULAW.max() == 32124
    assert sorted(telephony.ALAW.tolist()) == sorted((-telephony.ALAW.astype(int)).tolist()) and telephony.ALAW.max() == 32256
    assert telephony.MULAW[0xFF] == 0 and telephony.ALAW[0xD5] == 8


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_payloads_come_back(spark, codec):
    payloads = [b"", b"abc", RNG.integers(0, 256, 1000).astype(np.uint8).tobytes(), None, b"abc"]
    rows = spark.createDataFrame(list(enumerate(payloads)), "id long, raw binary")
    back = telephony.read_back(telephony.store(rows, "raw", ["id"], codec), ["id"]).orderBy("id").collect()
    assert [bytes(r.payload) for r in back] == [p or b"" for p in payloads]
    assert all(r.codec == codec for r in back) and back[1].feature == back[4].feature
    for r in back:
        pcm = telephony.expand(bytes(r.payload), codec)
        assert bytes(r.pcm16k) == telephony.resample_double(pcm).tobytes()
    assert telephony.read_back(telephony.store(rows.where("false"), "raw", ["id"], codec), ["id"]).collect() == []


def test_stored_pcm_gives_payloads_back(spark):
    payloads = [b"", bytes(range(256)), RNG.integers(0, 256, 300_000).astype(np.uint8).tobytes(), None]
    rows = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(payloads)], "id long, raw binary, media string, payload string")
    stored = telephony.store_pcm(telephony.store(rows, "raw", ["id", "payload", "media"], "alaw"), "media", ["id", "payload"])
    for r in stored.collect():
        with wave.open(io.BytesIO(bytes(r.media))) as file:
            assert (file.getframerate(), file.getnframes()) == (16000, 2 * len(payloads[r.id] or b""))
    back = telephony.read_back(stored, ["id", "payload"]).orderBy("id").collect()
    assert [bytes(r.payload) for r in back] == [p or b"" for p in payloads]
    for r in back:
        sound = telephony.resample_double(telephony.ALAW[np.frombuffer(bytes(r.payload), np.uint8)])
        assert bytes(r.pcm16k) == sound.tobytes() and r.feature.endswith(f"pcm16k={len(sound)}:{zlib.crc32(sound.tobytes()):08x}")


def test_the_query_equals_plain_python(spark, tmp_path):
    texts = ["", None, "a", "é" * 288, "x" * 576, "y" * 577, "z é" * 40_000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in telephony.op10_telephony(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        pcm = telephony.ALAW[np.frombuffer(payload, np.uint8)].astype(int)
        wide = np.empty(2 * len(pcm), dtype="<i2")
        wide[0::2], wide[1::2] = pcm, [(a + b) >> 1 for a, b in zip(pcm, [*pcm[1:], pcm[-1]], strict=True)]
        file = io.BytesIO()
        with wave.open(file, "wb") as told:
            told.setparams((1, 2, 16000, 0, "NONE", ""))
            told.writeframes(wide.tobytes())
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes == len(file.getvalue()) and r.media_sha256 == hashlib.sha256(file.getvalue()).hexdigest()
        loud = int(np.sqrt((pcm * pcm).sum() // len(pcm)))
        assert r.feature.startswith(f"alaw:rms={loud},peak={np.abs(pcm).max()},")
    assert out[2].feature == out[7].feature


def test_files_are_wav():
    media = telephony.wav(b"12345", "mulaw")
    assert telephony.unwav(media) == ("mulaw", b"12345")
    with pytest.raises(wave.Error, match="unknown format"):  # known to the standard library as WAV, only not as linear PCM
        wave.open(io.BytesIO(media))
