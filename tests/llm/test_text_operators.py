"""Language, toxicity, licences, near duplicates, packing, pieces: brute force, round trips, accuracy, odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wayfold.llm import common, jaccard, language, licenses, packing, pieces, toxicity

RNG = np.random.default_rng(5)
ODD = [(90001, None), (90002, ""), (90003, " \t\n"), (90004, "word"), (90005, "12 34 !!"), (90006, "x " * 30_000), (90007, "日本 text é"), (None, "a row without an id but with words"), (90001, "again")]


def sentence(words, n):
    return " ".join(RNG.choice(words, n))


@pytest.fixture(scope="module")
def words():
    return np.array(["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 8))) for _ in range(400)])


def frame(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "s", 0.5, "zz") for i, t in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string")


# ---- near duplicates


def shingles(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))) if found else frozenset()


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, k, percent):
    rows, passage = [], sentence(words, 60)
    for base in range(12):
        text = sentence(words, int(RNG.integers(4, 160))).split()
        for copy in range(12):
            new = list(text)
            for _ in range(copy % 5):
                new[RNG.integers(len(new))] = str(RNG.choice(words))
            rows.append((len(rows) * 7 % 1009, " ".join(new) if copy % 4 else passage + " " + " ".join(new)))
    rows += [(5000 + i, passage + " " + sentence(words, i)) for i in range(0, 40, 3)] + [(6000, "ONE two Three"), (6001, "one TWO three"), (6002, "one two")]
    rows += [x for x in ODD if x[0] != 90001]
    found = {r.doc: r for r in jaccard.link(frame(spark, rows), "doc_id", "text", k, percent).collect()}
    expected = brute_components(rows, k, percent)
    assert {i: found[i].component for i in expected} == expected
    assert all(found[i].n_shingles == len(shingles(t, k)) for i, t in rows if i is not None)
    assert found[None].component is None


@pytest.mark.parametrize(("k", "percent"), [(2, 60), (4, 85), (3, 20)])
def test_crowded_passages_lose_no_link(spark, words, monkeypatch, k, percent):
    """Documents that consist of common passages to different shares, among them pairs that link by these alone."""
    monkeypatch.setattr(jaccard, "CROWDED", 1)
    passages = [sentence(words, n) for n in (12, 20, 30, 45)]
    rows = []
    for i in range(90):
        own = sentence(words, int(RNG.integers(1, 60)))
        some = [str(p) for p in RNG.choice(passages, int(RNG.integers(1, 4)), replace=False)]
        rows.append((i, " ".join([own, *some] if i % 3 else some)))
        if i % 5 == 0:
            rows.append((1000 + i, rows[-1][1] + " " + sentence(words, int(RNG.integers(1, 12)))))
    found = jaccard.link(frame(spark, rows), "doc_id", "text", k, percent).collect()
    assert {r.doc: r.component for r in found} == brute_components(rows, k, percent)


def with_passage(words, docs, own, shared):
    passage = sentence(words, shared)
    return [(i, sentence(words, own) + " " + passage) for i in range(docs)]


def test_pairs_of_long_texts_with_a_passage_do_not_grow_with_its_square(spark, words, monkeypatch):
    """Texts so long that parities tell nothing of them, under 64 to a passage."""
    compared, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "OFTEN", 1000)  # the passage is too rare for the sample, as among many documents
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = jaccard.link(frame(spark, with_passage(words, 30, 900, 700)), "doc_id", "text", 4, 85).collect()
    assert {r.doc: r.component for r in found} == {i: i for i in range(30)}
    assert compared[-1] <= 120  # 435 pairs of them all


def test_one_tile_of_each_set_of_documents_is_weighed(spark, words, monkeypatch):
    weighed, crowding = [], jaccard._crowding
    monkeypatch.setattr(jaccard, "OFTEN", 1000)
    monkeypatch.setattr(jaccard, "_crowding", lambda tiles, *rest: weighed.append(tiles.count()) or crowding(tiles, *rest))
    rows = [(100 * n + i, t) for n in range(4) for i, t in with_passage(words, 5, 300, 200)]
    found = jaccard.link(frame(spark, rows), "doc_id", "text", 4, 85).collect()
    assert {r.doc: r.component for r in found} == {i: i for i, _ in rows}
    assert max(weighed) <= 100  # about 40 tiles of each passage, with five rows each


def test_rows_of_one_key_join_all_their_sets(spark, words):
    a, b, c, d = (sentence(words, 30) for _ in range(4))
    rows = [(5, a), (9, a), (9, b), (9, c), (12, c), (2, d), (None, a), (3, b)]
    found = jaccard.link(frame(spark, rows), "doc_id", "text", 4, 85).collect()
    assert {(r.doc, r.component) for r in found} == {(5, 3), (9, 3), (12, 3), (3, 3), (2, 2), (None, None)}


def test_chains_and_large_groups_join(spark, words):
    text = sentence(words, 300).split()
    rows = []
    for i in range(60):  # each differs little from the one before, but much from the first
        text = list(text)
        text[i * 4 % 300] = f"new{i}"
        rows.append((i, " ".join(text)))
    found = jaccard.link(frame(spark, rows), "doc_id", "text", 4, 85).collect()
    assert {r.doc: r.component for r in found} == brute_components(rows, 4, 85)


def test_bounds_never_fall_below_the_overlap():
    for _ in range(50):
        pool = RNG.integers(0, 1 << 62, 400, dtype=np.uint64)
        a, b = np.unique(RNG.choice(pool, RNG.integers(1, 300))), np.unique(RNG.choice(pool, RNG.integers(1, 300)))
        both = len(np.intersect1d(a, b))
        assert jaccard.overlap_bound(len(a), jaccard.bitmap(a), len(b), jaccard.bitmap(b)) >= both
        differ = sum(int(x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(jaccard.parities(a), jaccard.parities(b), strict=True))
        assert differ <= len(a) + len(b) - 2 * both


def test_nothing_links_in_an_empty_table(spark):
    assert jaccard.link(frame(spark, []), "doc_id", "text", 4, 85).collect() == []


# ---- packing


def test_packed_pieces_hold_every_id_once(spark, words):
    rows = [(i, sentence(words, int(RNG.integers(1, 900)))) for i in range(150)] + [(1, "a repeated id"), *ODD]
    rows = [r for r in rows if r[0] is not None]
    out = [r.asDict() for r in packing.pack(frame(spark, rows), "doc_id", "text").collect()]
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*tokens.encode(t or "", add_special_tokens=False).ids, packing.END_ID])
    for i, texts in ids.items():
        own = sorted((p for p in out if p["doc"] == i), key=lambda p: (p["doc_tokens"], p["start"]))
        assert sum(p["length"] for p in own) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in own:
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(texts[0][at : at + p["length"]], dtype="<u4").tobytes())
                at += p["length"]
    used = defaultdict(list)
    for p in out:
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in used.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0 and sum(n for _, n in spans) <= packing.WINDOW
    assert sum(len(t) for ts in ids.values() for t in ts) > 0.97 * packing.WINDOW * (len(used) - 1)
    assert packing.pack(frame(spark, []), "doc_id", "text").collect() == []


def test_ids_are_those_of_tokenizers_with_its_added_token(spark):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "x<|endoftext|>\n y <|endoftext|"), (4, "<|endoftext|>" * 2000)]
    ids = {r.doc: np.frombuffer(r.ids, "<u2").tolist() for r in packing.tokenized(frame(spark, rows), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"))[0].collect()}
    assert 50256 in ids[1]
    for i, t in rows:
        assert ids[i] == [*tokens.encode(t, add_special_tokens=False).ids, packing.END_ID]


def bm25(ids, held, lengths, query):
    """Scores of all documents for the distinct tokens of one, by the formula."""
    scores = np.zeros(len(ids))
    mean = np.mean(lengths)
    for t in set(query.tolist()):
        docs = [i for i, x in enumerate(ids) if held[i].get(t)]
        idf = np.log(1 + (len(ids) - len(docs) + 0.5) / (len(docs) + 0.5))
        for i in docs:
            f = held[i][t]
            scores[i] += idf * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * lengths[i] / mean))
    return scores


@pytest.mark.parametrize("dense", [0.04, 0.5, 2.0])
def test_scores_of_a_shard_equal_brute_force(spark, words, monkeypatch, dense):
    """Every document as a query with its whole vocabulary, whatever is scored by matrices and whatever by postings."""
    monkeypatch.setattr(packing, "DENSE", dense)
    monkeypatch.setattr(packing, "COLUMNS", 7)
    monkeypatch.setattr(packing, "PAIRS", 50)
    rows = [(i, sentence(words[: 40 if i % 3 else 400], int(RNG.integers(3, 60)))) for i in range(60)] + [(900, None), (901, ""), (902, "zzz " * 3000)]
    texts, counts = packing.tokenized(frame(spark, rows).repartition(3), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"))
    stats = packing.statistics(counts)
    ids = [np.frombuffer(r.ids, "<u2") for r in texts.orderBy("row").collect()]
    tf = [dict(zip(*map(np.ndarray.tolist, np.unique(x, return_counts=True)), strict=True)) for x in ids]
    found = packing.Shard(ids, stats).scores()
    for i, query in enumerate(ids):
        true = bm25(ids, tf, [len(x) for x in ids], query)
        true[i] = 0
        assert found[i] == pytest.approx(true, rel=1e-4, abs=1e-4)


def plain_fill(sizes, scores, window):
    """Documents and whether a seed asked for them, one after the other: the greedy rule with nothing but lists."""
    out, left, at, seed = [], list(range(len(sizes))), 0, None
    while left:
        if seed is None:
            seed = left.pop(0)
            out.append((seed, False))
            at += sizes[seed]
        while at % window:
            best = max(left, key=lambda d: (scores[seed][d], -d), default=None)
            if best is None or scores[seed][best] <= 0:
                break
            left.remove(best)
            out.append((best, True))
            begun, at = at // window, at + sizes[best]
            if at // window > begun:
                seed = best
        seed = None
    return out


def test_windows_are_filled_like_by_a_plain_greedy_run():
    for round_ in range(30):
        n, window = int(RNG.integers(1, 40)), 50
        sizes = RNG.integers(1, [20, 60, 170][round_ % 3], n).tolist()
        scores = np.where(RNG.random((n, n)) < [0.1, 0.9][round_ % 2], RNG.integers(0, 5, (n, n)), 0).astype(np.float32)  # many ties, some without neighbours
        np.fill_diagonal(scores, 0)
        writer = packing.Writer(window, 0)
        asked = packing.filled([(i, np.full(k, i, "<u2")) for i, k in enumerate(sizes)], scores, writer)
        firsts = [p[0] for p in writer.pieces if p[1] == 0]
        assert list(zip(firsts, asked, strict=True)) == plain_fill(sizes, scores.tolist(), window)
        assert [(p[5] * window + p[6]) for p in writer.pieces] == np.cumsum([0, *[p[2] for p in writer.pieces]])[:-1].tolist()


def test_retrieval_places_nearly_all_documents(words):
    ids = [np.array(RNG.choice(3000, int(RNG.integers(5, 300))), "<u2") for _ in range(200)]
    held = np.bincount(np.concatenate([np.unique(i) for i in ids]), minlength=packing.VOCABULARY).astype(float)
    stats = packing.Statistics(np.log(1 + (200 - held + 0.5) / (held + 0.5)).astype(np.float32), held, float(np.mean([len(i) for i in ids])), sum(map(len, ids)), 200)
    asked = packing.filled(list(enumerate(ids)), packing.Shard(ids, stats).scores(), packing.Writer(500, 0))
    assert len(asked) == 200 and np.mean(asked) > 0.9


def test_like_stands_by_like(spark, words):
    """Copies and documents of one kind follow each other in the order, whatever their numbers; rows with null keys and equal rows are all there."""
    kinds = [words[40 * k : 40 * k + 40] for k in range(8)]
    rows = [(None if i == 5 else i, sentence(kinds[i % 8], 60)) for i in range(160)] + [(1000 + i, "the very same text " * 20) for i in range(9)]
    texts, counts = packing.tokenized(frame(spark, rows).repartition(4), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"))
    placed = packing.ordered(texts, packing.statistics(counts)).orderBy("cell", "code", "row").collect()
    assert len(placed) == 169 and sum(r.doc is None for r in placed) == 1
    copies = [n for n, r in enumerate(placed) if (r.doc or 0) >= 1000]
    assert copies == list(range(copies[0], copies[0] + 9))
    kind = [(5 if r.doc is None else r.doc) % 8 for r in placed if (r.doc or 0) < 1000]
    assert np.mean([a == b for a, b in zip(kind, kind[1:], strict=False)]) > 0.6
    out = packing.pack(frame(spark, rows), "doc_id", "text", window=256, shard_docs=32).collect()
    assert sum(r.length for r in out if r.doc is None) == sum(r.doc_tokens for r in out if r.doc is None and r.start == 0) > 0


def test_pairs_share_windows_wherever_they_lie(spark):
    encoder = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    single = [t for t in map(encoder.decode, [[i] for i in range(5000, 12_000)]) if re.fullmatch(" [a-z]{5,}", t)]
    # 60 kinds of document; a window has room for four, and those of a kind share words that no other kind has
    rows = [(i, "".join([*RNG.permutation(single[:60])[:20], *RNG.permutation(single[100 + 20 * (i % 60) : 120 + 20 * (i % 60)])[:10]])) for i in range(240)]
    out = packing.pack(frame(spark, rows), "doc_id", "text", window=128, shard_docs=16).collect()
    used = defaultdict(set)
    for p in out:
        used[p.sequence_id].add(p.doc % 60)
    # the same documents one after the other, as they come
    ends, plain = np.cumsum([0, *[sum(p.length for p in out if p.doc == i) for i in range(240)]]), defaultdict(set)
    for i in range(240):
        for window in range(ends[i] // 128, (ends[i + 1] - 1) // 128 + 1):
            plain[window].add(i % 60)
    mean = lambda windows: np.mean([len(k) for k in windows.values()])
    assert mean(used) < 0.7 * mean(plain)


# ---- language


def test_languages_are_told_apart(spark):
    stems = {"en": "the and of ing tion er with that", "de": "der und sch keit ein zu mit lich", "fr": "le eau eux tion é è que pour", "es": "ción el que ar os mente lla ñ"}
    rows = []
    for lang, parts in stems.items():
        for _ in range(60):
            rows.append((len(rows), " ".join("".join(RNG.choice(parts.split(), 3)) for _ in range(40)), lang))
    docs = spark.createDataFrame([*rows, *[(i, t, None) for i, t in ODD]], "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 3 <> 1"), "text", "lang", "doc_id")
    told = [r for r in language.predict(docs, "text", model).collect()]
    held = [r for r in told if r.lang and r.doc_id % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in told)
    for r in told:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language.predict(docs, "text", language.fit(docs.where("false"), "text", "lang", "doc_id")).where("lang_pred <> 'und'").isEmpty()
    assert language.predict(docs.where("false"), "text", model).collect() == []


def test_prototypes_and_cosines_by_hand(spark):
    """Each language's prototype is the unit sum of its documents' unit bundles; ties between equal ones go to the first name."""
    rows = [(0, "aba abb aab", "x"), (2, "bab bba", "x"), (3, "cdc dcd", "y"), (5, "cdc dcd", "z"), (6, None, "x"), (7, "abab", None)]
    docs = spark.createDataFrame([*rows, (3, "cdc dcd", "y")], "doc_id long, text string, lang string")
    langs, prototypes = language.fit(docs, "text", "lang", "doc_id")
    unit = lambda v: v / np.linalg.norm(v)
    bundle = lambda t: unit(language.bundle([t])[0].astype(float))
    expected = {"x": unit(bundle(rows[0][1]) + bundle(rows[1][1])), "y": bundle("cdc dcd"), "z": bundle("cdc dcd")}
    assert langs == ["x", "y", "z"] and np.allclose(prototypes, [expected[n] for n in langs], atol=1e-4)
    told = {(r.text, r.lang_pred, round(r.score, 3)) for r in language.predict(docs, "text", (langs, prototypes)).collect()}
    cosine = {t: max((float(bundle(t) @ e), n) for n, e in expected.items()) for _, t, _ in rows if t}
    assert {(t, p) for t, p, _ in told} == {(None, "und"), ("aba abb aab", "x"), ("bab bba", "x"), ("cdc dcd", "y"), ("abab", "x")}
    assert all(abs(s - np.clip(cosine[t][0], 0, 1)) < 2e-3 for t, _, s in told if t)


def test_bundles_are_sums_of_bound_trigrams():
    items = language._items(language.DIMS).astype(float)
    a, b = (items[ord(c)] for c in "ab")
    space = items[language.SPACE]
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert np.array_equal(language.bundle(["A-b"])[0], bind(space, a, space) + bind(a, space, b) + bind(space, b, space))


# ---- toxicity


def test_toxic_words_and_stems_are_learned(spark, words):
    rows, labels = [], []
    for i in range(1500):
        text, toxic = sentence(words, int(RNG.integers(5, 80))), i % 10 == 0
        if toxic:
            bad = ["zorgle", "idiot"][i % 20 == 0] + ["", "mak", "tun", "sip"][int(RNG.integers(4))] * (i % 20 != 0)
            text = text + " " + bad + " " + sentence(words, 5) + " " + bad.upper()
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    labels += [(2, None), (0, 0), (None, 1)]
    docs, told = frame(spark, [*rows, *ODD]), spark.createDataFrame(labels, "doc_id long, toxic int")
    train = ~common.is_held_out()
    model = toxicity.fit(docs.where(train), told.where(train), "text", "doc_id")
    out = {r.doc_id: r for r in toxicity.score(docs, "text", model).where("doc_id < 90000").collect()}
    assert np.mean([out[i].predicted for i in range(0, 1500, 10)]) > 0.95
    assert np.mean([out[i].predicted for i in range(1500) if i % 10]) < 0.01
    assert toxicity.score(docs, "text", model).where("score < 0 OR score > 1 OR predicted IS NULL").isEmpty()
    none = toxicity.fit(docs, told.where("false"), "text", "doc_id")
    assert toxicity.score(docs, "text", none).where("score <> 0").isEmpty()
    assert toxicity.score(docs.where("false"), "text", model).collect() == []


# ---- licences


def test_places_equal_brute_force(spark, words):
    parts = ["cc by", "CC-BY", "general public license", "General Public\nLicense!", "all rights reserved", "all rights", "rights reserved", "public license", *words[:20], "éa", "by"]
    rows = [(i, " ".join(RNG.choice(parts, int(RNG.integers(0, 60))))) for i in range(200)] + ODD
    found = licenses.scan(frame(spark, rows), "text", ["doc_id", "text"]).collect()
    assert len(found) == len(rows)
    for r in found:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        expected = sorted((label, i) for label, phrases in licenses.BASE.items() for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert sorted((s.label, s.first_word) for s in r.spans if s.exact) == expected
        assert r.n_words == len(w)
    assert licenses.scan(frame(spark, []), "text", ["doc_id"]).collect() == []


def test_repeated_lines_of_a_short_wording_are_found(spark):
    line = "Creative Commons Attribution ShareAlike"
    rows = [(i, " ".join([line] * i)) for i in range(6)] + [(10, "x " + line + " y " + line)]
    found = {r.doc_id: [s.first_word for s in r.spans if s.label == "cc-by-sa"] for r in licenses.scan(frame(spark, rows), "text", ["doc_id"]).collect()}
    assert found == {i: [4 * j for j in range(i)] for i in range(6)} | {10: [1, 6]}


def test_kept_columns_may_have_any_name(spark):
    names = ["label", "size", "gram", "at", "exact", "template", "uid", "place", "spans", "n_words", "kept", "text", "diagonal"]
    docs = spark.createDataFrame([("a", 1, 2, None, "e", 5, 6, 7, "s", "n", "k", "All rights reserved", 9), (*[None] * 11, None, 1)], "label string, size int, gram int, at int, exact string, template int, uid int, place int, spans string, n_words string, kept string, text string, diagonal int")
    out = licenses.scan(docs, "text", [*names, "label"])
    assert out.columns == [n for n in names if n not in ("spans", "n_words")] + ["n_words", "spans"]
    one = out.where("label = 'a'").first()
    assert (one["size"], one.gram, one.at, one.kept, one.n_words, one.spans[0].label) == (1, 2, None, "k", 3, "reserved")
    assert out.where("label IS NULL").select("n_words", F.size("spans"), "diagonal").first() == (0, 0, 1)


def test_wordings_bridge_small_changes(spark):
    texts = {1: "x This work is licensed under the new GNU General Public License, version 3. y", 2: "this work is fun", 3: "Released under the MIT License."}
    found = {r.doc_id: {s.label for s in r.spans if not s.exact} for r in licenses.scan(frame(spark, texts.items()), "text", ["doc_id"]).collect()}
    assert found == {1: {"gpl-3.0"}, 2: set(), 3: {"mit"}}


# ---- pieces


def test_pieces_equal_the_library_and_decode(spark, words):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [sentence(words, 50), " two  spaces\n\ttab ", "日本 \U0001f600 é́ﬁ１\x00", "a" * 500, "", None, "▁▁x ▁", *[t for _, t in ODD]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode(docs, "text", ["doc_id", "text"], path)
    for r in coded.collect():
        assert r.ids == (library.encode(r.text) if r.text else [])
    for r in pieces.decode(coded, "ids", ["text"], path).collect():
        assert r.decoded == (r.text or "").replace("▁", " ") or "▁" in (r.text or "")
    assert pieces.encode(docs.where("false"), "text", ["doc_id"], path).collect() == []


def test_viterbi_is_the_best_path(words):
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"), best=True)
    score = dict(zip((model.texts[i].decode() for i in model.ids), model.scores, strict=True))
    some = [w.capitalize() for w in words[:80]]
    flat, counts = model.encode_all(some)["viterbi"]
    for w, ids in zip(some, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        written = " " + w
        best = [0.0] + [-np.inf] * len(written)
        for end in range(1, len(written) + 1):
            best[end] = max(best[s] + score.get(written[s:end], -np.inf) for s in range(end))
        assert sum(score[model.texts[i].decode()] for i in ids) == best[-1]
        assert model.decode(ids) == w


def test_round_trips_digest_both_ways(spark, words):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Model.load(path, best=True)
    rows = [(i, sentence(words, 40), 7) for i in range(20)] + [(i, t, 7) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ids int")
    out = pieces.round_trips(docs, "text", ["doc_id", "n_ids", "text", "text"], path)
    assert out.columns == ["doc_id", "text", "n_ids", "ids_crc32", "exact", "n_best", "best_crc32"]
    for r in out.collect():
        own, best = library.encode(r.text) if r.text else [], model.encode_all([r.text])["viterbi"][0]
        assert (r.n_ids, r.ids_crc32) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        assert (r.n_best, r.best_crc32) == (len(best), zlib.crc32(best.astype("<u4").tobytes()))
        assert r.exact == (model.decode(np.array(own, dtype=np.int64)) == (r.text or ""))
    clash = spark.createDataFrame([(1, "a b", [5], "x")], "doc_id int, text string, ids array<int>, decoded string")
    coded = pieces.encode(clash, "text", ["doc_id", "ids", "decoded"], path)
    assert coded.columns == ["doc_id", "decoded", "ids"] and pieces.decode(coded, "ids", ["decoded", "doc_id"], path).first().decoded == "a b"


# ---- the pipeline's filters


LANGUAGES = {"en": "the and of ing tion er with that", "de": "der und sch keit ein zu mit lich", "fr": "le eau eux tion que pour dans", "es": "el que ar os mente lla los"}


@pytest.fixture(scope="module")
def corpus(spark, words):
    """Documents in four languages, toxic ones among them, and columns with the names of results."""
    rows = []
    for i in range(900):
        lang = [*LANGUAGES][i % 4]
        text = " ".join("".join(RNG.choice(LANGUAGES[lang].split(), 3)) for _ in range(int(RNG.integers(8, 70))))
        rows.append((i, text + (" you zorgle zorgles moron" if i % 9 == 0 else ""), lang, f"s{i % 3}", 0.25, "zz", 7))
    schema = "doc_id long, text string, lang string, source string, score double, lang_pred string, predicted int"
    return spark.createDataFrame(rows, schema), [(i, int(i % 9 == 0)) for i in range(0, 900, 1) if i % 5]


def test_toxic_rows_go_and_columns_stay(spark, corpus, tmp_path):
    docs, labels = corpus
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    rows = kept.collect()
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert {r.doc_id for r in rows} == {i for i in range(900) if i % 9}
    assert {(r.score, r.lang_pred, r.predicted) for r in rows} == {(0.25, "zz", 7)}
    (tmp_path / "none").mkdir()
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path / "none")).count() == 900


def test_texts_in_no_learned_language_go(spark, corpus):
    docs = corpus[0]
    foreign = {10_000: "привет мир " * 30, 10_001: "привет, как дела? это длинный текст", 10_002: "日本語の文章です " * 20, 10_003: "123 456", 10_004: None, 10_005: "", 10_006: "qxzjkv wqzxj kvqxz zzxqj " * 12}
    more = spark.createDataFrame([(i, t, None, "s", 0.5, "zz", 7) for i, t in foreign.items()], docs.schema)
    kept = corpus_pipeline.drop_unknown_language(spark, docs.unionByName(more), "")
    rows = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in rows} == set(range(900)) and {r.score for r in rows} == {0.25}


def test_one_document_of_each_group_stays(spark, words):
    texts = [sentence(words, 60) for _ in range(40)]
    rows = [*enumerate(texts), (100, "123 456"), (101, None), (102, ""), (None, texts[0]), (None, texts[0]), (200, texts[0]), (201, texts[1] + " end"), (300, sentence(words, 30))]
    docs = frame(spark, rows)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert once.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in once.collect()) == sorted([*range(40), 100, 101, 102, -1, -1, 300])
    # ids that repeat: copies go, other texts under the same id stay, and so does the least id of a group
    again = [*rows, (3, texts[3]), (3, texts[3]), (3, sentence(words, 50)), (7, texts[2]), (101, None), (300, texts[39])]
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, again), "").collect())
    expected = sorted([(i, t) for i, t in enumerate(texts)] + [(100, "123 456"), (101, ""), (102, ""), (-1, texts[0]), (-1, texts[0]), (300, rows[-1][1]), (3, again[len(rows) + 2][1])])
    assert kept == expected == sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, again).repartition(5), "").collect())


def test_the_pipeline_equals_its_stages_done_by_hand(spark, corpus, tmp_path):
    """What is left: no toxic text, no foreign one, one of each group of copies by brute force, every token of it in one piece."""
    docs, labels = corpus
    copies = docs.where("doc_id % 50 = 1").withColumn("doc_id", F.col("doc_id") + 5000)
    near = docs.where("doc_id % 50 = 2").select((F.col("doc_id") + 6000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"), *docs.columns[2:])
    foreign = spark.createDataFrame([(9000, "привет мир " * 30, None, "s", 0.5, "zz", 7)], docs.schema)
    whole = docs.unionByName(copies).unionByName(near).unionByName(foreign)
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clean = [(r.doc_id, r.text) for r in whole.collect() if r.doc_id != 9000 and "zorgle" not in r.text]
    roots = brute_components(clean, 5, 80)
    left = {i: t for i, t in clean if roots[i] == i}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in out} == set(left)
    for i, t in left.items():
        ids, at = [*tokens.encode(t, add_special_tokens=False).ids, packing.END_ID], 0
        for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_the_pipeline_of_nothing_is_nothing(spark, corpus, tmp_path):
    corpus[0].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 4


def test_held_out_rows_follow_the_checksum(spark):
    told = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", common.is_held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in told)


def test_the_label_model_finds_what_the_votes_were_drawn_from():
    """Accuracies, correlated copies and posteriors against the distribution that made the votes, by Bayes' rule row for row."""
    n, prior = 40_000, 0.15
    true = RNG.random(n) < prior
    p1, p0 = np.array([0.5, 0.4, 0.3, 0.6, 0.2, 0.45]), np.array([0.02, 0.05, 0.01, 0.1, 0.03, 0.02])
    own = RNG.random((n, 6)) < np.where(true[:, None], p1, p0)
    votes = np.hstack([own, own[:, :1], own[:, :1]])  # two copies of the first voter
    known = np.where(RNG.random(n) < 0.1, true.astype(int), -1)
    model = toxicity.fit_label_model(votes, known)
    expected = p1 * prior / (p1 * prior + p0 * (1 - prior))
    assert np.abs(model.accuracy[:6] - expected).max() < 0.05
    assert model.correlation[0, 6] > 0.9 and model.correlation[6, 7] > 0.9 and model.correlation[1:6, 1:6].max() == 0
    odds = np.log(prior / (1 - prior)) + own @ np.log(p1 / p0) + (1 - own) @ np.log((1 - p1) / (1 - p0))
    right, got = 1 / (1 + np.exp(-odds)), model.posterior(votes)
    assert np.abs(got - right).mean() < 0.02 and np.corrcoef(got, right)[0, 1] > 0.98


def test_hints_leave_no_match_out():
    said = ["You are a joke", "you're such a", "STOP THIS RIGHT NOW", "no!!!", "f**k it a##b", "Get lost", "go away", "Shut up", "shut your", "Nobody likes you", "nobody cares", "What a total idiot", "what an idiot", "I will find you", "we'll get you", "Hope you die", "hope they rot", "you people", "all of you", "people like you", "your kind", "all is well", ""]
    votes = toxicity.fixed_votes(pa.array([*said, None]), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for j, pattern in enumerate(toxicity.PATTERNS.values(), len(toxicity.WORDS)):
        assert votes[:, j].tolist() == [re.search(pattern, t) is not None for t in said] + [False]
    assert votes[:-3, len(toxicity.WORDS) :].any(axis=1).all()


def test_newton_steps_end_where_no_weight_should_move():
    rows, columns = np.nonzero(RNG.random((500, 12)) < 0.2)
    y = RNG.random(500) * 0.2
    y[np.unique(rows[columns < 3])] += 0.6
    weights, bias = toxicity.fit_linear(rows, columns, 12, y)
    x = np.zeros((500, 12))
    x[rows, columns] = 1
    slope = x.T @ (1 / (1 + np.exp(-(x @ weights + bias))) - y) + 0.3 * weights
    assert (weights >= 0).all() and np.abs(slope[weights > 0]).max() < 1e-2 and (slope[weights == 0] > -1e-2).all()
    assert abs((1 / (1 + np.exp(-(x @ weights + bias))) - y).sum()) < 1e-1


def test_silent_voters_ties_and_repeats_have_one_score(spark, words):
    rows = [(i, sentence(words, 30) + (" zorgle moron" if i % 8 == 0 else "")) for i in range(800)] + [(5, "qqqq xxxx"), (5, "qqqq xxxx"), (6, ""), (7, None)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(800)] + [(1, 0), (1, None)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(docs, labels, "text", "doc_id")
    silent = toxicity.score(docs, "text", model).where("text IS NULL OR text IN ('', 'qqqq xxxx')").select("score", "predicted").distinct().collect()
    assert len(silent) == 1 and silent[0].predicted == 0 and 0 < silent[0].score < 0.1
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), "text", "doc_id")
    assert again.weights.tolist() == model.weights.tolist() and again.selected.tolist() == model.selected.tolist()


def test_few_labels_among_many_documents_are_all_learned_from(spark, words):
    rows = [(i, sentence(words, 12) + (" glorpish" if i % 80 == 0 else "")) for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 80 == 0)) for i in range(0, 4000, 40)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels, "text", "doc_id", train_rows=200)
    found = {r.doc_id for r in toxicity.score(frame(spark, rows), "text", model).where("predicted = 1").collect()}
    assert {i for i in range(0, 4000, 80)} <= found and len(found) < 100


def test_languages_and_their_floors_are_learned_from_all_rows(spark, monkeypatch):
    def sampled(*_):
        raise AssertionError("a sample")

    monkeypatch.setattr(language, "thinned", sampled)
    monkeypatch.setattr(corpus_pipeline, "thinned", sampled, raising=False)
    texts = [("the quick brown fox jumps", "en"), ("el zorro salta sobre el perro", "es")]
    rows = [(i, f"{texts[i % 2][0]} {'abcdefghij'[i % 10]}{i}", texts[i % 2][1]) for i in range(120)]
    docs = spark.createDataFrame([*rows, (120, None, "en"), (121, "xyz", None)], "doc_id long, text string, lang string")
    langs, prototypes = model = language.fit(docs, "text", "lang", "doc_id")
    for name, prototype in zip(langs, prototypes, strict=True):
        whole = language.unit(language.bundle([t for _, t, l in rows if l == name], language.DIMS)).sum(axis=0)
        assert np.allclose(prototype, whole / np.linalg.norm(whole), atol=1e-4)
    floors = corpus_pipeline._floors(docs, model)
    told = {r.doc_id: r.score for r in language.predict(docs.where("doc_id < 120"), "text", model).collect()}
    for size in {len(t).bit_length() - 1 for _, t, _ in rows}:
        scores = [told[i] for i, t, _ in rows if len(t).bit_length() - 1 == size]
        if len(scores) >= corpus_pipeline.KNOWN:
            assert floors[size] == pytest.approx(corpus_pipeline.RESEMBLES * min(scores))
