"""SentencePiece encoding and decoding by batched dynamic programs in numpy.

Text is written the way the model asks (a space in front, spaces as U+2581) and cut before every run of U+2581, which no
piece crosses. The distinct words of a slice advance together by length: the hashes of all their substrings up to the
longest piece are looked up among the sorted keys of the pieces. Then

- unigram models: a Viterbi sweep over the places keeps, for all words at once, the best score and the piece that reaches it
  (of equal scores the longer last piece), and the way back is read off for all words at once;
- merge (BPE) models: the best sum of scores is not what such a model means, so the words instead merge, all at once, their
  best-scoring neighbouring pair (of equal ones the first) until none is left. The Viterbi path of such a model can be asked for
  beside that, from the same table of substrings.

A character that no piece covers becomes its bytes (or the unknown id in models without byte pieces).

Cases: null and empty texts have no pieces; repeated rows and words are encoded alike; texts of any length are encoded whole;
U+2581 in a text decodes as a space, as in the library of that name; empty tables give empty results; columns beside those
of ``keep`` are dropped, and of these a column named like one of the result gives way to it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wayfold.llm.common import bounded_batches, mix, unclashed
from wayfold.llm.common import pieces as slices

MARK = "▁"
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SIEVE = 1 << 22
#: Words kept with their pieces in a worker; the table starts anew when full.
KEPT_WORDS = 400_000
_models: dict[tuple[str, bool], "Model"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + size]
            at += size


def _hash(prefix: np.ndarray, powers: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the substrings of ``size`` characters, from hashes of all prefixes (words by rows)."""
    return mix(prefix[..., size:] - prefix[..., : prefix.shape[-1] - size] * powers[size] + np.uint64(size))


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), dtype=np.uint64)
    for j in range(codes.shape[-1]):
        out[..., j + 1] = out[..., j] * _BASE + codes[..., j] + np.uint64(1)
    return out


@dataclass
class Model:
    """A model's pieces: texts by id, sorted keys with their ids and scores, byte ids, and how text is written."""

    texts: list[bytes]
    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    sieve: np.ndarray
    longest: int
    lowest: float
    bytes_from: int
    unknown: int
    prefix: bool
    squeeze: bool
    ways: tuple[str, ...]

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.flat = {w: np.zeros(0, np.uint32) for w in self.ways}
        self.new: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {w: [] for w in self.ways}
        self.starts, self.counts = ({w: np.zeros(0, np.int64) for w in self.ways} for _ in range(2))

    @classmethod
    def load(cls, path: str, best: bool = False) -> "Model":
        """The model of a file; its first way of encoding is the model's own. With ``best``, merge models find the Viterbi path too."""
        if (path, best) in _models:
            return _models[path, best]
        with open(path, "rb") as file:
            raw = file.read()
        texts, found, bytes_from, unknown, prefix, squeeze, merges = [], [], -1, 0, True, True, False
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                text, score, kind = piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)
                if kind in (NORMAL, USER):
                    found.append((text, len(texts), score))
                elif kind == BYTE and bytes_from < 0:
                    bytes_from = len(texts)
                elif kind == UNKNOWN:
                    unknown = len(texts)
                texts.append(bytes([int(text[1:-1], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else b"" if kind == CONTROL else text.replace(MARK, " ").encode())
            elif field == 2:
                merges = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("models with a normalisation table are not supported")
                prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        longest = max(len(t) for t, _, _ in found)
        powers = _powers(longest)
        keys = np.array([_hash(_prefixes(np.array([ord(c) for c in t], dtype=np.uint64)), powers, len(t))[0] for t, _, _ in found], dtype=np.uint64)
        order = np.argsort(keys)
        sieve = np.zeros(_SIEVE, dtype=bool)
        sieve[(keys & np.uint64(_SIEVE - 1)).astype(np.int64)] = True
        ways = (("merge", "viterbi") if best else ("merge",)) if merges else ("viterbi",)
        _models[path, best] = cls(texts, keys[order], np.array([i for _, i, _ in found])[order], np.array([s for _, _, s in found])[order], sieve, longest, min(s for _, _, s in found), bytes_from, unknown, prefix, squeeze, ways)
        return _models[path, best]

    def written(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def substrings(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words by rows: the id (or -1) and the score of the piece of each size at each place; sizes come last."""
        n_words, size = codes.shape
        prefix, powers = _prefixes(codes), _powers(self.longest)
        widest = min(self.longest, size)
        ids, scores = np.full((n_words, size, widest + 1), -1, dtype=np.int32), np.full((n_words, size, widest + 1), -np.inf)
        for n in range(1, widest + 1):
            hashed = _hash(prefix, powers, n)
            row, start = np.nonzero(self.sieve[(hashed & np.uint64(_SIEVE - 1)).astype(np.int64)])
            key = hashed[row, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            real = self.keys[at] == key
            ids[row[real], start[real], n], scores[row[real], start[real], n] = self.ids[at[real]], self.scores[at[real]]
        return ids, scores

    def viterbi(self, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The best path of all words: at each place the id of the piece that begins there, -1 for none, -2 for a lone character."""
        n_words, size, widest = scores.shape
        best, back = np.full((n_words, size + 1), -np.inf), np.zeros((n_words, size + 1), dtype=np.int64)
        best[:, 0] = 0
        for end in range(1, size + 1):
            for n in range(min(widest - 1, end), 0, -1):  # the longest first: it keeps what another only equals
                reached = best[:, end - n] + scores[:, end - n, n]
                better = reached > best[:, end]
                best[better, end], back[better, end] = reached[better], n
            lone = best[:, end - 1] + self.lowest - _UNKNOWN_PENALTY
            alone = (ids[:, end - 1, 1] < 0) & (lone > best[:, end])
            best[alone, end], back[alone, end] = lone[alone], 1
        path, end = np.full((n_words, size), -1), np.full(n_words, size)
        while (going := np.flatnonzero(end)).size:
            n = back[going, end[going]]
            end[going] -= n
            piece = ids[going, end[going], n]
            path[going, end[going]] = np.where(piece < 0, -2, piece)
        return path

    def merge(self, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The outcome of merging pairs, in the form of ``viterbi``."""
        n_words, size, widest = scores.shape
        ends = np.tile(np.arange(1, size + 1), (n_words, 1))  # of the symbol that begins at each place
        begins = np.ones((n_words, size), dtype=bool)
        going = np.arange(n_words)
        while going.size and size > 1:
            own = ends[going]
            second = np.take_along_axis(np.hstack([own, np.full((len(going), 1), size)]), own, axis=1)  # where the next symbol ends
            wide = second - np.arange(size)
            able = begins[going] & (own < size) & (wide < widest)
            gain = np.where(able, np.take_along_axis(scores[going], np.where(able, wide, 0)[..., None], axis=2)[..., 0], -np.inf)
            at = gain.argmax(axis=1)
            more = gain[np.arange(len(going)), at] > -np.inf
            going, at, own, second = going[more], at[more], own[more], second[more]
            rows = np.arange(len(going))
            begins[going, own[rows, at]] = False
            ends[going, at] = second[rows, at]
        piece = np.take_along_axis(ids, (ends - np.arange(size)).clip(0, widest - 1)[..., None], axis=2)[..., 0]
        return np.where(begins, np.where(piece < 0, -2, piece), -1)

    def learn(self, words: list[str]) -> None:
        """Encode words of one length, all at once, and keep them."""
        size = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), size)
        found = self.substrings(codes.astype(np.uint64))
        for way in self.ways:
            self._add(way, getattr(self, way)(*found), codes)
        self.kept.update(zip(words, range(len(self.kept), len(self.kept) + len(words)), strict=True))

    def _add(self, way: str, path: np.ndarray, codes: np.ndarray) -> None:
        row, place = np.nonzero(path != -1)
        ids = path[row, place]
        lone = np.flatnonzero(ids == -2)
        if lone.size:
            spelled = [[self.bytes_from + b for b in chr(c).encode("utf-8", "surrogatepass")] if self.bytes_from >= 0 else [self.unknown] for c in codes[row[lone], place[lone]].tolist()]
            times = np.ones(len(ids), dtype=np.int64)
            times[lone] = [len(x) for x in spelled]
            row, ids = np.repeat(row, times), np.repeat(ids, times)
            ids[ids == -2] = [b for x in spelled for b in x]
        counts = np.bincount(row, minlength=len(codes))
        self.new[way].append((ids.astype(np.uint32), counts))

    def _settle(self) -> None:
        """What was learned since the last time behind what is kept."""
        for way, told in self.new.items():
            if told:
                counts = np.concatenate([c for _, c in told])
                self.starts[way] = np.append(self.starts[way], len(self.flat[way]) + np.cumsum(counts) - counts)
                self.counts[way], self.flat[way] = np.append(self.counts[way], counts), np.concatenate([self.flat[way], *[ids for ids, _ in told]])
                told.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has, by the model's own way."""
        return self.encode_all(texts)[self.ways[0]]

    def encode_all(self, texts: list[str | None]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The same by each of the model's ways."""
        cut = [_WORDS.findall(self.written(t)) if t else [] for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.forget()
        new: dict[int, set[str]] = defaultdict(set)
        for w in set().union(*cut).difference(self.kept):
            new[len(w)].add(w)
        for size in sorted(new):
            some = list(new[size])
            step = max(1, (1 << 21) // (size * min(size, self.longest)))  # bounded memory
            for low in range(0, len(some), step):
                self.learn(some[low : low + step])
        self._settle()
        number = np.fromiter(map(self.kept.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        cuts, told = np.concatenate(([0], np.cumsum([len(w) for w in cut]))), {}
        for way in self.ways:
            counts = self.counts[way][number]
            at = np.repeat(self.starts[way][number] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            told[way] = self.flat[way][at], np.diff(np.concatenate(([0], np.cumsum(counts)))[cuts])
        return told

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no UTF-8 become U+FFFD."""
        texts = self.texts
        text = b"".join([texts[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_WORDS = re.compile(f"(?:{MARK}+[^{MARK}]*|[^{MARK}]+)", re.DOTALL)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, dtype=np.uint64))))


def encode(df: DataFrame, text: str, keep: list[str], model_path: str) -> DataFrame:
    """The kept columns and ``ids``."""
    keep = unclashed(keep, "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(model_path)
        for part in slices(batches, text):
            flat, counts = model.encode(part.column(text).to_pylist())
            cuts = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(cuts, pa.array(flat.astype(np.int32)))], [*keep, "ids"])

    return df.select(text, *[c for c in keep if c != text]).mapInArrow(work, T.StructType([*[df.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str, keep: list[str], model_path: str) -> DataFrame:
    """The kept columns and ``decoded``; null ids decode to null."""
    keep = unclashed(keep, "decoded")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(model_path)
        for part in batches:
            values, ends = np.asarray(part.column(ids).flatten()), np.concatenate(([0], np.cumsum([0 if n is None else n for n in part.column(ids).value_lengths().to_pylist()])))
            none = np.asarray(part.column(ids).is_null())
            texts = [None if none[i] else model.decode(values[ends[i] : ends[i + 1]]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "decoded"])

    return df.select(ids, *[c for c in keep if c != ids]).mapInArrow(work, T.StructType([*[df.schema[c] for c in keep], T.StructField("decoded", T.StringType())]))


def round_trips(df: DataFrame, text: str, keep: list[str], model_path: str) -> DataFrame:
    """The kept columns, the number of ids and their CRC-32 (little-endian, 32 bits), whether they decode to the text; and
    ``n_best`` and ``best_crc32`` of the Viterbi path (null: the model's own way is that one). One pass: neither ids nor texts leave the task."""
    keep = unclashed(keep, "n_ids", "ids_crc32", "exact", "n_best", "best_crc32")

    def digests(flat: np.ndarray, counts: np.ndarray) -> list[int]:
        wide, ends = flat.astype("<u4"), np.concatenate(([0], np.cumsum(counts)))
        return [zlib.crc32(wide[low:high]) for low, high in zip(ends, ends[1:], strict=False)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(model_path, best=True)
        for part in slices(batches, text):
            texts = part.column(text).to_pylist()
            told = model.encode_all(texts)
            flat, counts = told[model.ways[0]]
            ends = np.concatenate(([0], np.cumsum(counts)))
            exact = [model.decode(flat[low:high]) == (t or "") for t, low, high in zip(texts, ends, ends[1:], strict=False)]
            best = [pa.array(told["viterbi"][1], pa.int64()), pa.array(digests(*told["viterbi"]), pa.int64())] if model.ways[0] != "viterbi" else [pa.nulls(len(texts), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(counts, pa.int64()), pa.array(digests(flat, counts), pa.int64()), pa.array(exact, pa.bool_()), *best], [*keep, "n_ids", "ids_crc32", "exact", "n_best", "best_crc32"])

    more = T.StructType.fromDDL("n_ids long, ids_crc32 long, exact boolean, n_best long, best_crc32 long")
    return df.select(text, *[c for c in keep if c != text]).mapInArrow(work, T.StructType([*[df.schema[c] for c in keep], *more]))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, by the model's own merges and by the best path, and whether they decode to the text."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trips(docs, "text", ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
