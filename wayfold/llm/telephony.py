"""Telephony audio as columns: mu-law, A-law and IMA ADPCM bytes in WAV form, expanded and resampled to linear PCM.

The companded codes are expanded by tables of 256 entries; ADPCM blocks are decoded step by step, all blocks of a batch
at once. The sound is stored as WAV files of linear PCM at twice the rate, in a table of the shared folder. Every second sample
there is one of the sound itself, and as A-law has no two codes for one sample, the stored PCM gives the payload back
(mu-law has two zeros: of its codes 127 comes back as 255). Work is per row and needs no shuffle; a batch is handled in slices
of bounded size.

Cases: null payloads are empty; a payload that is no whole number of ADPCM blocks is padded with zeros for decoding (its
stored bytes stay as they are); empty payloads give empty PCM; equal payloads give equal values; an empty table gives an
empty result; extra columns are dropped from the result except those named in ``keep``, and of these a column named like one of the
result gives way to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import bounded_batches, materialize, pieces, unclashed, utf8

RATE = 8000
#: The format tags of WAV files.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17, "linear": 1}
#: Bytes of an ADPCM block: four of state, then two samples a byte.
BLOCK = 144
PAD, UNIT = 255, 576

# Fixed values of the IMA ADPCM format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law code."""
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law code."""
    code = np.arange(256) ^ 0x55
    exponent, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(exponent == 0, low + 8, (low + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
#: The code of each 16-bit sample (by its unsigned value) that a table can give.
_CODES = {name: np.zeros(1 << 16, dtype=np.uint8) for name in ("mulaw", "alaw")}
for _name, _table in (("mulaw", MULAW), ("alaw", ALAW)):
    _CODES[_name][_table.view(np.uint16)] = np.arange(256)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks (one a row): the state's sample, then two samples for each byte."""
    n, width = blocks.shape
    out = np.empty((n, 1 + 2 * (width - 4)), dtype=np.int16)
    sample = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = sample
    for at in range(2 * (width - 4)):
        code = blocks[:, 4 + at // 2].astype(np.int32)
        code = code >> 4 if at % 2 else code & 15
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        sample = np.clip(sample + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[:, 1 + at] = sample
    return out


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; the last sample is held."""
    if not len(pcm):
        return pcm
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = (wide + np.append(wide[1:], wide[-1])) >> 1
    return out


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file of 8 kHz mono whose data chunk is the payload, byte for byte."""
    align, bits, more = (BLOCK, 4, struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4))) if codec == "adpcm" else (1, 8, struct.pack("<H", 0))
    rate = RATE * BLOCK // (1 + 2 * (BLOCK - 4)) if codec == "adpcm" else RATE
    form = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, align, bits) + more
    pad = b"\0" * (len(payload) % 2)
    samples = -(-len(payload) // BLOCK) * (1 + 2 * (BLOCK - 4)) if codec == "adpcm" else len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def linear_wav(pcm: np.ndarray, rate: int = 2 * RATE) -> bytes:
    """A WAV file of 16-bit mono."""
    form = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", 2 * len(pcm)) + pcm.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, bytes]:
    """The codec and the payload of a stored WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(k for k, v in TAGS.items() if v == tag)
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(payload: bytes, codec: str) -> np.ndarray:
    """The linear samples of a payload."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    if codec == "adpcm":
        blocks = np.zeros((-(-len(raw) // BLOCK), BLOCK), dtype=np.uint8)
        blocks.reshape(-1)[: len(raw)] = raw
        return decode_adpcm(blocks).reshape(-1)
    return (MULAW if codec == "mulaw" else ALAW)[raw]


def companded(pcm: np.ndarray, codec: str) -> bytes:
    """The codes of samples that the codec's table gave."""
    return _CODES[codec][pcm.view(np.uint16)].tobytes()


def store(df: DataFrame, payload: str, keep: list[str], codec: str = "mulaw") -> DataFrame:
    """The columns of ``keep`` and ``media``: the payload as a WAV file of the codec."""

    keep = unclashed(keep, "media")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, payload):
            media = [wav(x.as_py() or b"", codec) for x in part.column(payload)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(media, pa.binary())], [*keep, "media"])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("media", T.BinaryType())])
    return df.select(payload, *[c for c in keep if c != payload]).mapInArrow(work, schema)


def features(lines: dict[str, np.ndarray]) -> str:
    """Loudness, peak and zero crossings of each reading of the bytes, and a checksum of the 16 kHz PCM of the first."""
    said = []
    for name, pcm in lines.items():
        wide = pcm.astype(np.int64)
        loud = int(np.sqrt((wide * wide).sum() // max(len(wide), 1)))
        said.append(f"{name}:rms={loud},peak={int(np.abs(wide).max(initial=0))},crossings={int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))}")
    first = resample_double(next(iter(lines.values())))
    return ";".join(said) + f";pcm16k={len(first)}:{zlib.crc32(first.tobytes()):08x}"


def read_back(df: DataFrame, keep: list[str], media: str = "media", pcm: bool = True, codec: str = "alaw") -> DataFrame:
    """Stored WAV files read: codec, payload, PCM at 16 kHz (left out unless ``pcm``) and features of the bytes.

    The features hear the bytes by each of the three codecs; ``pcm16k`` is the resampled sound of the file's own codec. Files of
    linear PCM at 16 kHz are read as ``codec``, which gave their every second sample.
    """
    fields = "codec string, payload binary, feature string" + (", pcm16k binary" if pcm else "")
    keep = unclashed(keep, "codec", "payload", "feature", "pcm16k")

    def heard(stored: bytes) -> tuple[str, bytes]:
        own, data = unwav(stored)
        return (codec, companded(np.frombuffer(data, dtype="<i2")[::2], codec)) if own == "linear" else (own, data)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, media):
            files = [heard(x.as_py()) for x in part.column(media)]
            raws = [np.frombuffer(p, dtype=np.uint8) for _, p in files]
            counts = [-(-len(r) // BLOCK) for r in raws]
            blocks = np.zeros((sum(counts), BLOCK), dtype=np.uint8)
            at = 0
            for r, n in zip(raws, counts, strict=True):
                blocks[at : at + n].reshape(-1)[: len(r)] = r
                at += n
            decoded, at = decode_adpcm(blocks), 0
            said, sounds = [], []
            for (name, _), r, n in zip(files, raws, counts, strict=True):
                lines = {"mulaw": MULAW[r], "alaw": ALAW[r], "adpcm": decoded[at : at + n].reshape(-1)}
                own = {name: lines.pop(name)} | lines
                said.append(features(own))
                if pcm:
                    sounds.append(resample_double(own[name]).tobytes())
                at += n
            columns = [*[part.column(c) for c in keep], pa.array([c for c, _ in files], pa.string()), pa.array([p for _, p in files], pa.binary()), pa.array(said, pa.string())]
            names = [*keep, "codec", "payload", "feature"]
            if pcm:
                columns, names = [*columns, pa.array(sounds, pa.binary())], [*names, "pcm16k"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL(fields)])
    return df.select(media, *[c for c in keep if c != media]).mapInArrow(work, schema)


def store_pcm(df: DataFrame, media: str, keep: list[str], name: str = "telephony") -> DataFrame:
    """A table in the shared folder with the columns of ``keep`` and ``media``: the sound of each WAV file as linear PCM at 16 kHz."""
    keep = unclashed(keep, "media")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, media):
            files = [unwav(x.as_py()) for x in part.column(media)]
            sounds = [linear_wav(resample_double(expand(data, codec))) for codec, data in files]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(sounds, pa.binary())], [*keep, "media"])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("media", T.BinaryType())])
    return materialize(df.select(media, *[c for c in keep if c != media]).mapInArrow(work, schema), name, level=6)


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text taken as A-law sound, stored as PCM at 16 kHz, read back and described."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", utf8("text").alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    whole = F.greatest(F.lit(UNIT), F.ceil(F.col("n_bytes") / UNIT) * UNIT)
    filler = F.unhex(F.repeat(F.lit(f"{PAD:02x}"), UNIT))
    padded = sized.withColumn("payload", F.concat("raw", F.substring(filler, F.lit(1), (whole - F.col("n_bytes")).cast("int"))))
    stored = store_pcm(store(padded, "payload", ["doc_id", "n_bytes"], "alaw"), "media", ["doc_id", "n_bytes"])
    heard = read_back(stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}), ["doc_id", "n_bytes", "media_bytes", "media_sha256"], pcm=False)
    return heard.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
