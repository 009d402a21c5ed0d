"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record; records whose payload repeats that of another are revisits of it. Captures
are sorted by (URL key with the host reversed, page id) and cut into compressed blocks of ``BLOCK_LINES`` lines. Each index
part ends in a sparse directory with the first capture of every block, and a small table has the first capture of every
part. A lookup searches the parts, then the part's directory by bisection, reads one range of the index file (its block),
bisects the block, and reads one range of the archive (the record).

Files are written to the shared folder under names of their own for every attempt of a task; only those named by the rows
of attempts that succeeded are ever read, so that lost executors leave unused files at worst.

Cases: a null payload is empty; a null URL has the empty key; a null id sorts first and is written as ``null``; of rows with
equal payloads those with the largest id are responses (all of them, if that id repeats; all, if every id is null) and the
others revisit that id; repeated rows give a record each; empty tables give no records; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import bounded_batches, materialize, pieces, utf8
from wayfold.sources.shared import new_path

BLOCK_LINES, OPEN_FILES = 256, 64
#: Payload groups are broadcast up to so many (some 100 bytes each); beyond that the join shuffles.
BROADCAST_GROUPS = 100_000
DATE = "2024-01-01T00:00:00Z"
_LEAST = -(1 << 63)


def url_key(url: str) -> Column:
    """The sort key of a URL: its host's labels reversed and joined by commas, then ``)`` and the rest."""
    whole = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20]", "%20")
    rest = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.when(whole == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", "")))


def roles(df: DataFrame, key: str, payload: str) -> DataFrame:
    """The rows with ``raw`` (the payload's bytes) and ``refers_to``, null for responses."""
    rows = df.withColumn("raw", utf8(payload)).withColumn("sha", F.unhex(F.sha1("raw")))
    groups = rows.groupBy("sha").agg(F.max(key).alias("winner"), F.count("*").alias("n")).where("n > 1 AND winner IS NOT NULL").select("sha", "winner")
    groups = materialize(groups, "warc-groups")
    small = groups.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if small else groups, "sha", "left")
    return joined.withColumn("refers_to", F.when(~F.col("winner").eqNullSafe(F.col(key)), F.col("winner"))).drop("winner", "sha")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:wayfold:page:{'null' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else "%20" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields: page_id, type, digest, payload (of responses), payload_bytes and refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: None if x is None or x.endswith(":null>") else int(x.rpartition(":")[2][:-1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "record_type": kind, "payload_digest": digest, "payload": payload if kind == "response" else None, "payload_bytes": size, "refers_to": number(fields.get("WARC-Refers-To"))}


def _place(folder: str, stem: str) -> tuple[fs.FileSystem, str, str]:
    """A file system, a folder in it, and a file name that no other attempt has."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    context = TaskContext.get()
    return system, path, f"{stem}-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}"


def write_archives(df: DataFrame, folder: str, key: str, url: str) -> DataFrame:
    """Write rows with ``raw`` and ``refers_to`` as archives; the captures: surt, page_id, file, start, size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, ""
        try:
            for part in pieces(batches, "raw"):
                if out is None:
                    system, path, name = _place(folder, "archive")
                    name += ".warc.gz"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                starts, sizes = [], []
                for page_id, target, raw, refers_to in zip(*[part.column(c).to_pylist() for c in (key, url, "raw", "refers_to")], strict=True):
                    member = gzip.compress(record(page_id, target, raw, refers_to), 6, mtime=0)
                    out.write(member)
                    starts.append(at)
                    sizes.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([part.column("surt"), part.column(key), pa.array([name] * part.num_rows), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["surt", "page_id", "file", "start", "size"])
        finally:
            if out is not None:
                out.close()

    made = df.select(F.col(key).cast("long").alias(key), url, url_key(url).alias("surt"), "raw", "refers_to").mapInArrow(work, "surt string, page_id long, file string, start long, size long")
    return materialize(made, "warc-captures")


@dataclass
class CaptureIndex:
    """Where archives and index parts are, and each part's first capture, in order."""

    archives: str
    folder: str
    parts: list[tuple[bytes, int, str]]


def build_index(captures: DataFrame, archives: str, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort the captures, write the index parts, and keep the table of parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, first, name, lines, directory = None, 0, None, "", [], []

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            out.write(block)
            directory.append([*lines[0][:2], at, len(block)])
            at += len(block)
            lines.clear()

        for part in batches:
            for row in zip(*[part.column(c).to_pylist() for c in ("surt", "page_id", "file", "start", "size")], strict=True):
                if out is None:
                    system, path, name = _place(folder, "captures")
                    out, first = system.open_output_stream(f"{path}/{name}", compression=None), row
                lines.append(row)
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
            out.write(tail + struct.pack("<q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], ["surt", "page_id", "file"])

    tasks = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = captures.repartitionByRange(tasks, "surt", "page_id", "start").sortWithinPartitions("surt", "page_id", "file", "start")
    parts = materialize(dealt.mapInArrow(work, "surt string, page_id long, file string"), "warc-parts")
    found = sorted(_rank(r.surt, r.page_id) + (r.file,) for r in parts.collect())  # a row for each index part
    return CaptureIndex(archives, folder, found)


def _rank(surt: str, page_id: int | None) -> tuple[bytes, int]:
    return surt.encode(), _LEAST if page_id is None else page_id


class _Reader:
    """The files of one task: ranges of index parts and archives."""

    def __init__(self, index: CaptureIndex):
        self.index, self.system = index, None
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.directories: OrderedDict[str, list] = OrderedDict()
        self.block: tuple[str, int] | None = None
        self.lines: list = []

    def range(self, folder: str, name: str, start: int, size: int) -> bytes:
        uri = f"{folder}/{name}"
        if uri not in self.open:
            system, path = fs.FileSystem.from_uri(uri)
            self.open[uri] = system.open_input_file(path)
            if len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        file = self.open[uri]
        return file.read_at(size, file.size() + start if start < 0 else start)

    def directory(self, name: str) -> list:
        if name not in self.directories:
            size = struct.unpack("<q", self.range(self.index.folder, name, -8, 8))[0]
            rows = json.loads(zlib.decompress(self.range(self.index.folder, name, -8 - size, size)))
            self.directories[name] = [(*_rank(r[0], r[1]), r[2], r[3]) for r in rows]
            if len(self.directories) > 4:
                self.directories.popitem(last=False)
        return self.directories[name]

    def captures(self, surt: str, page_id: int | None, any_id: bool) -> Iterator[tuple]:
        """The index lines of a key and id (or of any id), over as many blocks as hold them."""
        low = (surt.encode(), _LEAST if any_id or page_id is None else page_id)
        high = (surt.encode(), (1 << 63) if any_id else low[1])
        parts = self.index.parts
        at = max(0, bisect_left(parts, low, key=lambda p: p[:2]) - 1)
        for first_surt, first_id, name in parts[at:]:
            if (first_surt, first_id) > high:
                return
            directory = self.directory(name)
            b = max(0, bisect_left(directory, low, key=lambda d: d[:2]) - 1)
            for block in directory[b:]:
                if block[:2] > high:
                    break
                if self.block != (name, block[2]):
                    raw = zlib.decompress(self.range(self.index.folder, name, block[2], block[3]))
                    self.block, self.lines = (name, block[2]), [json.loads(x) for x in raw.decode().split("\n")]
                of = lambda x: _rank(x[0], x[1])
                yield from self.lines[bisect_left(self.lines, low, key=of) : bisect_right(self.lines, high, key=of)]

    def record(self, line: list) -> dict:
        return parse(gzip.decompress(self.range(self.index.archives, *line[2:5])))


def lookup(queries: DataFrame, index: CaptureIndex, any_id: bool = False, payload: bool = True) -> DataFrame:
    """The records of queries (surt, page_id; with ``any_id`` of all captures of the key), read by ranges. Queries count once."""
    names = ["surt", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"] + ["payload"] * payload
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * payload

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        rows: list[dict] = []
        size = 0
        for part in batches:
            for surt, page_id in zip(part.column("surt").to_pylist(), part.column("page_id").to_pylist(), strict=True):
                for line in reader.captures(surt, page_id, any_id):
                    rows.append({"surt": surt, **reader.record(line)})
                    size += 200 + payload * len(rows[-1]["payload"] or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names)

    asked = queries.select("surt", F.lit(None).cast("long").alias("page_id") if any_id else F.col("page_id").cast("long").alias("page_id")).distinct()
    tasks = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = asked.repartitionByRange(tasks, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    schema = "surt string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payload
    return dealt.mapInArrow(work, schema)


def archive(df: DataFrame, key: str, url: str, payload: str) -> CaptureIndex:
    """Write all rows as archives in the shared folder, and their index."""
    bounded_batches(df.sparkSession)
    folder = new_path(df.sparkSession, "warc")
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))  # whatever their names were
    captures = write_archives(roles(rows, "page_id", "html"), f"{folder}/archives", "page_id", "url")
    return build_index(captures, f"{folder}/archives", f"{folder}/index")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = archive(pages, "page_id", "url", "html")
    back = lookup(pages.select(url_key("url").alias("surt"), "page_id"), index, payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
