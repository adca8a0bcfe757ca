"""WARC records in ZIP packages: written by tasks, located by their directories, read in ranges.

A package is a ZIP archive with two stored members: `archive/data.warc.gz`, one gzip member for each
record, and `indexes/index.cdxj`, a line with offset and length of each record. Reading goes in two steps.
First, tasks read the directories, find the archive members and their index, and deal the records into runs
of bounded size; an archive member without an index is walked once instead. Then, tasks read each run with one
range read, whatever package it is from, so that one large package occupies many tasks.

A task writes its packages under names of its own and hands their paths back with its rows. The list of
packages is a written table, so a package of a task that was lost or ran twice is in no list and is not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import os
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, map_arrow, parallelism
from ..sources.files import is_uri, strip_file_scheme
from .tables import BROADCAST_KEYS, look_up, materialize, read_table
from .zip_members import PIECE, Member, read_members, read_pieces, stored_at

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20
PACKAGE_RECORDS = 200_000
RUN_BYTES = 4 << 20
RUNS_A_TASK = 16
DATE = "2000-01-01T00:00:00Z"
LEAST_PAYLOAD = 0

_PACKAGES = "path string, size long, records long"
_RUNS = "path string, member string, start long, lengths array<long>"
_RECORDS = ("path string, member string, offset long, record_id string, record_type string, uri string, page_id long, "
            "refers_to long, payload_bytes long, payload_digest string, payload binary")
_ARROW_RUNS = pa.schema([("path", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])
_ARROW_RECORDS = pa.schema([
    ("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()),
    ("record_type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(value: str) -> str:
    """A value in one line: control characters as in an address, by percent and code."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _block(headers: list[tuple[str, object]], first: str) -> bytes:
    lines = [first, *(f"{name}: {value}" for name, value in headers if value is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _record(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, original: dict | None, date: str) -> bytes:
    """One record; `original` is the row that it revisits."""
    content = _block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    if original is None:
        content += payload
    headers = [
        ("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", f"<urn:lumisync:row:{row}>"),
        ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _header_value(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if original is not None:
        headers += [("WARC-Refers-To", f"<urn:lumisync:row:{original['row']}>"), ("X-Refers-To-Page-ID", original["page_id"]),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(content))]
    return _block(headers, "WARC/1.1") + content + b"\r\n\r\n"


class _Package:
    """A package in the making; records go straight to the file, index lines wait for its end."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        if is_uri(self.path):
            remote, inner = pafs.FileSystem.from_uri(self.path)
            remote.create_dir(os.path.dirname(inner), recursive=True)
            self.file = remote.open_output_stream(inner)
        else:
            os.makedirs(folder, exist_ok=True)
            self.file = open(self.path, "wb")
        self.archive = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.offset, self.lines = 0, []

    def add(self, record: bytes, entry: dict) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps(entry | {"filename": DATA, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> pa.RecordBatch:
        self.member.close()
        with self.archive.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(line.encode() + b"\n")
        self.archive.close()
        size = self.file.tell()
        self.file.close()
        return pa.RecordBatch.from_pydict(
            {"path": [self.path], "size": pa.array([size], pa.int64()), "records": pa.array([len(self.lines)], pa.int64())})


def write_packages(pages: DataFrame, folder: str | None = None, least_payload: int = LEAST_PAYLOAD, date: str = DATE,
                   broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Write a record for each row of `(page_id, url, html)` and return the packages: (path, size, records).

    The payload is the text in UTF-8, null as empty. Of the rows with an equal payload of at least
    `least_payload` bytes, the one with the smallest page_id gives a `response`, the others revisit it; of
    several with that id any one, and a null id comes last. Rows with smaller payloads all give a response.
    An empty table gives no package. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = strip_file_scheme(folder or fresh_dir(spark, "warc"))
    html = F.coalesce("html", F.lit("")).alias("html")
    rows = pages.select("page_id", "url", html, F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary")))), "captures")

    equal = rows.where(F.octet_length("html") >= least_payload).groupBy("digest")
    originals = materialize(equal.agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "row")).alias("original"))
        .where("n > 1").select("digest", F.col("original").dropFields("nameless").alias("original")), "originals")
    if originals.count() <= broadcast_keys:
        linked = rows.join(F.broadcast(originals), "digest", "left")
    else:
        linked = look_up(rows, originals, ["digest"])
    original = F.when(F.col("original.row") != F.col("row"), F.col("original")).alias("original")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                payload, digest = row["html"].encode(), base64.b32encode(row["digest"]).decode()
                package = package or _Package(f"{folder}/{TaskContext.get().partitionId()}")
                package.add(_record(row["row"], row["page_id"], row["url"], payload, digest, row["original"], date),
                            {"id": row["row"], "digest": f"sha1:{digest}"})
                if package.offset >= PACKAGE_BYTES or len(package.lines) >= PACKAGE_RECORDS:
                    yield package.close()
                    package = None
        if package:
            yield package.close()

    return materialize(map_arrow(linked.select("page_id", "url", "html", "digest", "row", original), write, _PACKAGES), "packages")


@contextmanager
def _ranges(path: str) -> Iterator[Callable[[int, int], bytes]]:
    if is_uri(path):
        remote, inner = pafs.FileSystem.from_uri(path)
        with remote.open_input_file(inner) as file:
            yield lambda offset, length: file.read_at(length, offset)
    else:
        with open(path, "rb") as file:
            def read(offset: int, length: int) -> bytes:
                file.seek(offset)
                return file.read(length)

            yield read


def _is_archive(name: str) -> bool:
    return name.endswith((".warc", ".warc.gz"))


def _indexed(read: Callable[[int, int], bytes], members: list[Member]) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of each record that an index names; lines may begin with a key and a time."""
    for member in members:
        if member.name.endswith((".cdxj", ".cdx.json")):
            rest = b""
            for piece in read_pieces(read, stored_at(read, member), member.size):
                *lines, rest = (rest + piece).split(b"\n")
                yield from map(_entry, filter(None, lines))
            if rest.strip():
                yield _entry(rest)


def _entry(line: bytes) -> tuple[str, int, int]:
    entry = json.loads(line[line.index(b"{"):])
    return entry["filename"], int(entry["offset"]), int(entry["length"])


def _walk(pieces: Iterator[bytes], packed: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an archive member without an index. No record is held whole."""
    return _walk_packed(pieces) if packed else _walk_plain(pieces)


def _walk_packed(pieces: Iterator[bytes]) -> Iterator[tuple[int, int]]:
    start = offset = 0
    unpacker = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            rest = piece
            while rest and not unpacker.eof:
                unpacker.decompress(rest, PIECE)
                rest = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            offset += len(piece) - len(rest)
            piece = rest
            if unpacker.eof:
                yield start, offset - start
                start, unpacker = offset, zlib.decompressobj(31)
    if offset > start:
        raise ValueError("the last record ends early")


def _walk_plain(pieces: Iterator[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, b""
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            length = end + 4 + int(_headers(held[:end])["content-length"]) + 4
            yield start, length
            start += length
            while len(held) < length:
                length -= len(held)
                held = next(pieces, None)
                if held is None:
                    raise ValueError("the last record ends early")
            held = held[length:]
    if held:
        raise ValueError("the last record ends early")


def record_runs(packages: DataFrame) -> DataFrame:
    """(path, member, start, lengths): runs of neighbouring records of packages named in `path` and `size`.

    `start` is an offset in the package. Archive members are those named *.warc or *.warc.gz; one that no
    index names is walked. An archive member that is not stored is an error.
    """
    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                with _ranges(path) as read:
                    yield from _runs_of(path, read, size)

    return map_arrow(packages.select("path", "size"), locate, _RUNS)


def _runs_of(path: str, read: Callable[[int, int], bytes], size: int) -> Iterator[pa.RecordBatch]:
    members = list(read_members(read, size))
    starts = {m.name: stored_at(read, m) for m in members if _is_archive(m.name)}
    by_end = {name.rsplit("/", 1)[-1]: name for name in starts}  # an index may leave the folder out
    named = set()
    run: list = []  # member, start, next offset, lengths

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [path], "member": [run[0]], "start": [run[1]], "lengths": [run[3]]},
                                          schema=_ARROW_RUNS)

    def records() -> Iterator[tuple[str, int, int]]:
        for file, offset, length in _indexed(read, members):
            name = file if file in starts else by_end.get(file.rsplit("/", 1)[-1])
            if name is None:
                raise ValueError(f"the index of {path} names {file}, which is not in it")
            named.add(name)
            yield name, offset, length
        for member in members:
            if member.name in starts and member.name not in named:
                pieces = read_pieces(read, starts[member.name], member.size)
                for offset, length in _walk(pieces, member.name.endswith(".gz")):
                    yield member.name, offset, length

    for name, offset, length in records():
        at = starts[name] + offset
        if run and (run[0] != name or run[2] != at or at + length - run[1] > RUN_BYTES):
            yield ended()
            run = []
        run = run or [name, at, at, []]
        run[2] = at + length
        run[3].append(length)
    if run:
        yield ended()


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _parse(record: bytes) -> dict:
    """The fields of one record. The payload of a response must have the digest that the record states."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    content = rest[:int(fields["content-length"])]
    if len(content) < int(fields["content-length"]):
        raise ValueError("a record ends early")
    http, payload, stated = {}, content, fields.get("warc-payload-digest", "").partition(":")[2].upper() or None
    if content.startswith(b"HTTP/"):
        http_head, _, payload = content.partition(b"\r\n\r\n")
        http = _headers(http_head)
    out = {"record_id": fields.get("warc-record-id"), "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
           "page_id": _whole(fields.get("x-page-id")), "refers_to": _whole(fields.get("x-refers-to-page-id"))}
    if fields["warc-type"] == "revisit":  # headers only; they and the digest are those of the full payload
        return out | {"payload_bytes": _whole(http.get("content-length")), "payload_digest": stated, "payload": None}
    digest = payload_digest(payload)
    if stated and fields.get("warc-payload-digest", "").lower().startswith("sha1:") and stated != digest:
        raise ValueError(f"{out['record_id']}: its payload has another digest than it states")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def _whole(value: str | None) -> int | None:
    return None if value is None else int(value)


def read_records(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each WARC record of ZIP packages named in `path` and `size`, read in ranges.

    `payload` is null for revisits, whose `payload_bytes` and `payload_digest` are those of the payload
    they refer to, and without `payloads`. A record that ends early, or a payload that has not the stated
    digest, is an error.
    """
    def read_run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                with _ranges(run["path"]) as read:
                    content = read(run["start"], sum(run["lengths"]))
                rows, at = [], 0
                for length in run["lengths"]:
                    record = content[at:at + length]
                    row = _parse(gzip.decompress(record) if record[:2] == b"\x1f\x8b" else record)
                    if not payloads:
                        row["payload"] = None
                    rows.append(row | {"path": run["path"], "member": run["member"], "offset": run["start"] + at})
                    at += length
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_RECORDS)

    runs = materialize(record_runs(packages), "record-runs")
    tasks = max(parallelism(packages.sparkSession), math.ceil(runs.count() / RUNS_A_TASK))
    dealt = runs.repartition(tasks, "path", "start")  # a number of its own: these rows are short, what they stand for is not
    return map_arrow(dealt, read_run, _RECORDS)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `pages` written as WARC records, a payload once, and what the packages then say of each page."""
    records = read_records(write_packages(read_table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base32 of a digest in hex: five hex digits are four of it.
_ORACLE = """
with captures as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
ranked as (
    select *, row_number() over (partition by html order by page_id nulls last) as nth,
           first_value(page_id) over (partition by html order by page_id nulls last) as original
    from captures)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           cast(((('0x' || substr(hex, cast((i // 4) * 5 + 1 as int), 5))::bigint >> cast(15 - 5 * (i % 4) as int)) & 31) + 1 as int), 1)), '')
           as payload_digest,
       case when nth = 1 then 'response' else 'revisit' end as record_type,
       case when nth = 1 then null else original end as refers_to
from ranked
"""

QUERIES = {"op11_warc": op11_warc}
ORACLES = {"op11_warc": _ORACLE}
