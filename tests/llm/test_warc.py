import base64
import gzip
import hashlib
import io
import random
import struct
import zipfile

import pytest

from lumisync.llm import warc as W
from lumisync.llm import zip_members as Z

SCHEMA = "page_id long, url string, html string, digest string, row string, original string, path string, size string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "p", "s") for r in rows], SCHEMA)


def brute_force(rows, least=0):
    by_payload = {}
    for i, (page_id, _, html) in enumerate(rows):
        by_payload.setdefault(html or "", []).append((page_id is None, page_id or 0, i))
    out = []
    for i, (page_id, _, html) in enumerate(rows):
        payload = (html or "").encode()
        nameless, first, at = min(by_payload[html or ""])
        revisit = at != i and len(payload) >= least
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit and not nameless else None))
    return sorted(out, key=repr)


def _got(records):
    return sorted((tuple(r) for r in records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ROWS = [
    (3, "http://a/\r\nWARC-Type: x", "<p>one</p>"), (1, "http://b/é", "<p>one</p>"), (2, None, None), (4, "u", ""), (5, "", "é\r\n\r\n" * 9),
    (6, "http://c/" + "x" * 9000, "long " * 300_000), (7, "u", "long " * 300_000), (7, "u", "long " * 300_000), (8, "u", "one"),
    (8, "u", "two"), (None, "u", "<p>one</p>"), (None, None, None), (None, "u", "nameless"), (None, "u", "nameless"), (1, "again", "<p>one</p>"),
    (9, "u", "HTTP/1.1 200 OK\r\n\r\nbody"), (10, "u", "WARC/1.1\r\n\r\n"), (-5, "u", "minus"), (0, "u", "minus"),
]


def test_round_trip(spark, monkeypatch):
    pages = _pages(spark, ROWS).repartition(3)
    packages = W.write_packages(pages)
    assert _got(W.read_records(packages)) == brute_force(ROWS)
    assert packages.agg({"records": "sum"}).first()[0] == len(ROWS)
    payloads = {(r.page_id, r.payload_digest): r.payload for r in W.read_records(packages).collect() if r.record_type == "response"}
    assert all(payloads[i, W.payload_digest(p)] == p for i, p in [(5, ("é\r\n\r\n" * 9).encode()), (6, b"long " * 300_000), (2, b"")])
    monkeypatch.setattr(W, "PACKAGE_RECORDS", 2)
    monkeypatch.setattr(W, "RUN_BYTES", 300)
    packages = W.write_packages(pages, least_payload=9, broadcast_keys=0)
    assert packages.count() >= 8 and _got(W.read_records(packages, payloads=False)) == brute_force(ROWS, 9)


def test_hot_payload(spark):
    rows = [(i, "u", "same" if i % 3 else f"other {i % 50}") for i in range(3000, 0, -1)]
    for keys in (0, 100):
        assert _got(W.read_records(W.write_packages(_pages(spark, rows), broadcast_keys=keys))) == brute_force(rows)


def test_empty_table(spark):
    packages = W.write_packages(_pages(spark, []))
    assert packages.collect() == [] and W.read_records(packages).collect() == []


def test_uris_stay_in_their_line(spark):
    found = {r.page_id: r.uri for r in W.read_records(W.write_packages(_pages(spark, ROWS[:3]))).collect()}
    assert found == {3: "http://a/%0D%0AWARC-Type: x", 1: "http://b/é", 2: None}


def _over(content):
    return lambda offset, length: content[offset:offset + length]


def _records(n):
    return [W._record(i, i, f"http://x/{i}", b"page %d " % i * (i % 7), W.payload_digest(b"page %d " % i * (i % 7)), None, W.DATE)
            for i in range(n)]


def _foreign(spark, folder, members, name="x.zip", before=b"", comment=b""):
    """A package from another writer."""
    content = io.BytesIO()
    content.write(before)
    with zipfile.ZipFile(content, "a" if before else "w", zipfile.ZIP_STORED) as archive:
        for member, body, method in members:
            archive.writestr(member, body, method)
        archive.comment = comment
    (folder / name).write_bytes(content.getvalue())
    return spark.createDataFrame([(str(folder / name), len(content.getvalue()))], "path string, size long")


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("piece", [50, 1 << 20])
def test_archives_without_an_index_are_walked(spark, tmp_path, packed, piece):
    bodies = [gzip.compress(r) if packed else r for r in _records(40)]
    name = "archive/a.warc.gz" if packed else "archive/a.warc"
    pieces = Z.read_pieces(_over(b"".join(bodies)), 0, len(b"".join(bodies)), piece)
    edges = list(W._walk(pieces, packed))
    assert [n for _, n in edges] == [len(b) for b in bodies] and edges[-1][0] == sum(map(len, bodies[:-1]))
    with pytest.raises(ValueError, match="ends early"):
        list(W._walk(Z.read_pieces(_over(b"".join(bodies)), 0, len(b"".join(bodies)) - 3, piece), packed))
    packages = _foreign(spark, tmp_path, [("readme.txt", b"hello", 8), (name, b"".join(bodies), 0)], before=b"#!junk\n" * 9,
                        comment=b"a comment with PK\x05\x06 in it")
    found = W.read_records(packages).collect()
    assert sorted(r.page_id for r in found) == list(range(40)) and all(r.payload == b"page %d " % r.page_id * (r.page_id % 7) for r in found)


def test_an_index_from_elsewhere(spark, tmp_path):
    bodies = [gzip.compress(r) for r in _records(5)]
    lines, at = [], 0
    for i, body in enumerate(bodies):
        lines.append('com,x)/%d 20200101000000 {"url": "u", "filename": "a.warc.gz", "offset": "%d", "length": "%d"}' % (i, at, len(body)))
        at += len(body)
    packages = _foreign(spark, tmp_path, [("archive/a.warc.gz", b"".join(bodies), 0), ("indexes/i.cdxj", "\n".join(lines[1:3]), 0),
                                          ("archive/b.warc.gz", gzip.compress(_records(6)[5]), 0)])
    assert sorted(r.page_id for r in W.read_records(packages).collect()) == [1, 2, 5]  # what the index names, and what it does not cover


def test_damage_is_an_error(spark, tmp_path):
    record = _records(4)[3]
    for i, (members, message) in enumerate([
            ([("a.warc.gz", gzip.compress(record), 8)], "compressed"),
            ([("a.warc", record.replace(b"page 3 ", b"page X "), 0)], "another digest"),
            ([("a.warc", b"nothing\r\n" + record, 0)], "not a WARC record"),
            ([("a.warc", record, 0), ("i.cdxj", '{"filename": "b.warc", "offset": 0, "length": 9}', 0)], "not in it")]):
        with pytest.raises(Exception, match=message):
            W.read_records(_foreign(spark, tmp_path, members, f"{i}.zip")).collect()
    for content, message in [(b"", "no end record"), (b"PK\x05\x06", "no end record"), (b"x" * 100_000, "no end record")]:
        with pytest.raises(ValueError, match=message):
            list(Z.read_members(_over(content), len(content)))


def test_directories_agree_with_the_library(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(Z, "PIECE", 100)
    for n in (0, 1, 300):
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w") as archive:
            for i in range(n):
                with archive.open(zipfile.ZipInfo(f"fé/{i}" + "n" * rng.randrange(200)), "w", force_zip64=i % 2 == 0) as member:
                    member.write(b"%d" % i * rng.randrange(50))
        body = content.getvalue()
        with zipfile.ZipFile(content) as archive:
            members = list(Z.read_members(_over(body), len(body)))
            assert [(m.name, m.method, m.header, m.packed, m.size) for m in members] == [
                (i.filename, i.compress_type, i.header_offset, i.compress_size, i.file_size) for i in archive.infolist()]
            for m in members:
                assert b"".join(Z.read_pieces(_over(body), Z.stored_at(_over(body), m), m.size, 7)) == archive.read(m.name)


def test_zip64_directory_beyond_4_gb():
    """A sparse archive: a member of 5 GB, another after it, and more than 65,535 entries."""
    gap, n = 5 << 30, 70_000
    first = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 0) + b"a"
    second = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 3, 3, 1, 4) + b"b" + b"\x99\x99\x00\x00" + b"xyz"
    at = len(first) + gap

    def entry(name, size, header):
        wide = [v for v in (size, size, header) if v >= 0xFFFFFFFF]
        extra = struct.pack("<2H", 0x7777, 2) + b"zz" + struct.pack(f"<2H{len(wide)}Q", 1, 8 * len(wide), *wide)
        small = [min(v, 0xFFFFFFFF) for v in (size, size, header)]
        return struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, *small[:2], len(name), len(extra), 0, 0, 0, 0, small[2]) + name + extra

    entries = [entry(b"a", gap, 0)] + [entry(b"b%d" % i, 3, at) for i in range(n - 1)]
    directory, start = b"".join(entries), at + len(second)
    end_64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(directory), start)
    tail = directory + end_64 + struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(directory), 1) + struct.pack(
        "<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, min(len(directory), 0xFFFFFFFF), 0xFFFFFFFF, 0)
    size = start + len(tail)

    def read(offset, length):
        out = b""
        for base, body in ((0, first), (at, second), (start, tail)):
            low, high = max(offset, base), min(offset + length, base + len(body))
            if low < high:
                out += body[low - base:high - base]
        return out

    members = list(Z.read_members(read, size))
    assert len(members) == n and members[0] == Z.Member("a", 0, 0, gap, gap)
    assert Z.stored_at(read, members[0]) == len(first)
    assert members[-1].header == at and read(Z.stored_at(read, members[-1]), 3) == b"xyz"


def test_query(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert _got(W.op11_warc(spark, sf)) == brute_force(rows)
