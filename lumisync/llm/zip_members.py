"""Members of a ZIP archive by range reads: the directory at its end, ZIP64 or not, and where stored bytes lie.

Nothing is extracted, and no more than `PIECE` bytes of a directory are held at a time. All functions take
`read(offset, length)`, which gives the bytes there, fewer only at the end.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

STORED = 0
PIECE = 1 << 20
_END = struct.Struct("<4s4H2LH")
_LOCATOR = struct.Struct("<4sLQL")
_END_64 = struct.Struct("<4sQ2H2L4Q")
_ENTRY = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
_FULL_16, _FULL_32 = 0xFFFF, 0xFFFFFFFF  # the value is in a ZIP64 record
_ZIP64_FIELD = 1

Read = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    header: int  # where its local header starts
    packed: int  # bytes in the archive
    size: int


def _end_record(read: Read, size: int) -> tuple[int, tuple]:
    """Where the end record starts, and its fields. Its comment may hold the same signature."""
    tail_at = max(0, size - _END.size - _FULL_16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0:
        if at + _END.size <= len(tail):
            fields = _END.unpack_from(tail, at)
            if at + _END.size + fields[-1] == len(tail):
                return tail_at + at, fields
        at = tail.rfind(b"PK\x05\x06", 0, at)
    raise ValueError("no end record: not a ZIP archive, or not a whole one")


def read_members(read: Read, size: int) -> Iterator[Member]:
    """The members that the central directory of an archive of `size` bytes names."""
    end, (_, disk, _, _, n, length, start, _) = _end_record(read, size)
    shift = 0
    if _FULL_16 in (disk, n) or _FULL_32 in (length, start):
        signature, _, at, _ = _LOCATOR.unpack(read(end - _LOCATOR.size, _LOCATOR.size))
        if signature != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator before the end record")
        fields = _END_64.unpack(read(at, _END_64.size))
        if fields[0] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points to")
        n, length, start = fields[-3:]
    else:
        shift = end - length - start  # bytes before the archive proper, as of a self-extracting one
        if shift < 0:
            raise ValueError("the directory does not fit into the archive")
    held, at, left = b"", start + shift, length
    for _ in range(n):
        while len(held) < _ENTRY.size or len(held) < _ENTRY.size + sum(_ENTRY.unpack_from(held)[10:13]):
            piece = read(at, min(PIECE, left))
            if not piece:
                raise ValueError("the directory ends early")
            held, at, left = held + piece, at + len(piece), left - len(piece)
        entry = _ENTRY.unpack_from(held)
        if entry[0] != b"PK\x01\x02":
            raise ValueError("not a directory entry")
        flags, method = entry[3:5]
        packed, unpacked, n_name, n_extra, n_comment = entry[8:13]
        name = held[_ENTRY.size:_ENTRY.size + n_name]
        extra = held[_ENTRY.size + n_name:_ENTRY.size + n_name + n_extra]
        held = held[_ENTRY.size + n_name + n_extra + n_comment:]
        unpacked, packed, header = _wide(extra, unpacked, packed, entry[-1])
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, header + shift, packed, unpacked)


def _wide(extra: bytes, *fields: int) -> list[int]:
    """Sizes and offset, those beyond 32 bits from the ZIP64 field, which has them in the same order."""
    at, values = 0, b""
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == _ZIP64_FIELD:
            values = extra[at + 4:at + 4 + length]
        at += 4 + length
    out, taken = [], 0
    for field in fields:
        if field == _FULL_32:
            if taken + 8 > len(values):
                raise ValueError("a size beyond 32 bits without a ZIP64 field")
            field = struct.unpack_from("<Q", values, taken)[0]
            taken += 8
        out.append(field)
    return out


def stored_at(read: Read, member: Member) -> int:
    """Where the bytes of a stored member start. A compressed one cannot be read in ranges."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed (method {member.method}), not stored")
    local = _LOCAL.unpack(read(member.header, _LOCAL.size))
    if local[0] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + _LOCAL.size + local[-2] + local[-1]


def read_pieces(read: Read, start: int, length: int, piece: int = PIECE) -> Iterator[bytes]:
    """A stretch of an archive, piece by piece."""
    end = start + length
    while start < end:
        content = read(start, min(piece, end - start))
        if not content:
            raise ValueError("the archive ends early")
        yield content
        start += len(content)
