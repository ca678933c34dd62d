"""ZIP archives by their central directory, read in ranges: the end record, the directory, and chosen entries alone.

``read(offset, n)`` gives ``n`` bytes, fewer at the end, of a file or of a value; nothing else of it is touched.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Read = Callable[[int, int], bytes]
#: Bytes of packed data that are read at a time.
PIECE = 1 << 16


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    packed: int
    size: int
    offset: int
    encrypted: bool
    symlink: bool


def reader(content: bytes) -> Read:
    return lambda offset, n: content[max(0, offset) : max(0, offset) + max(0, n)]


def _directory(read: Read, size: int) -> tuple[int, int, int] | None:
    """Place and length of the central directory, and how far the archive lies behind where it takes its start to be."""
    base = max(0, size - 65557)
    tail = read(base, 65557)
    at = tail.rfind(b"PK\x05\x06")
    # the comment may hold the mark too: the record is the last whose comment ends with the file
    while at >= 0 and (at + 22 > len(tail) or at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") > len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        return None
    length, offset = struct.unpack_from("<II", tail, at + 12)
    end = base + at
    locator = read(end - 20, 20) if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07" and 0xFFFFFFFF in (length, offset) or locator[:4] == b"PK\x06\x07" and tail[at + 10 : at + 12] == b"\xff\xff":
        wide = int.from_bytes(locator[8:16], "little")
        record = read(wide, 56)
        if record[:4] == b"PK\x06\x06" and len(record) == 56:
            length, offset = struct.unpack_from("<QQ", record, 40)
            end = wide
    start = end - length
    return (start, length, start - offset) if start >= 0 else None


def entries(read: Read, size: int, most: int = 64 << 20) -> list[Entry] | None:
    """The entries that the central directory names, None where there is none; ``most``: bytes of it that are read."""
    found = _directory(read, size)
    if found is None:
        return None
    start, length, moved = found
    block, at, out = read(start, min(length, most)), 0, []
    while at + 46 <= len(block) and block[at : at + 4] == b"PK\x01\x02":
        flags, method = struct.unpack_from("<HH", block, at + 8)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", block, at + 20)
        attributes, offset = struct.unpack_from("<II", block, at + 38)
        raw, extra = block[at + 46 : at + 46 + n], block[at + 46 + n : at + 46 + n + m]
        if len(raw) < n:
            break
        fields = dict(_extra(extra))
        wide = fields.get(1, b"")
        values = [packed, plain, offset]
        for i, order in enumerate((1, 0, 2)):  # the 64-bit field has the plain size first, only those that are needed
            if values[order] == 0xFFFFFFFF and len(wide) >= 8:
                values[order], wide = int.from_bytes(wide[:8], "little"), wide[8:]
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        out.append(Entry(name, method, values[0], values[1], values[2] + moved, bool(flags & 1) or 0x9901 in fields, (attributes >> 16) & 0o170000 == 0o120000))
        at += 46 + n + m + k
    return out


def _extra(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + n]
        at += 4 + n


def body(read: Read, entry: Entry, limit: int) -> bytes | None:
    """The first ``limit`` bytes of an entry's content; None if it is encrypted, packed in another way, or broken from the start."""
    if entry.encrypted or entry.method not in (0, 8):
        return None
    header = read(entry.offset, 30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        return None
    n, m = struct.unpack_from("<HH", header, 26)
    at, end = entry.offset + 30 + n + m, entry.offset + 30 + n + m + entry.packed
    if entry.method == 0:
        return read(at, min(limit, end - at))
    unpacker, out = zlib.decompressobj(-15), bytearray()
    try:
        while at < end and len(out) < limit and not unpacker.eof:
            piece = read(at, min(PIECE, end - at))
            if not piece:
                break
            out += unpacker.decompress(piece, limit - len(out))
            at += len(piece)
    except zlib.error:
        return bytes(out) or None
    return bytes(out)
