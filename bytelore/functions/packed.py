"""RAR and 7z archives by their headers: names, sizes and what is encrypted; nothing is unpacked but 7z's own packed headers.

``read(offset, n)`` is as in ``zipdir``.  Headers that are encrypted tell nothing but that; a chain of headers ends where it is
broken.
"""

from __future__ import annotations

import lzma
import struct
from dataclasses import dataclass, field

from .zipdir import Read

RAR4, RAR5, SEVEN = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00", b"7z\xbc\xaf\x27\x1c"
#: Longest header that is read, and most entries that are listed.
MOST_HEADER, MOST_LISTED = 16 << 20, 100_000
_LZMA, _AES = bytes.fromhex("030101"), bytes.fromhex("06F10701")


@dataclass
class Listing:
    """``encrypted_headers``: the names themselves are hidden.  ``entries``: name, size, whether encrypted."""

    encrypted_headers: bool = False
    entries: list[tuple[str, int, bool]] = field(default_factory=list)


def _rar4(read: Read, size: int) -> Listing:
    out, at = Listing(), 7
    while at + 7 <= size and len(out.entries) < MOST_LISTED:
        head = read(at, 7)
        if len(head) < 7:
            break
        kind, flags, length = struct.unpack_from("<BHH", head, 2)
        if length < 7 or not 0x72 <= kind <= 0x7B:
            break
        block = read(at, length)
        more = struct.unpack_from("<I", block, 7)[0] if (flags & 0x8000 or kind == 0x74) and len(block) >= 11 else 0
        if kind == 0x73 and flags & 0x80:
            out.encrypted_headers = True
            break
        if kind == 0x74 and len(block) >= 32:
            plain, name_size = struct.unpack_from("<I", block, 11)[0], struct.unpack_from("<H", block, 26)[0]
            start = 32
            if flags & 0x100:
                high, high_plain = struct.unpack_from("<II", block, 32) if len(block) >= 40 else (0, 0)
                more, plain, start = more | high << 32, plain | high_plain << 32, 40
            raw = block[start : start + name_size]
            out.entries.append((raw.split(b"\0")[0].decode("utf-8", "replace"), plain, bool(flags & 4)))
        if kind == 0x7B:
            break
        at += length + more
    return out


class _Cursor:
    """Numbers of several bytes one after another; beyond the end an ``IndexError``."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise IndexError(n)
        self.at += n
        return out

    def small_first(self) -> int:
        """RAR: seven bits a byte, the lowest first."""
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value
            if shift > 63:
                raise IndexError(shift)

    def seven(self) -> int:
        """7z: the first byte's leading ones count the bytes that follow, lowest first; its other bits are the highest."""
        first = self.byte()
        value = 0
        for i in range(8):
            mask = 0x80 >> i
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * i
            value |= self.byte() << 8 * i
        return value


def _rar5(read: Read, size: int) -> Listing:
    out, at = Listing(), 8
    while at + 7 <= size and len(out.entries) < MOST_LISTED:
        start = _Cursor(read(at + 4, 10))
        try:
            length = start.small_first()
            if length > 2 << 20:
                break
            c = _Cursor(read(at + 4 + start.at, length))
            kind, flags = c.small_first(), c.small_first()
            extra = c.small_first() if flags & 1 else 0
            data = c.small_first() if flags & 2 else 0
            if kind == 4:
                out.encrypted_headers = True
                break
            if kind == 2:
                about, plain, _ = c.small_first(), c.small_first(), c.small_first()
                c.take(4 * bool(about & 2) + 4 * bool(about & 4))
                c.small_first(), c.small_first()
                name = c.take(c.small_first()).decode("utf-8", "replace")
                hidden, records = False, _Cursor(c.data[len(c.data) - extra :] if extra else b"")
                while records.at < len(records.data):
                    n = records.small_first()
                    hidden |= _Cursor(records.take(n)).small_first() == 1
                out.entries.append((name, plain, hidden))
            if kind == 5:
                break
        except IndexError:
            break
        at += 4 + start.at + length + data
    return out


def _streams(c: _Cursor) -> tuple[int, list[int], list[list[tuple[bytes, bytes]]], list[list[int]]]:
    """Place and sizes of packed streams, coders (id, properties) and unpacked sizes of folders."""
    place, packed, folders, sizes = 0, [], [], []
    while kind := c.byte():
        if kind == 6:
            place, n = c.seven(), c.seven()
            while part := c.byte():
                if part == 9:
                    packed = [c.seven() for _ in range(n)]
                elif part == 10:
                    _digests(c, n)
                else:
                    raise IndexError(part)
        elif kind == 7:
            if c.byte() != 11:
                raise IndexError(kind)
            n = c.seven()
            if c.byte():  # kept elsewhere
                raise IndexError(kind)
            outputs = []
            for _ in range(n):
                coders, ins, outs = [], 0, 0
                for _ in range(c.seven()):
                    about = c.byte()
                    name = c.take(about & 0x0F)
                    i, o = (c.seven(), c.seven()) if about & 0x10 else (1, 1)
                    coders.append((name, c.take(c.seven()) if about & 0x20 else b""))
                    ins, outs = ins + i, outs + o
                for _ in range(2 * (outs - 1)):
                    c.seven()
                if ins - outs + 1 > 1:
                    for _ in range(ins - outs + 1):
                        c.seven()
                folders.append(coders)
                outputs.append(outs)
            while part := c.byte():
                if part == 12:
                    sizes = [[c.seven() for _ in range(o)] for o in outputs]
                elif part == 10:
                    _digests(c, n)
                else:
                    raise IndexError(part)
        elif kind == 8:
            counts = [1] * len(folders)
            part = c.byte()
            if part == 13:
                counts = [c.seven() for _ in folders]
                part = c.byte()
            if part == 9:
                for n in counts:
                    for _ in range(max(0, n - 1)):
                        c.seven()
                part = c.byte()
            if part == 10:
                _digests(c, sum(counts))
                part = c.byte()
            if part:
                raise IndexError(part)
        else:
            raise IndexError(kind)
    return place, packed, folders, sizes


def _digests(c: _Cursor, n: int) -> None:
    known = n if c.byte() else sum(bin(b).count("1") for b in c.take((n + 7) // 8))
    c.take(4 * known)


def _seven(read: Read, size: int) -> Listing:
    out, head = Listing(), read(0, 32)
    if len(head) < 32:
        return out
    offset, length = struct.unpack_from("<QQ", head, 12)
    if length > MOST_HEADER or 32 + offset + length > size:
        return out
    data = read(32 + offset, length)
    try:
        while data[:1] == b"\x17":
            place, packed, folders, sizes = _streams(c := _Cursor(data[1:]))
            coders = folders[0]
            if any(name == _AES for name, _ in coders):
                out.encrypted_headers = True
                return out
            name, properties = coders[0]
            body = read(32 + place, min(packed[0], MOST_HEADER))
            if name == _LZMA and len(coders) == 1 and sizes[0][0] <= MOST_HEADER:
                first, dictionary = properties[0], int.from_bytes(properties[1:5], "little")
                filters = [{"id": lzma.FILTER_LZMA1, "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45, "dict_size": max(4096, min(dictionary, 1 << 26))}]
                data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(body, sizes[0][0])
            elif name == b"\0":
                data = body
            else:
                return out
        c = _Cursor(data)
        if c.byte() != 1:
            return out
        hidden: list[bool] = []
        kind = c.byte()
        while kind in (2, 3, 4):
            if kind == 2:
                while c.byte():
                    c.take(c.seven())
            else:
                folders = _streams(c)[2]
                hidden = [any(name == _AES for name, _ in coders) for coders in folders] if kind == 4 else hidden
            kind = c.byte()
        if kind == 5:
            n = c.seven()
            names: list[str] = []
            while part := c.byte():
                block = c.take(c.seven())
                if part == 17 and block[:1] == b"\0":
                    names = block[1:].decode("utf-16-le", "replace").split("\0")[:n]
            out.entries = [(name, 0, any(hidden)) for name in (names or [""] * min(n, MOST_LISTED))][:MOST_LISTED]
    except (IndexError, lzma.LZMAError, ValueError):
        pass
    return out


def listing(read: Read, size: int) -> Listing | None:
    """What the headers of a RAR or 7z archive tell; None for other contents.  A 7z's sizes are not listed (0)."""
    first = read(0, 8)
    if first[:8] == RAR5:
        return _rar5(read, size)
    if first[:7] == RAR4:
        return _rar4(read, size)
    return _seven(read, size) if first[:6] == SEVEN else None
