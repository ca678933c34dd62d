"""Contents made around the tables' texts, so that queries have archives, OLE files, executables and certificates to read."""

from __future__ import annotations

import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.blob import BATCH_BYTES, bound_batches


def zipped(entries: dict[str, bytes], stored: bool = True) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(zipfile.ZipInfo(name), body, z.compression)
    return out.getvalue()


def tarred(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, body in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def executable(characteristics: int, subsystem: int, body: bytes = b"") -> bytes:
    start = struct.pack("<2s58xI4sHH12xHH", b"MZ", 64, b"PE\0\0", 0x14C, 1, 0xE0, characteristics) + struct.pack("<H", 0x10B)
    return start.ljust(64 + 24 + 68, b"\0") + struct.pack("<H", subsystem).ljust(256, b"\0") + body


def compound(streams: dict[str, bytes], storages: tuple[str, ...] = (), shift: int = 9) -> bytes:
    """An OLE file with one stream for each name; its directory's sectors lie in reverse order."""
    sector = 1 << shift
    per = sector // 4
    entries = [("Root Entry", 5, 0xFFFFFFFE, 0)]
    data: list[bytes] = []
    chains: list[list[int]] = []
    for name, body in streams.items():
        n = -(-len(body) // sector)
        first = len(data)
        data += [body[i * sector : (i + 1) * sector].ljust(sector, b"\0") for i in range(n)]
        chains.append(list(range(first, first + n)))
        entries.append((name, 2, first if n else 0xFFFFFFFE, len(body)))
    entries += [(name, 1, 0xFFFFFFFE, 0) for name in storages]
    raw = b"".join(struct.pack("<64sHBBIII16sIQQIQ", n.encode("utf-16-le"), 2 * len(n) + 2, k, 1, *[0xFFFFFFFF] * 3, b"", 0, 0, 0, s, size) for n, k, s, size in entries)
    pieces = [raw[i : i + sector].ljust(sector, b"\0") for i in range(0, len(raw), sector)]
    chain = list(range(len(data), len(data) + len(pieces)))[::-1]
    data += pieces[::-1]
    chains.append(chain)
    n_fat = 1
    while n_fat * per < len(data) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("too long for a header's table")
    table = [0xFFFFFFFF] * (n_fat * per)
    for c in chains:
        for here, after in zip(c, [*c[1:], 0xFFFFFFFE]):
            table[here] = after
    fat = list(range(len(data), len(data) + n_fat))
    for f in fat:
        table[f] = 0xFFFFFFFD
    header = struct.pack("<8s16sHHHHH6sIIIIIIIIII", bytes.fromhex("D0CF11E0A1B11AE1"), b"", 0x3E, 3, 0xFFFE, shift, 6, b"", 0, n_fat, chain[0], 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, fat[0])
    header += struct.pack("<108I", *(fat + [0xFFFFFFFF] * 109)[1:109])
    return header.ljust(sector, b"\0") + b"".join(data) + struct.pack(f"<{len(table)}I", *table)


def tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    size = n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")
    return bytes([tag]) + (size if n < 128 else bytes([0x80 | len(size)]) + size) + body


def oid(dotted: str) -> bytes:
    a, b, *rest = map(int, dotted.split("."))
    out = bytearray()
    for value in (40 * a + b, *rest):
        septets = [value & 0x7F]
        while value := value >> 7:
            septets.append(value & 0x7F | 0x80)
        out += bytes(reversed(septets))
    return tlv(0x06, bytes(out))


def _name(parts: dict[str, str]) -> bytes:
    return tlv(0x30, *(tlv(0x31, tlv(0x30, oid(k), tlv(0x0C, v.encode()))) for k, v in parts.items()))


def certificate(subject: dict[str, str], issuer: dict[str, str], begins: str, ends: str, alternative: str | None = None) -> bytes:
    """A certificate whose signature is made up; times as ``YYMMDDhhmmssZ``, names by object identifiers."""
    algorithm = tlv(0x30, oid("1.2.840.113549.1.1.11"), tlv(0x05))
    key = tlv(0x30, tlv(0x30, oid("1.2.840.113549.1.1.1"), tlv(0x05)), tlv(0x03, b"\0" * 33))
    more = [tlv(0xA3, tlv(0x30, tlv(0x30, oid("2.5.29.17"), tlv(0x04, tlv(0x30, tlv(0x82, alternative.encode()))))))] if alternative else []
    validity = tlv(0x30, *(tlv(0x17 if len(t) == 13 else 0x18, t.encode()) for t in (begins, ends)))
    body = tlv(0x30, tlv(0xA0, tlv(0x02, b"\2")), tlv(0x02, b"\1"), algorithm, _name(issuer), validity, _name(subject), key, *more)
    return tlv(0x30, body, algorithm, tlv(0x03, b"\0" + b"\5" * 64))


def signed_data(*certificates: bytes) -> bytes:
    inner = tlv(0x30, tlv(0x02, b"\1"), tlv(0x31), tlv(0x30, oid("1.2.840.113549.1.7.1")), tlv(0xA0, *certificates), tlv(0x31))
    return tlv(0x30, oid("1.2.840.113549.1.7.2"), tlv(0xA0, inner))


def key_store(body: bytes) -> bytes:
    return tlv(0x30, tlv(0x02, b"\3"), tlv(0x30, oid("1.2.840.113549.1.7.1"), tlv(0xA0, tlv(0x04, body))), tlv(0x30))


def rar5(names: dict[str, bytes], encrypted: bool = False, hidden: bool = False) -> bytes:
    vint = lambda n: bytes([*((n >> 7 * i & 0x7F) | 0x80 for i in range((max(1, n.bit_length()) - 1) // 7)), n >> 7 * ((max(1, n.bit_length()) - 1) // 7)])

    def block(kind, flags, body, data=b"", extra=b""):
        inner = vint(kind) + vint(flags) + (vint(len(extra)) if flags & 1 else b"") + (vint(len(data)) if flags & 2 else b"") + body + extra
        return b"\0\0\0\0" + vint(len(inner)) + inner + data

    if hidden:
        return b"Rar!\x1a\x07\x01\x00" + block(4, 0, vint(0) * 2 + b"\x0f" + b"s" * 16)
    record = vint(3) + vint(1) + b"\0\0"
    files = [block(2, 2 | encrypted, vint(4) + vint(len(d)) + vint(0) + b"crc!" + vint(0) + vint(0) + vint(len(n.encode())) + n.encode(), d, record if encrypted else b"") for n, d in names.items()]
    return b"Rar!\x1a\x07\x01\x00" + block(1, 0, vint(0)) + b"".join(files) + block(5, 0, vint(0))


def rar4(names: dict[str, bytes], encrypted: bool = False, hidden: bool = False) -> bytes:
    block = lambda kind, flags, body, data=b"": struct.pack("<HBHH", 0, kind, flags, 7 + len(body)) + body + data
    main = block(0x73, 0x80 * hidden, bytes(6))
    files = [block(0x74, 0x8000 | 4 * encrypted, struct.pack("<IIBIIBBHI", len(d), len(d), 0, 0, 0, 29, 0x30, len(n), 0) + n.encode(), d) for n, d in names.items()]
    return b"Rar!\x1a\x07\x00" + main + b"".join(files) + block(0x7B, 0, b"")


def seven(names: dict[str, bytes], packed: bool = False, aes: bool = False) -> bytes:
    def number(n: int) -> bytes:
        size = max(0, (n.bit_length() - 1) // 7)
        return bytes([0xFF & ~(0xFF >> size) | n >> 8 * size]) + (n & (1 << 8 * size) - 1).to_bytes(size, "little")

    body = b"".join(names.values())
    raw = b"\0" + "".join(n + "\0" for n in names).encode("utf-16-le")
    coder = b"\x24\x06\xf1\x07\x01\x01\x00" if aes else b"\x01\x00"
    streams = b"\x06" + number(0) + number(1) + b"\x09" + number(len(body)) + b"\0" + b"\x07\x0b" + number(1) + b"\0" + number(1) + coder + b"\x0c" + number(len(body)) + b"\x0a\x01" + b"crc!" + b"\0" + b"\x08\x0d" + number(len(names)) + b"\x09" + b"".join(number(len(d)) for d in list(names.values())[:-1]) + b"\0\0"
    header = b"\x01\x04" + streams + b"\x05" + number(len(names)) + b"\x11" + number(len(raw)) + raw + b"\0\0"
    if packed:
        small = lzma.compress(header, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16}])
        info = b"\x06" + number(len(body)) + number(1) + b"\x09" + number(len(small)) + b"\0" + b"\x07\x0b" + number(1) + b"\0" + number(1) + b"\x23\x03\x01\x01\x05\x5d" + struct.pack("<I", 1 << 16) + b"\x0c" + number(len(header)) + b"\0\0"
        body, header = body + small, b"\x17" + info
    return b"7z\xbc\xaf\x27\x1c\0\4crc!" + struct.pack("<QQ", len(body), len(header)) + b"crc!" + body + header


def image(exports: list[str], version: dict[str, str], body: bytes = b"", dll: bool = True) -> bytes:
    """An executable of two sections, ``.text`` with ``body`` and ``.rsrc`` with exports and a version resource."""
    text_at, data_at = 0x400, 0x400 + -(-max(1, len(body)) // 512) * 512
    start = 0x1000 + -(-max(1, len(body)) // 4096) * 4096  # the address of the second section
    names = b"".join(e.encode() + b"\0" for e in exports)
    first = start + 40 + 4 * len(exports)
    places, at = [], first
    for e in exports:
        places.append(at)
        at += len(e) + 1
    table = bytes(24) + struct.pack("<IIII", len(exports), 0, start + 40, 0) + struct.pack(f"<{len(places)}I", *places) + names
    table += b"\0" * (-len(table) % 4)
    strings = "".join(f"{k}\0{chr(0) * (len(k) % 2)}{v}\0\0" for k, v in version.items()).encode("utf-16-le")
    root = len(table)
    directory = lambda ident, offset: struct.pack("<12xHHII", 0, 1, ident, offset)
    leaf = root + 72 + 16
    tree = directory(16, 0x80000000 | 24) + directory(1, 0x80000000 | 48) + directory(1033, 72) + struct.pack("<IIII", start + leaf, len(strings), 0, 0)
    data = table + tree + strings
    optional = bytearray(0xE0)
    struct.pack_into("<H", optional, 0, 0x10B)
    struct.pack_into("<HH", optional, 68, 2, 0x4140)
    struct.pack_into("<II", optional, 96, start, len(table) if exports else 0)
    struct.pack_into("<II", optional, 96 + 16, start + root, len(tree) + len(strings))
    sections = struct.pack("<8sIIII16x", b".text", len(body), 0x1000, data_at - text_at, text_at) + struct.pack("<8sIIII16x", b".rsrc", len(data), start, len(data), data_at)
    head = struct.pack("<2s58xI4sHH12xHH", b"MZ", 64, b"PE\0\0", 0x14C, 2, len(optional), 0x2002 if dll else 2) + bytes(optional) + sections
    return head.ljust(text_at, b"\0") + body.ljust(data_at - text_at, b"\0") + data


def contents(docs: DataFrame, make: Callable[[int, bytes], bytes]) -> DataFrame:
    """``doc_id`` and ``content``: ``make`` of each document's key and its text as bytes."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k.as_py(), (t.as_py() or "").encode()) for b in batches for k, t in zip(b.column("doc_id"), b.column("text")))
        keys, made, size = [], [], 0
        for key, text in rows:
            keys.append(key)
            made.append(make(key, text))
            size += len(made[-1])
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "content"])
                keys, made, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, content binary")
