"""Sections, exports and version strings of Windows executables, by addresses mapped through the section table.

``read(offset, n)`` is as in ``zipdir``.  What points out of the file is left out.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .zipdir import Read

# The strings of a version resource that are told; most exports that are listed.
VERSION_KEYS = ["CompanyName", "ProductName", "FileVersion", "ProductVersion", "FileDescription", "OriginalFilename", "InternalName", "LegalCopyright"]
MOST_EXPORTS, MOST_SECTIONS, MOST_ENTRIES = 4096, 96, 4096
_VERSION = 16


@dataclass
class Image:
    """``sections``: name, address, size in memory, place and size in the file."""

    sections: list[tuple[str, int, int, int, int]] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    version: dict[str, str] = field(default_factory=dict)


def place_of(image: Image, address: int) -> int | None:
    """The file's offset of an address."""
    for _, start, in_memory, at, raw in image.sections:
        if start <= address < start + max(in_memory, raw):
            return at + address - start
    return None


def _exports(read: Read, image: Image, address: int) -> list[str]:
    at = place_of(image, address)
    head = read(at, 40) if at is not None else b""
    if len(head) < 40:
        return []
    n, names = struct.unpack_from("<I", head, 24)[0], struct.unpack_from("<I", head, 32)[0]
    at = place_of(image, names)
    table = read(at, 4 * min(n, MOST_EXPORTS)) if at is not None else b""
    places = (place_of(image, a) for (a,) in struct.iter_unpack("<I", table[: len(table) // 4 * 4]))
    found = (read(p, 512).split(b"\0")[0].decode("latin-1") for p in places if p is not None)
    return [x for x in found if x.strip()]


def _entries(read: Read, at: int) -> list[tuple[int, int]]:
    """Ids and offsets of a resource directory."""
    head = read(at, 16)
    if len(head) < 16:
        return []
    n = min(sum(struct.unpack_from("<HH", head, 12)), MOST_ENTRIES)
    body = read(at + 16, 8 * n)
    return list(struct.iter_unpack("<II", body[: len(body) // 8 * 8]))


def _version(read: Read, image: Image, address: int) -> dict[str, str]:
    """Strings of the first version resource that has any: types, names and languages lead to its data."""
    root = place_of(image, address)
    if root is None:
        return {}
    for kind, types in _entries(read, root):
        if kind != _VERSION or not types & 0x80000000:
            continue
        for _, names in _entries(read, root + (types & 0x7FFFFFFF)):
            for _, leaf in _entries(read, root + (names & 0x7FFFFFFF)) if names & 0x80000000 else []:
                data = read(root + leaf, 16) if not leaf & 0x80000000 else b""
                at = place_of(image, struct.unpack_from("<I", data)[0]) if len(data) == 16 else None
                text = read(at, min(struct.unpack_from("<I", data, 4)[0], 1 << 16)).decode("utf-16-le", "replace") if at is not None else ""
                found = {k: v for k in VERSION_KEYS if (v := _value(text, k))}
                if found:
                    return found
    return {}


def _value(text: str, key: str) -> str:
    """The string behind a key; keys and values end with zeros, one of which may be filling."""
    at = text.find(key + "\0")
    if at < 0:
        return ""
    return text[at + len(key) :].lstrip("\0").split("\0", 1)[0].strip()


def parse(read: Read, size: int) -> Image | None:
    """None for what is no executable with a PE header."""
    head = read(0, 64)
    if len(head) < 64 or head[:2] != b"MZ":
        return None
    at = struct.unpack_from("<I", head, 60)[0]
    header = read(at, 24)
    if len(header) < 24 or header[:4] != b"PE\0\0":
        return None
    n, optional = struct.unpack_from("<H", header, 6)[0], struct.unpack_from("<H", header, 20)[0]
    body = read(at + 24, optional)
    table = read(at + 24 + optional, 40 * min(n, MOST_SECTIONS))
    image = Image()
    for i in range(len(table) // 40):
        name, in_memory, start, raw, place = struct.unpack_from("<8sIIII", table, 40 * i)
        image.sections.append((name.rstrip(b"\0").decode("latin-1"), start, in_memory, place, raw))
    first = (112 if body[:2] == b"\x0b\x02" else 96) if len(body) >= 2 else 0
    directory = lambda i: struct.unpack_from("<II", body, first + 8 * i) if first and len(body) >= first + 8 * i + 8 else (0, 0)
    (exports, n_exports), (resources, n_resources) = directory(0), directory(2)
    if exports and n_exports:
        image.exports = _exports(read, image, exports)
    if resources and n_resources:
        image.version = _version(read, image, resources)
    return image
