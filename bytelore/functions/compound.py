"""Directories of compound (OLE) files, read sector by sector: header, sector chains, 128-byte entries.

``read(offset, n)`` is as in ``zipdir``.  A directory costs its own sectors and those of the allocation table that link
them.  Chains that lead back to themselves or out of the file end there.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .zipdir import Read

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
#: Numbers of sectors from here on are marks: end of a chain, free, and so on.
_MARKS = 0xFFFFFFFA
_KINDS = {1: "storage", 2: "stream", 5: "root"}


@dataclass(frozen=True)
class Entry:
    name: str
    kind: str
    size: int


class _Table:
    """The allocation table: which sector follows which."""

    def __init__(self, read: Read, size: int, header: bytes, sector: int) -> None:
        self.read, self.sector, self.sectors, self.held = read, sector, max(0, size // sector), {}
        self.ids = [x for x in struct.unpack_from("<109I", header, 76) if x < _MARKS]
        more, seen = struct.unpack_from("<I", header, 68)[0], set()
        while more < _MARKS and more not in seen and len(seen) < self.sectors:
            seen.add(more)
            block = self.of(more)
            if len(block) < sector:
                break
            *ids, more = struct.unpack(f"<{sector // 4}I", block)
            self.ids += [x for x in ids if x < _MARKS]

    def of(self, number: int) -> bytes:
        # the header fills the first sector, however long sectors are
        return self.read((number + 1) * self.sector, self.sector)

    def after(self, number: int) -> int:
        place, slot = divmod(number, self.sector // 4)
        if place >= len(self.ids):
            return _MARKS
        if place not in self.held:
            self.held[place] = self.of(self.ids[place])
        block = self.held[place]
        return struct.unpack_from("<I", block, 4 * slot)[0] if len(block) >= 4 * slot + 4 else _MARKS


def entries(read: Read, size: int) -> list[Entry] | None:
    """The directory's entries; None if this is no compound file or nothing of its directory can be read."""
    header = read(0, 512)
    if len(header) < 512 or header[:8] != MAGIC:
        return None
    shift = struct.unpack_from("<H", header, 30)[0]
    if not 9 <= shift <= 20:
        return None
    table, out, seen = _Table(read, size, header, 1 << shift), [], set()
    number = struct.unpack_from("<I", header, 48)[0]
    while number < _MARKS and number not in seen and len(seen) <= table.sectors:
        seen.add(number)
        block = table.of(number)
        for at in range(0, len(block) - 127, 128):
            length, kind = struct.unpack_from("<HB", block, at + 64)
            if 4 <= length <= 64 and kind in _KINDS:
                name = block[at : at + length - 2].decode("utf-16-le", "replace")
                if name.strip():
                    out.append(Entry(name, _KINDS[kind], struct.unpack_from("<Q", block, at + 120)[0]))
        if len(block) < 1 << shift:
            break
        number = table.after(number)
    return out or None
