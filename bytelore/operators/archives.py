"""Archives: entries come from an Arrow function that walks the container, all that is said of them is expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compound, containers, packed, zipdir

# Extensions of entries that run, are scripts, install, or are archives.
EXECUTABLE = "exe dll sys ocx cpl scr com pif".split()
SCRIPT = "ps1 psm1 psd1 bat cmd sh bash zsh js vbs vbe wsf wsh py rb".split()
INSTALLER = "msi msp msix appx msixbundle appxbundle".split()
NESTED = "zip 7z rar tar gz tgz bz2 xz jar war ear apk".split()
MAX_TAR_ENTRIES = 512

_ENTRY = pa.struct([("name", pa.string()), ("size", pa.int64()), ("encrypted", pa.bool_()), ("symlink", pa.bool_()), ("head", pa.binary())])
_ENTRY_SQL = "array<struct<name:string,size:long,encrypted:boolean,symlink:boolean,head:binary>>"
_SAFETY = pa.struct([("traversal", pa.bool_()), ("absolute", pa.bool_()), ("symlink", pa.bool_())])
_SAFETY_SQL = "struct<traversal:boolean,absolute:boolean,symlink:boolean>"
_ABSOLUTE = re.compile(r"[A-Za-z]:|[/\\]")


def zip_entries(content: bytes, head: int = 64) -> list[dict] | None:
    """Entries of a ZIP by its central directory, None if it has none; the first bytes of those that can be unpacked."""
    read = zipdir.reader(content)
    found = zipdir.entries(read, len(content))
    if found is None:
        return None
    return [{"name": e.name, "size": e.size, "encrypted": e.encrypted, "symlink": e.symlink, "head": zipdir.body(read, e, head) or b""} for e in found]


def _tar_headers(content: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """Place, size, kind and name of every entry of a TAR, to its end or the first broken header."""
    at = 0
    while at + 512 <= len(content) and content[at : at + 512].strip(b"\0"):
        block = content[at : at + 512]
        try:
            size = int(block[124:136].strip(b" \0") or b"0", 8)
        except ValueError:
            break
        if size < 0:  # would lead back
            break
        prefix, name = (x.split(b"\0")[0].decode("utf-8", "replace") for x in (block[345:500], block[:100]))
        yield at, size, block[156:157], f"{prefix}/{name}" if prefix else name
        at += 512 + (size + 511) // 512 * 512


def _is_link(kind: bytes) -> bool:
    return kind in (b"1", b"2")


def tar_members(content: bytes, limit: int) -> Iterator[tuple[str, int, bytes]]:
    """Name, size and the first bytes of every plain file in a TAR."""
    for at, size, kind, name in _tar_headers(content):
        if kind in (b"0", b"\0", b""):
            yield name, size, content[at + 512 : at + 512 + min(size, limit)]


def tar_entries(content: bytes, head: int = 64) -> list[dict] | None:
    """The first entries of a TAR, None if it is none."""
    if content[257:262] != b"ustar":
        return None
    return [
        {"name": name, "size": size, "encrypted": False, "symlink": _is_link(kind), "head": content[at + 512 : at + 512 + min(size, head)]}
        for at, size, kind, name in islice(_tar_headers(content), MAX_TAR_ENTRIES)
    ]


def tar_safety(content: bytes) -> dict | None:
    """Whether any entry of a TAR, however many it has, leads upwards, is absolute or is a link; None if it is none."""
    if content[257:262] != b"ustar":
        return None
    out = dict.fromkeys(_SAFETY.names, False)
    for _, _, kind, name in _tar_headers(content):
        out["traversal"] |= name.startswith("/") or ".." in name.replace("\\", "/").split("/")
        out["absolute"] |= _ABSOLUTE.match(name) is not None
        out["symlink"] |= _is_link(kind)
    return out


def packed_entries(content: bytes) -> list[dict] | None:
    """Entries of a RAR or 7z by its headers, None if it is neither."""
    found = packed.listing(zipdir.reader(content), len(content))
    if found is None:
        return None
    listed = [("", 0, True)] if found.encrypted_headers else found.entries
    return [{"name": name, "size": size, "encrypted": hidden, "symlink": False, "head": b""} for name, size, hidden in listed]


def with_entries(blobs: DataFrame, content: str = "content") -> DataFrame:
    """``blobs`` with ``entries``: those of ZIP, TAR, RAR and 7z contents, null for others and for broken ones.

    A TAR lists ``MAX_TAR_ENTRIES`` at most, as the original does; ``safety`` tells of all its entries, and is null for
    others.  A RAR or 7z whose very headers are encrypted has one entry without a name, which is encrypted; of a 7z no
    sizes are told.
    """
    names = blobs.columns
    at = names.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, safety = [], []
            for x in b.column(at).to_pylist():
                zipped = x is None or x[:2] == b"PK"
                found.append(None if x is None else zip_entries(x) if zipped else tar_entries(x) if x[257:262] == b"ustar" else packed_entries(x))
                safety.append(None if zipped else tar_safety(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(_ENTRY)), pa.array(safety, _SAFETY)], [*names, "entries", "safety"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema)
    return blobs.mapInArrow(run, f"{schema}, entries {_ENTRY_SQL}, safety {_SAFETY_SQL}")


_DIRECTORY = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("size", pa.int64())]))


def with_directory(blobs: DataFrame, content: str = "content") -> DataFrame:
    """``blobs`` with ``directory``: names, kinds (root, storage, stream) and sizes of an OLE file's entries; null for others."""
    names = blobs.columns
    at = names.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if x is None else compound.entries(zipdir.reader(x), len(x)) for x in b.column(at).to_pylist()]
            listed = [None if f is None else [{"name": e.name, "kind": e.kind, "size": e.size} for e in f] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(listed, _DIRECTORY)], [*names, "directory"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema)
    return blobs.mapInArrow(run, f"{schema}, directory array<struct<name:string,kind:string,size:long>>")


def _ext(e: Column) -> Column:
    return F.lower(F.regexp_extract(e["name"], r"\.([^./\\]+)$", 1))


def archive_facts(entries: Column, safety: str = "safety") -> Column:
    """Flags (names as ``assess.FLAGS`` has them), counts, commonest extensions, and the type that the entries tell.

    The column ``safety`` of ``with_entries`` adds what it found beyond the entries listed.
    """
    unlisted = lambda flag: F.coalesce(F.col(safety)[flag], F.lit(False))
    any_ext = lambda names: F.exists(entries, lambda e: _ext(e).isin(names))
    parts = lambda e: F.split(F.translate(e["name"], "\\", "/"), "/")
    disguised = F.exists(entries, lambda e: (F.hex(F.substring(e["head"], 1, 2)) == "4D5A") & ~_ext(e).isin([*EXECUTABLE, *INSTALLER]))
    flags = {
        "archive_path_traversal": F.exists(entries, lambda e: F.array_contains(parts(e), F.lit("..")) | e["name"].startswith("/")) | unlisted("traversal"),
        "archive_symlinks": F.exists(entries, lambda e: e["symlink"]) | unlisted("symlink"),
        "archive_absolute_paths": F.exists(entries, lambda e: e["name"].rlike(r"^([A-Za-z]:|[/\\])")) | unlisted("absolute"), "contains_executables": any_ext(EXECUTABLE), "contains_scripts": any_ext(SCRIPT),
        "contains_installers": any_ext(INSTALLER), "contains_archives": any_ext(NESTED), "disguised_executables": disguised, "ooxml_macros": F.exists(entries, lambda e: e["name"].endswith("vbaProject.bin")),
        "archive_encrypted_entries": F.exists(entries, lambda e: e["encrypted"]),
    }
    own = F.get(F.filter(entries, lambda e: e["name"] == "mimetype"), 0)["head"]
    mimetype = F.btrim(F.decode(own, "iso-8859-1"))
    extensions = F.filter(F.transform(entries, _ext), lambda x: x != "")
    counts = F.transform(F.array_distinct(extensions), lambda x: F.struct((-F.size(F.filter(extensions, lambda y: y == x))).alias("less"), x.alias("ext")))
    subtype = containers.zip_type(F.struct(F.transform(entries, lambda e: e["name"]).alias("names"), mimetype.alias("mimetype")))["ext"]
    return F.struct(
        F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))).alias("flags"), F.size(entries).alias("entry_count"), F.size(F.filter(entries, lambda e: e["encrypted"])).alias("encrypted_count"),
        F.transform(F.slice(F.array_sort(counts), 1, 5), lambda c: F.concat(c["ext"], F.lit(":"), (-c["less"]).cast("string"))).alias("top_extensions"), subtype.alias("subtype"),
    )
