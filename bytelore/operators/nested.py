"""What contents hold: archives' entries, compressed streams and encoded texts, opened round by round.

Each round is a DataFrame: the rows whose type is a container or an encoding are opened, what was inside becomes the next
round's rows with their types, until nothing is left to open.  A budget of bytes goes with each row and is shared among what
is inside, so all that a row holds, however often it is packed, stays below the budget that it came with.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payloads, zipdir
from ..plans.rounds import cut
from ..sources.blob import HEAD_BYTES, extension_of
from .archives import tar_members
from .detect import detect

# Types that hold a directory of entries in ZIP form.
ZIP_TYPES = ["zip", "docx", "xlsx", "pptx", "apk", "jar", "ipa", "msix", "appx", "epub", "odt", "ods", "odp", "odg", "kmz", "vsix", "xap", "nupkg"]
OPENED = "id string, path string, depth int, via string, name string, length long, whole boolean, budget long, content binary"
# How findings tell of an encoding.
FOUND = {"b64": "enc:b64", "hex": "enc:hex", "b85": "enc:b85", "uu": "enc:uu", "qp": "enc:qp"}


@dataclass(frozen=True)
class Limits:
    """Entries and bytes that are taken: of an archive, of an entry, of a decoded text, of all that one row holds, and how deep."""

    entries: int = 64
    entry_bytes: int = 262_144
    decoded_bytes: int = 131_072
    total_bytes: int = 32 << 20
    depth: int = 8


def _gunzip(data: bytes, limit: int) -> bytes | None:
    try:
        return zlib.decompressobj(31).decompress(data, limit)
    except zlib.error:
        return None


def _inner(kind: str, content: bytes, name: str | None, limits: Limits) -> Iterator[tuple[str, int, bytes]]:
    """Name, full length and the first bytes of what a container holds."""
    if kind in ZIP_TYPES:
        read = zipdir.reader(content)
        for e in islice(zipdir.entries(read, len(content)) or [], limits.entries):
            first = zipdir.body(read, e, limits.entry_bytes)
            if first is not None and not e.name.endswith("/"):
                yield e.name, e.size, first
    elif kind == "tar":
        for name_, size, first in islice(tar_members(content, limits.entry_bytes), limits.entries):
            yield name_, size, first
    elif kind == "gz":
        first = _gunzip(content, limits.total_bytes)
        if first is not None:
            bare = (name or "content.gz").rsplit("/", 1)[-1]
            yield bare[:-3] if bare.lower().endswith(".gz") else bare, len(first), first


def _open(rows: DataFrame, limits: Limits) -> DataFrame:
    """What the containers among typed rows hold; ``path`` leads there, parts apart by ``!``."""
    schema = pa.schema([("id", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("via", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("whole", pa.bool_()), ("budget", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                left, out = row["budget"], []
                for name, size, first in _inner(row["extension"], row["content"], row["name"], limits):
                    kept = first[: max(0, left)]
                    left -= len(kept)
                    out.append({"id": row["id"], "path": f"{row['path']}!{name}", "depth": row["depth"] + 1, "via": row["extension"], "name": name, "length": size, "whole": len(kept) == size, "content": kept})
                for o in out:
                    o["budget"] = max(0, left) // len(out)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, OPENED)


def _decode(rows: DataFrame, limits: Limits) -> DataFrame:
    """What encoded texts among typed rows stand for; a decoded gzip stream is inflated in the same step."""
    text = F.decode(F.substring("content", 1, 4 * limits.decoded_bytes), "iso-8859-1")
    raw = rows.select("id", "path", "depth", "extension", "budget", F.substring(payloads.payload(text, F.col("extension")), 1, limits.decoded_bytes).alias("raw")).where("octet_length(raw) > 0")

    at = raw.columns.index("raw")

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x if x[:2] != b"\x1f\x8b" else (_gunzip(x, limits.decoded_bytes) or x) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, "raw", pa.array(found, pa.binary()))

    schema = ", ".join(f"{n} {t}" for n, t in raw.dtypes)
    size = F.octet_length("raw").cast("long")
    kept = F.least(size, F.col("budget"))
    return raw.mapInArrow(inflate, schema).select(
        "id", F.concat("path", F.lit("!"), "extension").alias("path"), (F.col("depth") + 1).alias("depth"), F.col("extension").alias("via"), F.lit(None).cast("string").alias("name"), size.alias("length"),
        (kept == size).alias("whole"), (F.col("budget") - kept).alias("budget"), F.expr("substring(raw, 1, cast(least(octet_length(raw), budget) as int))").alias("content"),
    )


def unwrap(blobs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``blobs`` (of ``sources.blob``) and all that they hold, with types: ``id`` of the outermost, ``path`` from there (parts
    apart by ``!``), ``depth`` (0: the rows themselves), ``via`` (the type that held it), ``name``, ``length``, ``whole``
    (whether ``content`` is all of it), ``content``, ``head``, ``declared_ext``, and the columns of ``detect``.

    Null, empty and broken contents hold nothing; encrypted entries, and those packed otherwise than by deflate, are not
    opened; an empty table gives no rows.  Rows that repeat an id stay apart by nothing but their contents.
    """
    begun = blobs.select(
        F.col("id").cast("string").alias("id"), F.coalesce("name", F.lit("")).alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), "name", "length",
        F.lit(True).alias("whole"), F.lit(limits.total_bytes).cast("long").alias("budget"), "content", "declared_ext",
    )
    typed = lambda df: detect(df.withColumn("head", F.substring("content", 1, HEAD_BYTES)))
    level = cut(typed(begun))
    levels = [level]
    for _ in range(limits.depth):
        able = level.where(F.col("budget") > 0)
        opened = _open(able.where(F.col("extension").isin([*ZIP_TYPES, "tar", "gz"])).select("id", "path", "depth", "name", "budget", "extension", "content"), limits)
        decoded = _decode(able.where(F.col("extension").isin([*payloads.ENCODED])), limits)
        inside = opened.unionByName(decoded).withColumn("declared_ext", extension_of(F.col("name")))
        level = cut(typed(inside))
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out.drop("budget")


def nested_findings(opened: DataFrame) -> DataFrame:
    """``id`` and ``findings``, sorted: of the rows of ``unwrap``, encodings (``enc:b64``), what was in them (``enc:det:exe``,
    ``enc:det:`` where that has no type), and types found in containers (``nested:exe``).  Ids without any have no row."""
    encoded = F.col("via").isin([*FOUND])
    code = F.coalesce(*(F.when(F.col("via") == k, F.lit(v)) for k, v in FOUND.items()))
    ext = F.coalesce("extension", F.lit(""))
    several = F.when(encoded, F.array(code, F.concat(F.lit("enc:det:"), ext))).when(ext != "", F.array(F.concat(F.lit("nested:"), ext)))
    return opened.where("depth > 0").select("id", F.explode(several).alias("finding")).groupBy("id").agg(F.sort_array(F.collect_set("finding")).alias("findings"))
