"""Web archives: writing, normalising and reading WARC files as Spark jobs.

A monolithic archive is one gzip stream over all of its records, so nothing in it can be read without inflating all that
comes before.  ``normalise`` inflates each such file once, as a stream of bounded pieces, rewrites every record as a gzip
member of its own and notes where each begins: as a sidecar ``.cdxj`` file beside the archive and as rows.  With that index
``read_records`` reads any record alone, so the tasks share even one huge archive.

A task that is lost leaves files under names that no table mentions; the run that replaces it writes under new names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import store

#: Bytes read, inflated or deflated at a time.
PIECE = 1 << 20
#: Bytes of records after which a task begins another archive.
ROLL = 1 << 30
#: Bytes of archive that one task reads back.
SHARE = 64 << 20
#: Longest header of a record; what has a longer one is damage.
LONGEST_HEADER = 1 << 20
#: Salts over which the pages of one payload are spread where they meet their group.
SALTS = 16

FILES = "file string, records long, bytes long"
INDEX = "file string, offset long, length long, record_id string, record_type string, uri string, date string, digest string, refers_to string, whole boolean"
RECORDS = "record_id string, record_type string, uri string, date string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(","))])


def _open(path: str):  # noqa: ANN202
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _fresh(folder: str, kind: str, n: int) -> str:
    """A name that no other task, and no other run of this task, uses."""
    context = TaskContext.get()
    run = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else "0"
    return f"{folder.rstrip('/')}/{kind}-{run}-{n:04d}"


def head(fields: list[tuple[str, str]], version: str = "WARC/1.1") -> bytes:
    """The header block of a record; line ends in a value become spaces."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in fields if v is not None]
    return "\r\n".join([version, *lines, "", ""]).encode()


def parse_head(block: bytes) -> dict[str, str]:
    """Fields of a header block, names in lower case; of a repeated name the first stays, folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower() if colon else None
        if last is not None and last not in out:
            out[last] = value.strip()
    return out


def record(record_id: str, kind: str, uri: str | None, date: str, digest: str, payload: bytes, refers_to: str | None = None) -> tuple[bytes, bytes]:
    """Header and block of one record.  A revisit holds the response's HTTP header, so its payload's length, but no payload."""
    http = head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if kind == "revisit" else http + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
    ]
    return head(fields), block


def write_monolithic(records: DataFrame, folder: str, date: str) -> DataFrame:
    """One row (``FILES``) for each archive written: the records of a task as one gzip stream, a new one after ``ROLL`` bytes.

    ``records`` has ``record_id, record_type, uri, refers_to, digest`` and ``payload`` (binary).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        n, out, packer, name, rows, size = 0, None, None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [rows], "bytes": [size]})

        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if out is None:
                    name = _fresh(root, "monolithic", n) + ".warc.gz"
                    out, packer, rows, size, n = system.open_output_stream(name, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0, n + 1
                for part in (*record(row["record_id"], row["record_type"], row["uri"], date, row["digest"], row["payload"] or b"", row["refers_to"]), b"\r\n\r\n"):
                    out.write(packer.compress(part))
                    size += len(part)
                rows += 1
                if size >= ROLL:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.mapInArrow(write, FILES)


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a file in pieces of at most ``PIECE``: of gzip members one after another, or as they are.

    A stream that breaks off gives what could be inflated; zeros after a member are padding.
    """
    raw = read(PIECE)
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = read(PIECE)
        return
    packed, member = raw, zlib.decompressobj(31)
    try:
        while packed:
            piece = member.decompress(packed, PIECE)
            if piece:
                yield piece
            if member.eof:
                packed = member.unused_data.lstrip(b"\0") or read(PIECE).lstrip(b"\0")
                member = zlib.decompressobj(31)
            else:
                packed = member.unconsumed_tail or read(PIECE)
        rest = member.flush()
        if rest:
            yield rest
    except zlib.error:
        return


class _Bytes:
    """Look-ahead over pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.ended = pieces, bytearray(), False

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes could be held."""
        while len(self.held) < n and not self.ended:
            piece = next(self.pieces, None)
            self.ended = piece is None
            self.held += piece or b""
        return len(self.held) >= n

    def find(self, mark: bytes, limit: int) -> int:
        """Where ``mark`` begins within the next ``limit`` bytes; -1 if it doesn't."""
        done = 0
        while (at := self.held.find(mark, done, limit)) < 0 and len(self.held) < limit and not self.ended:
            done = max(0, len(self.held) - len(mark) + 1)
            self.fill(len(self.held) + 1)
        return at

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces, fewer where the file ends."""
        while n and self.fill(1):
            piece = bytes(self.held[: min(n, PIECE)])
            del self.held[: len(piece)]
            n -= len(piece)
            yield piece


def records_of(read: Callable[[int], bytes]) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """Header, its fields and the pieces of the block of each record of an archive, in order.

    The pieces must be taken before the next record is.  Bytes that don't begin a record with a length, blank lines between
    records among them, are passed over up to the next line that begins with ``WARC/``.  A last record that breaks off comes
    with what there is of its block.
    """
    data, mark = _Bytes(inflate(read)), b"WARC/"
    while data.fill(len(mark)):
        end = data.find(b"\r\n\r\n", LONGEST_HEADER) if data.held.startswith(mark) else -1
        about = parse_head(bytes(data.held[:end])) if end >= 0 else {}
        if not about.get("content-length", "").isdecimal():
            at = data.find(b"\n" + mark, PIECE)
            # the end of what was looked at may begin the mark
            for _ in data.take(at + 1 if at >= 0 else min(PIECE, len(data.held)) - len(mark)):
                pass
            if at < 0 and data.ended and len(data.held) <= len(mark):
                return
            continue
        header = b"".join(data.take(end + 4))
        block = data.take(int(about["content-length"]))
        yield header, about, block
        for _ in block:
            pass


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """One row (``INDEX``) for each record of the archives named by ``files.file``, each now a gzip member of its own.

    Each archive is inflated once, by one task, in bounded pieces; beside the new file lies its index, ``.cdxj``, a JSON
    object a line.  Records keep their headers and blocks byte for byte; a block that breaks off, as its archive does, is kept as
    far as it goes and not ``whole``.  An archive without a record gives no file and no row.
    """
    schema = _schema(INDEX)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path in batch.column("file").to_pylist():
                system, source = _open(path)
                target, root = _open(folder)
                name = _fresh(root, "normal", n) + ".warc.gz"
                n += 1
                rows: list[dict] = []
                out = side = None
                offset = 0
                with system.open_input_stream(source, compression=None) as stream:
                    for header, about, block in records_of(stream.read):
                        if out is None:
                            out, side = target.open_output_stream(name, compression=None), target.open_output_stream(f"{name}.cdxj", compression=None)
                        size, seen = _member(out, header, block)
                        row = {
                            "file": name, "offset": offset, "length": size, "record_id": _bare(about.get("warc-record-id")), "record_type": about.get("warc-type"),
                            "uri": about.get("warc-target-uri"), "date": about.get("warc-date"), "digest": about.get("warc-payload-digest"), "refers_to": _bare(about.get("warc-refers-to")), "whole": seen == int(about["content-length"]),
                        }
                        side.write((json.dumps(row) + "\n").encode())
                        offset += size
                        rows.append(row)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if out is not None:
                    out.close()
                    side.close()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(rewrite, INDEX)


def _member(out, header: bytes, block: Iterator[bytes]) -> tuple[int, int]:  # noqa: ANN001
    """Writes a record as one member; its length in the file and that of its block."""
    packer, size, seen = zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
    for part in itertools.chain([header], block, [b"\r\n\r\n"]):
        packed = packer.compress(part)
        out.write(packed)
        size, seen = size + len(packed), seen + len(part)
    packed = packer.flush()
    out.write(packed)
    return size + len(packed), seen - len(header) - 4


def read_record(packed: bytes) -> dict:
    """What a record's member says: its fields, and length and SHA-1 of its full payload.

    A response's are worked out from its payload, a revisit's are those that it states.  ``intact`` is whether a stated
    digest is that of the payload; null where there is nothing to compare.
    """
    data = b"".join(inflate(_reader(packed)))
    end = data.find(b"\r\n\r\n") + 4
    about = parse_head(data[:end])
    block = data[end : end + int(about.get("content-length") or 0)]
    stated = about.get("warc-payload-digest") or ""
    digest = base64.b32decode(stated[5:]).hex() if stated.startswith("sha1:") and len(stated) == 37 else None
    at = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    out = {"record_id": _bare(about.get("warc-record-id")), "record_type": about.get("warc-type"), "uri": about.get("warc-target-uri"), "date": about.get("warc-date"), "refers_to": _bare(about.get("warc-refers-to"))}
    if out["record_type"] == "revisit":
        length = parse_head(block[:at]).get("content-length", "")
        return out | {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": digest, "intact": None}
    found = hashlib.sha1(memoryview(block)[at:]).hexdigest()
    return out | {"payload_bytes": len(block) - at, "payload_digest": found, "intact": found == digest if digest else None}


def _reader(data: bytes) -> Callable[[int], bytes]:
    at = 0

    def read(n: int) -> bytes:
        nonlocal at
        at += n
        return data[at - n : at]

    return read


def read_records(index: DataFrame) -> DataFrame:
    """One row (``RECORDS``) for each row of ``index``, each read from its archive alone, by its offset and length."""
    schema = _schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = stream = None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != path:
                    if stream is not None:
                        stream.close()
                    system, where = _open(file)
                    path, stream = file, system.open_input_file(where)
                rows.append(read_record(stream.read_at(length, offset)))
            yield pa.RecordBatch.from_pylist(rows, schema)
        if stream is not None:
            stream.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    shares = index.select("file", "offset", "length").repartitionByRange(total // SHARE + 1, "file", "offset").sortWithinPartitions("file", "offset")
    return shares.mapInArrow(read, RECORDS)


def _urn(page: str) -> F.Column:
    """The id of a page's record; it holds the page's key."""
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")))


def page_records(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html", least_bytes: int = 1000) -> DataFrame:
    """The records of pages, as ``write_monolithic`` takes them.

    Of pages with equal bodies of at least ``least_bytes`` bytes of UTF-8 that with the largest key is the response, the
    others are revisits of it; shorter ones are responses.  A null body is empty.  Rows that share the largest key are all
    responses; a null key is less than any other, and where all are null all are responses.  A null URI is left out; an
    empty table gives no record; other columns are ignored.
    """
    text = F.coalesce(pages[body].cast("string"), F.lit(""))
    rows = pages.select(pages[key].cast("long").alias("page"), pages[uri].cast("string").alias("uri"), text.alias("body")).select(
        "page", "uri", "body", F.sha1("body").alias("digest"), F.xxhash64("body").alias("check"), F.octet_length("body").alias("bytes")
    )
    same = ["digest", "check"]
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy(*same).agg(F.max("page").alias("to"), F.count("*").alias("c")).where("c > 1 and to is not null")
    spread = groups.select(*same, "to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page", "uri"), F.lit(SALTS)).cast("int")
    marked = rows.withColumn("salt", salt).join(store(spread, "payloads"), [*same, "salt"], "left")
    revisit = F.col("to").isNotNull() & ~F.col("page").eqNullSafe(F.col("to"))
    return marked.select(
        _urn("page").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "uri",
        F.when(revisit, _urn("to")).alias("refers_to"), "digest", F.encode("body", "utf-8").alias("payload"),
    )


def archive_and_read(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Pages written as monolithic archives under ``folder``, normalised there and read back by the index, as ``RECORDS``."""
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    files = store(write_monolithic(page_records(pages, **columns), folder, date), "archives")
    index = store(normalise(files, folder), "index")
    return read_records(index)
