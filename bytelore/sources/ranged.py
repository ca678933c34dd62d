"""Files as rows of asked-for ranges: a data source that opens each file once and reads only what a query's columns need.

``binaryFile`` loads whole files and ends at 2 GB.  Here a column is a range of bytes (``head``, ``tail``, ``volume`` or any
named in the ``ranges`` option), or what the directory of a ZIP or OLE file names (``inside``), which is found by following
that directory.  The columns of the schema are all that is read; with metadata alone no file is opened.

Planning lists folders and deals files to tasks by what will be read of them; folders deeper than ``planDepth`` are listed
by the task that reads them.  A file or folder that can't be read, or vanishes, is a row with its ``error``.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith
from pyspark.sql.types import StructType

from ..functions import containers

META = {"id": "string", "path": "string", "name": "string", "declared_ext": "string", "length": "long", "modified": "timestamp", "error": "string"}
RANGES = {"head": (0, 4096), "volume": (containers.VOLUME_AT, containers.VOLUME_BYTES), "tail": (-containers.TAIL_BYTES, containers.TAIL_BYTES)}
#: What opening a file costs, as bytes, and the cost and the files of a task.
OPEN_COST, TASK_COST, TASK_FILES = 1 << 20, 256 << 20, 10_000
#: Rows and bytes of a batch.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


def _system(path: str):  # noqa: ANN202
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Files(InputPartition):
    def __init__(self, files: list[dict], folders: list[str]) -> None:
        super().__init__(0)
        self.files, self.folders = files, folders


def _facts(path: str, size: int | None, modified_ns: int | None, error: str | None = None) -> dict:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    ext = name[dot + 1 :].lower() if dot >= 0 and dot + 1 < len(name) else None
    at = None if modified_ns is None else datetime.datetime.fromtimestamp(modified_ns / 1e9, datetime.UTC)
    return {"id": path, "path": path, "name": name, "declared_ext": ext, "length": size, "modified": at, "modified_ns": modified_ns or 0, "error": error}


class _Source:
    """What reader and stream reader share: options, listing, reading."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.roots = schema, json.loads(options["paths"]) if "paths" in options else [options["path"]]
        asked = {k: tuple(v) for k, v in json.loads(options.get("ranges", "{}")).items()}
        self.ranges = {k: v for k, v in {**RANGES, **asked}.items() if k in schema.names}
        unknown = set(schema.names) - set(META) - set(self.ranges) - {"inside"}
        if unknown:
            raise ValueError(f"no range is given for {sorted(unknown)}")
        self.glob, self.depth, self.recursive = options.get("glob"), int(options.get("plandepth", 8)), options.get("recursive", "true") == "true"
        self.filters: list[tuple[str, str, object]] = []

    def wanted(self, f: dict) -> bool:
        """Whether a file passes the glob and the filters that were pushed down."""
        if self.glob and not fnmatchcase(f["name"], self.glob):
            return False
        tests = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b, "ends": lambda a, b: a.endswith(b)}
        return all(f[c] is not None and tests[op](f[c], v) for c, op, v in self.filters)

    def walk(self, root: str, depth: int | None) -> Iterator[dict | str]:
        """Files below a folder, and the folders that lie ``depth`` levels down; None: all levels."""
        from pyarrow import fs

        system, start = _system(root)
        stack = [(start, 0)]
        first = system.get_file_info(start)
        if first.type == fs.FileType.File:
            yield _facts(start, first.size, first.mtime_ns)
            return
        while stack:
            folder, level = stack.pop()
            try:
                found = system.get_file_info(fs.FileSelector(folder))
            except (OSError, pa.ArrowException) as e:
                yield _facts(folder, None, None, f"{type(e).__name__}: {e}")
                continue
            for info in sorted(found, key=lambda i: i.path):
                if info.type == fs.FileType.Directory:
                    if not self.recursive:
                        continue
                    if depth is not None and level + 1 >= depth:
                        yield info.path
                    else:
                        stack.append((info.path, level + 1))
                elif info.type == fs.FileType.File:
                    yield _facts(info.path, info.size, info.mtime_ns)
                else:
                    yield _facts(info.path, None, None, "FileNotFoundError: neither a file nor a folder")

    def deal(self, found: Iterator[dict | str]) -> list[_Files]:
        cost_of = OPEN_COST * bool(self.ranges or "inside" in self.schema.names) + sum(n for _, n in self.ranges.values())
        out, files, cost = [], [], 0
        for f in found:
            if isinstance(f, str):
                out.append(_Files([], [f]))
                continue
            if f["error"] is None and not self.wanted(f):
                continue
            files.append(f)
            cost += cost_of
            if cost >= TASK_COST or len(files) >= TASK_FILES:
                out.append(_Files(files, []))
                files, cost = [], 0
        return [*out, _Files(files, [])] if files else out

    def row(self, system, f: dict) -> dict:  # noqa: ANN001
        row = {c: f.get(c) for c in self.schema.names}
        if f["error"] is not None or not (self.ranges or "inside" in row):
            return row
        try:
            with system.open_input_file(f["path"]) as stream:
                size = stream.size()
                at = lambda offset, n: stream.read_at(max(0, min(n, size - offset)), offset) if 0 <= offset < size else b""
                for c, (offset, n) in self.ranges.items():
                    row[c] = at(max(0, size + offset) if offset < 0 else offset, n)
                if "inside" in row:
                    row["inside"] = containers.look_inside(at, size)
        except (OSError, pa.ArrowException) as e:
            row = {c: f.get(c) for c in self.schema.names}
            if "error" in row:
                row["error"] = f"{type(e).__name__}: {e}"
        return row

    def rows(self, part: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        system, _ = _system(self.roots[0])
        batch, size = [], 0

        def all_files() -> Iterator[dict]:
            yield from part.files
            for folder in part.folders:
                yield from (f for f in self.walk(folder, None) if f["error"] is not None or self.wanted(f))

        for f in all_files():
            row = self.row(system, f)
            batch.append(row)
            size += sum(len(row[c] or b"") for c in self.ranges)
            if len(batch) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(batch, schema)
                batch, size = [], 0
        if batch:
            yield pa.RecordBatch.from_pylist(batch, schema)


class _Reader(DataSourceReader):
    def __init__(self, source: _Source) -> None:
        self.source = source

    def partitions(self) -> list[_Files]:
        return self.source.deal(f for root in self.source.roots for f in self.source.walk(root, self.source.depth))

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return self.source.rows(partition)


class _PruningReader(_Reader):
    """Leaves files out by name, length and time before any task opens them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", StringEndsWith: "ends"}
        for f in filters:
            op = kinds.get(type(f))
            if op and len(f.attribute) == 1 and f.attribute[0] in ("name", "path", "declared_ext", "length"):
                self.source.filters.append((f.attribute[0], op, f.value))
            yield f  # Spark looks again: files that can't be read pass by here


class _Stream(DataSourceStreamReader):
    """New files by time of change and path: a file counts once it is changed after the last one read, so files must appear in that order."""

    def __init__(self, source: _Source) -> None:
        self.source = source

    def _all(self) -> Iterator[dict]:
        return (f for root in self.source.roots for f in self.source.walk(root, None) if f["error"] is None and self.source.wanted(f))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        modified, path = max(((f["modified_ns"], f["path"]) for f in self._all()), default=(0, ""))
        return {"modified": modified, "path": path}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        return self.source.deal(f for f in self._all() if low < (f["modified_ns"], f["path"]) <= high)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return self.source.rows(partition)


class RangedFiles(DataSource):
    """Options: ``path`` or ``paths`` (JSON list), ``ranges`` (JSON: column to [offset, bytes], from the end where negative),
    ``glob`` of names, ``recursive``, ``planDepth``, ``prune`` (filters reach the listing; needs ``PUSH_DOWN``)."""

    @classmethod
    def name(cls) -> str:
        return "ranged_files"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in META.items()) + ", head binary, tail binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _PruningReader if self.options.get("prune") == "true" else _Reader
        return kind(_Source(schema, dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(_Source(schema, dict(self.options)))


def _schema(columns: list[str], ranges: dict[str, tuple[int, int]]) -> str:
    kinds = META | dict.fromkeys({**RANGES, **ranges}, "binary") | {"inside": containers.INSIDE.simpleString()}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def files(spark: SparkSession, *paths: str, columns: list[str] | None = None, ranges: dict[str, tuple[int, int]] | None = None, stream: bool = False, **options: str) -> DataFrame:
    """Files and the asked-for ``columns`` of them: metadata, ``head``, ``volume``, ``tail``, ``inside``, and ``ranges``.

    Without ``columns``: all that ``detect`` needs.  ``stream``: a stream of new files.
    """
    asked = ranges or {}
    chosen = columns or [*META, *RANGES, "inside", *asked]
    spark.dataSource.register(RangedFiles)
    prune = "true" if spark.conf.get(PUSH_DOWN, "false") == "true" and not stream else "false"
    reader = (spark.readStream if stream else spark.read).format("ranged_files").schema(_schema(chosen, asked)).option("paths", json.dumps(paths)).option("prune", prune)
    return reader.options(ranges=json.dumps(asked), **options).load()
