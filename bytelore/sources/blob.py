"""Inputs as rows: files of a directory, or any binary or text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import normalise_extension

HEAD_BYTES = 4096
#: Bytes of a batch that a Python step is given; by rows alone (10,000) batches grow with the contents.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Have the session's Python steps get batches of ``BATCH_BYTES`` (or one row), unless the session has a limit of its own."""
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("head", F.substring("content", 1, HEAD_BYTES))


def files(spark: SparkSession, *paths: str, glob: str | None = None, recursive: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Files as ``id, path, name, declared_ext, length, modified, content, head``.

    Unreadable and vanishing files are skipped.  Over ``max_bytes``, a file is left out before its content is read.
    """
    bound_batches(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(list(paths))
    if max_bytes is not None:
        found = found.where(F.col("length") <= max_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return _finish(found.select(F.col("path").alias("id"), "path", name.alias("name"), extension_of(name).alias("declared_ext"), "length", F.col("modificationTime").alias("modified"), "content"))


def extension_of(name: Column) -> Column:
    return normalise_extension(F.regexp_extract(name, r"\.([^.]+)$", 1))


def column(df: DataFrame, id: str, content: str, declared_ext: Column | None = None) -> DataFrame:  # noqa: A002
    """A binary or text column in the same shape; text is taken as UTF-8."""
    bound_batches(df.sparkSession)
    body = F.col(content) if df.schema[content].dataType.simpleString() == "binary" else F.encode(F.col(content), "utf-8")
    ext = declared_ext if declared_ext is not None else F.lit(None).cast("string")
    return _finish(
        df.select(F.col(id).cast("string").alias("id"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("name"), ext.alias("declared_ext"), F.octet_length(body).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"), body.alias("content"))
    )
