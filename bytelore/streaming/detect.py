"""The same projections over streams; they keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect
from ..sources.blob import HEAD_BYTES, extension_of

_FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files below ``path`` in the shape of ``sources.blob``."""
    found = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.col("path").alias("id"), "path", name.alias("name"), extension_of(name).alias("declared_ext"), "length", F.col("modificationTime").alias("modified"), "content").withColumn("head", F.substring("content", 1, HEAD_BYTES))


def detect_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Types of the files that are there, appended to a Parquet table; run again, it takes only new ones."""
    typed = detect(file_stream(spark, path)).drop("content", "head")
    return typed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
