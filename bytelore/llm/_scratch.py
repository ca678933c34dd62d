"""Tables that cut lineage, written to the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset and all runs on one machine, as in tests, a new folder is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            where = set_already.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again; the files go when the application ends.

    What was shuffled for it isn't needed again.  Spark deletes such files when the driver collects its garbage, which is
    asked for here, as a driver with much memory would keep them all to the end of a long query.
    """
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/bytelore-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _path(spark, path)
    system.deleteOnExit(where)
    spark._jvm.System.gc()
    read = spark.read.schema(df.schema).parquet(path)
    read._stored_at = path
    return read


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``store`` that no later step reads."""
    for df in tables:
        where, system = _path(df.sparkSession, df._stored_at)
        system.delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of files in the shared folder, which goes when the application ends."""
    path = f"{folder(spark).rstrip('/')}/bytelore-{name}-{uuid.uuid4().hex}"
    where, system = _path(spark, path)
    system.deleteOnExit(where)
    return path
