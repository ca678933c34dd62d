"""Rounds of a query that runs until nothing is left: each is written once, so that the next doesn't begin at the start."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the folder of ``spark.checkpoint.dir`` and read again; it goes when the application ends.

    Where that is unset and all runs on one machine, as in tests, a new folder is set.  (A checkpoint would work ``df`` out
    twice, once for its count.)
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/bytelore-round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
