"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset and all runs on one machine, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lectern.test.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("lectern.test.checkpoint.dir", path)
    return path.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """(hadoop path, its file system)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table that is read again: a lost executor costs a re-read. Deleted when the session ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lectern-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop, system = filesystem(spark, path)
    system.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
