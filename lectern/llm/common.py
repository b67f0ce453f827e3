"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts that split on ASCII white space.
SPACE = "[ \\t-\\r]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    A plain reuse of an expression inside a lambda is evaluated again for every element; a lambda
    variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z. ``lower`` is exact for the words of ASCII letters once the only two other
    letters that it maps into a-z are out of the way; other letters may be folded as well."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("ß")), F.lit("K"), F.lit("ß")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, only where it is
    unset and all runs on one machine (tests), a temporary folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = spark.conf.get("lectern.test.checkpoint.dir", None)
        if not path:
            path = tempfile.mkdtemp(prefix="lectern-")
            spark.conf.set("lectern.test.checkpoint.dir", path)
    return path.rstrip("/")


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again, so that a
    lost executor costs a re-read and never a re-computation. Deleted when the session ends, or by
    ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop, system = _folder(spark, path)
    system.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing is computed from any more; other frames stay."""
    for table in tables:
        if path := getattr(table, "_lectern_path", None):
            hadoop, system = _folder(table.sparkSession, path)
            system.delete(hadoop, True)
