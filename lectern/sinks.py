"""Where results go: document tables, decisions, events and run logs. Batches are idempotent by their key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(tables: dict[str, DataFrame], root: str, batch: str) -> None:
    """One folder a table (documents, sections, chunks, links ..) and batch; writing a batch again replaces it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def read_documents(spark, root: str, name: str) -> DataFrame:
    """All batches; of a document written twice the rows of the last batch count."""
    rows = spark.read.parquet(f"{root}/{name}")
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it has not: profiles, overrides, settings."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append_events(events: DataFrame, path: str, batch: str) -> None:
    """JSON lines, one object a row; writing a batch again replaces it."""
    events.write.mode("overwrite").json(f"{path}/batch={batch}")


def write_report(rows: DataFrame, path: str) -> None:
    """A small table of results as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
