"""Files of a folder by format: suffix dispatch, magic bytes, content hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import markdown, office

TEXT = ("md", "markdown", "txt")
OFFICE = tuple(office.READERS)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, format, sha, mtime, size, status: ok, unsupported (PDFs among them, which no reader here
    turns into blocks) or rejected (wrong magic bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    magic = F.hex(F.substring("content", 1, 4))
    wrong = (suffix.isin(*OFFICE) & (magic != "504B0304")) | ((suffix == "pdf") & (magic != "25504446"))
    known = suffix.isin(*TEXT, *OFFICE)
    status = F.when(wrong, "rejected").when(~known, "unsupported").otherwise("ok")
    return files.select("path", suffix.alias("format"), F.sha2("content", 256).alias("sha"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), status.alias("status"), "content")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    ok = scan(spark, folder).filter("status = 'ok'")
    return markdown.read(ok.filter(F.col("format").isin(*TEXT))).unionByName(office.read(ok.filter(F.col("format").isin(*OFFICE))))


def read(files: DataFrame) -> DataFrame:
    """path, content -> blocks of Markdown, text and office files. A file that no reader takes, or whose reader fails in any way,
    gives one block of kind ``failed`` with the reason, and the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                suffix = path.rsplit(".", 1)[-1].lower()
                try:
                    if suffix in TEXT:
                        found = markdown.blocks(bytes(content).decode("utf-8", "replace"))
                    elif suffix in OFFICE:
                        found = office.parse(suffix, bytes(content))
                    else:
                        raise ValueError(f"no reader for .{suffix}")
                except Exception as e:  # noqa: BLE001 - whatever a broken file raises is its own failure
                    found = [{"kind": "failed", "level_hint": None, "text": f"{type(e).__name__}: {e}", "rows": None}]
                rows = [{"path": path, "idx": i, **b} for i, b in enumerate(found)]
                yield pd.DataFrame(rows, columns=["path", "idx", "kind", "level_hint", "text", "rows"]).astype({"level_hint": "Int32"})

    return files.select("path", "content").mapInPandas(run, markdown.SCHEMA)
