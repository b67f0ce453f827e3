"""The relational store: children follow their documents, listings have a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table (documents, sections, chunks, links, reviews) without the documents of ``gone``."""
    out = {}
    for name, df in tables.items():
        keys = ("src_doc", "dst_doc") if name == "links" else ("doc_id",)
        for key in keys:
            df = df.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
        out[name] = df
    return out


def first_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("section_id").agg(F.min("chunk_id").alias("chunk_id"))


def heads(chunks: DataFrame, k: int = 2) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    return chunks.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def section_texts(chunks: DataFrame) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "text")))
    return chunks.groupBy("section_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("full"))


def cards(chunks: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with the titles of their documents and the paths of their sections."""
    return chunks.join(documents.select("doc_id", "title"), "doc_id").join(sections.select("section_id", "path"), "section_id")


def relocated(documents: DataFrame, moves: DataFrame) -> DataFrame:
    """documents with new paths from moves(doc_id, to)."""
    return documents.join(moves, "doc_id", "left").withColumn("path", F.coalesce("to", "path")).drop("to")
