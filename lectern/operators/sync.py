"""Incremental synchronisation of an inbox as joins of the known state with a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actions(known: DataFrame, listing: DataFrame, index_sig: str) -> DataFrame:
    """known(path, sha, mtime, size, index_sig), listing(path, sha, mtime, size, settled) ->
    path, action: updated, rebuilt, renamed, duplicate, added or removed; unchanged paths have no row."""
    k = known.select("path", F.col("sha").alias("k_sha"), F.col("mtime").alias("k_mtime"), F.col("size").alias("k_size"), "index_sig")
    both = k.join(listing, "path", "full_outer")
    changed = (F.col("mtime") != F.col("k_mtime")) | (F.col("size") != F.col("k_size"))
    here = both.filter("k_sha IS NOT NULL AND sha IS NOT NULL").select(
        "path", F.when(changed & F.col("settled"), F.lit("updated")).when(F.col("index_sig") != index_sig, F.lit("rebuilt")).alias("action")
    )
    gone = both.filter("sha IS NULL").select(F.col("path").alias("old"), F.col("k_sha").alias("sha"))
    new = both.filter("k_sha IS NULL AND settled").select("path", "sha")
    # One new path takes over a vanished document's bytes: the first by name.
    first = new.groupBy("sha").agg(F.min("path").alias("path"))
    moved = first.join(gone.groupBy("sha").agg(F.min("old").alias("old")), "sha")
    held = k.select(F.col("k_sha").alias("sha")).distinct().withColumn("held", F.lit(True))
    fresh = new.join(moved.select("path", F.lit(True).alias("moved")), "path", "left").join(held, "sha", "left").join(first.withColumnRenamed("path", "head"), "sha")
    arrived = fresh.select("path", F.when(F.col("moved"), F.lit("renamed")).when(F.col("held") | (F.col("path") != F.col("head")), F.lit("duplicate")).otherwise(F.lit("added")).alias("action"))
    removed = gone.join(moved.select("old"), "old", "left_anti").select(F.col("old").alias("path"), F.lit("removed").alias("action"))
    return here.filter("action IS NOT NULL").unionByName(arrived).unionByName(removed)


def reusable_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """new rows with the old vector of an equal text, or null: only those go to the embedder."""
    held = old.select(F.sha2("text", 256).alias("h"), "vector").groupBy("h").agg(F.first("vector", True).alias("vector"))
    return new.withColumn("h", F.sha2("text", 256)).join(held, "h", "left").drop("h")
