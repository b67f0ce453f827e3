"""Chunk packing: sentences of long paragraphs are packed greedily to a word limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

MAX_WORDS = 260


def greedy_bins(sizes: Column, limit: int) -> Column:
    """The bin of each size: a new one starts where a filled one would exceed the limit. One pass."""
    state = "struct<bin:int,used:int,out:array<int>>"
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(a: Column, n: Column) -> Column:
        full = (a["used"] > 0) & (a["used"] + n > limit)
        at = a["bin"] + full.cast("int")
        return F.struct(at.alias("bin"), F.when(full, n).otherwise(a["used"] + n).alias("used"), F.concat(a["out"], F.array(at)).alias("out")).cast(state)

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def pieces(text) -> Column:
    """Sentences as word arrays; one of more than the limit is cut into whole runs and a rest."""
    sentences = F.transform(T.chunk_sentences(text), lambda s: T.words(s))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / MAX_WORDS).cast("int"))), lambda i: F.slice(w, i * MAX_WORDS + 1, F.lit(MAX_WORDS)))
    return F.flatten(F.transform(F.filter(sentences, lambda w: F.size(w) > 0), cut))


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, words, text: one row per chunk."""
    held = docs.select("doc_id", pieces("text").alias("p"))
    binned = held.select("doc_id", F.arrays_zip(F.col("p"), greedy_bins(F.transform("p", lambda w: F.size(w)), MAX_WORDS).alias("b")).alias("z"))
    rows = binned.select("doc_id", F.posexplode("z").alias("i", "x")).select("doc_id", "i", F.col("x.p").alias("p"), F.col("x.b").alias("b"))
    grouped = rows.groupBy("doc_id", F.col("b").cast("bigint").alias("ordinal")).agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda x: x["p"]))
    return grouped.select("doc_id", "ordinal", F.size(flat).cast("bigint").alias("words"), F.array_join(flat, " ").alias("text"))
