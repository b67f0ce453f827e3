"""Shortlists of documents and sections, figures beside captions, excerpts, spans to mask, retry memo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Sizes of the lists.
FEW, CARDS, CHUNKS, SECTIONS, FIGURES = 8, 5, 40, 10, 3
MASKABLE, LEAST_SCORE = "EMAIL TELEPHONENUM IBAN CREDITCARDNUMBER IP".split(), 0.5


def first_by(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, ranked from 1."""
    placed = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.filter(F.col(rank) <= n)


def shortlist(searchable: DataFrame, cards: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, doc_id to search in: all where there are fewer than FEW documents, else those of the best CARDS card scores and of
    the best CHUNKS chunk hits. searchable: doc_id; cards: qid, doc_id, score; hits: qid, doc_id, rank (null: no hit)."""
    able = searchable.select(F.col("doc_id").alias("able"))  # ids may be repeated or null
    within = lambda df: df.join(able, F.col("doc_id").eqNullSafe(F.col("able")), "left_semi")
    top = first_by(within(cards), ["qid"], [F.desc("score"), F.asc_nulls_last("doc_id")], CARDS).select("qid", "doc_id")
    found = within(hits.filter(F.col("rank") <= CHUNKS)).select("qid", "doc_id")
    narrow = top.unionByName(found).distinct()
    few = F.broadcast(searchable.agg((F.count(F.lit(1)) < FEW).alias("few")))  # one row
    everything = searchable.join(few).filter("few").select("doc_id")  # fewer than FEW rows, or none
    asked = cards.select("qid").unionByName(hits.select("qid")).distinct()
    return narrow.join(few).filter("NOT few").drop("few").unionByName(asked.join(F.broadcast(everything)))


def section_chunks_ranked(scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, chunk_id, rank: the chunks of the best SECTIONS sections, in the order of their sections. scores: qid, section_id, score;
    chunks: chunk_id, section_id."""
    best = first_by(scores, ["qid"], [F.desc("score"), "section_id"], SECTIONS, "place")
    order = Window.partitionBy("qid").orderBy("place", "chunk_id")
    return best.join(chunks, "section_id").select("qid", "chunk_id", F.row_number().over(order).cast("bigint").alias("rank"))


def figures(chunks: DataFrame) -> DataFrame:
    """section_id, ref: the first FIGURES different figures of a section, in the order of its chunks."""
    once = chunks.filter("ref IS NOT NULL AND ref <> ''").groupBy("section_id", "ref").agg(F.min("chunk_id").alias("chunk_id"))
    return first_by(once, ["section_id"], ["chunk_id"], FIGURES).select("section_id", "ref", "rank")


def beside_caption(captions: DataFrame, images: DataFrame) -> DataFrame:
    """Caption chunks with the image chunks at the same place of their document: chunk_id, image_id. Both: chunk_id, doc_id, loc."""
    there = images.filter("loc <> ''").select(F.col("chunk_id").alias("image_id"), "doc_id", "loc")
    return captions.join(there, ["doc_id", "loc"]).filter("chunk_id <> image_id").select("chunk_id", "image_id")


def excerpt(passage, claim, around: int = 2, most: int = 1400) -> Column:
    """The sentence of a passage that covers a claim best, with its neighbours."""
    sentences, wanted = T.claim_sentences(passage), T.content_terms(claim)
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(wanted, T.content_terms(s))).alias("n"), (-i).alias("at")))
    best = -F.array_max(scored)["at"]
    first = F.greatest(best - around, F.lit(0))
    return F.left(F.array_join(F.slice(sentences, first + 1, best + around - first + 1), " "), F.lit(most))


def spans_to_mask(spans: DataFrame) -> DataFrame:
    """doc_id, label, start, end: spans with a label that may be masked and a sufficient score, by start (the longer first); what
    overlaps a span before it is dropped."""
    able = spans.filter(F.col("label").isin(*MASKABLE) & (F.col("score") >= LEAST_SCORE))
    listed = able.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", (-F.col("end")).alias("e"), "label"))).alias("s"))
    state = "struct<until:bigint,out:array<struct<label:string,start:bigint,end:bigint>>>"
    start = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<label:string,start:bigint,end:bigint>>").alias("out")).cast(state)

    def step(a: Column, x: Column) -> Column:
        mine = F.struct(x["label"].alias("label"), x["start"].cast("bigint").alias("start"), (-x["e"]).cast("bigint").alias("end"))
        return F.when(x["start"] < a["until"], a).otherwise(F.struct((-x["e"]).cast("bigint").alias("until"), F.concat(a["out"], F.array(mine)).alias("out")).cast(state))

    return listed.select("doc_id", F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("x")).select("doc_id", "x.*")


def to_try(listing: DataFrame, failed: DataFrame) -> DataFrame:
    """Files that have not failed before as they are: path, mtime and size together."""
    return listing.join(failed.select("path", "mtime", "size").distinct(), ["path", "mtime", "size"], "left_anti")
