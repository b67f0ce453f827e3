"""Phrases over positional postings: which texts hold the tokens of a phrase one after the other.

``index`` is the inverted index: (doc_id, dl, term, at) of words and of pairs of neighbouring words, ``at`` the sorted
positions of the term, ``dl`` the text's number of tokens. Phrases are answered from it alone; no text is read or searched again. Of a phrase's
terms the rarest gives the candidates, shifted to where the phrase would start; every other term is looked up
by (doc_id, term), which is unique, so a frequent word is no hot key, and the shifted positions are
intersected.

Defined results: null or empty texts hold no token; a phrase without tokens matches nothing; a term may stand
in a phrase several times; repeated phrases of a question count once; equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.retrieval import B, K1, pieces, runs, small, top, wanted_terms
from lectern.shared import written

CLAUSE = "[.,;:!?\\n]+"


def neighbours(lists: pa.ListArray) -> pa.ListArray:
    """The pairs of tokens that follow each other, joined by a blank."""
    flat, size = lists.flatten(), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    last = np.zeros(len(flat), bool)
    last[np.cumsum(size)[size > 0] - 1] = True
    first = np.flatnonzero(~last)
    pairs = pc.binary_join_element_wise(flat.take(pa.array(first)), flat.take(pa.array(first + 1)), " ")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))]).astype(np.int32)), pairs)


def index(docs: DataFrame, terms: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """docs(doc_id, text), one row a document -> doc_id, dl, term, at. With ``terms`` (term; ``rows`` bounds their number) only these
    leave the scan. A text's tokens stand in one row, so its postings are made there, without a shuffle."""
    wanted = wanted_terms(terms, rows) if terms is not None else None

    def units(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, length = batch.column(1), None
        for some in (lists, neighbours(lists)):
            names, size, row, code, ends, place = runs(some, wanted)
            length = size if length is None else length  # in tokens
            at = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
            columns = [batch.column(0).take(pa.array(row)), pa.array(length[row]), names.take(pa.array(code)), at]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "dl", "term", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield from units(batch)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", T.index_tokens("text").alias("w")).mapInArrow(run, f"doc_id {kind}, dl bigint, term string, at array<int>")
    return found if terms is None or wanted is not None else found.join(terms, "term", "left_semi").select("doc_id", "dl", "term", "at")


def totals(docs: DataFrame) -> DataFrame:
    """One row: n, avgdl of all documents."""
    sizes = docs.select(F.coalesce(F.size(T.index_tokens("text")), F.lit(0)).alias("dl"))
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def phrase_of(text) -> F.Column:
    return F.array_join(T.index_tokens(text), " ")


def clauses(questions: DataFrame) -> DataFrame:
    """questions(qid, text) -> qid, phrase: the tokens of every clause, once."""
    parts = questions.select("qid", F.explode(F.split("text", CLAUSE)).alias("clause"))
    return parts.select("qid", phrase_of("clause").alias("phrase")).filter("phrase <> ''").distinct()


def terms_of(phrases: DataFrame) -> DataFrame:
    """phrase -> phrase, n, off, term: its pairs of words, which are rarer than words, or its only word."""
    w = F.split("phrase", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, 2), " "))
    units = F.when(F.size(w) > 1, pairs).otherwise(w)
    return phrases.select("phrase").filter("phrase <> ''").distinct().select("phrase", F.size(units).alias("n"), F.posexplode(units).alias("off", "term"))


def matches(phrases: DataFrame, held: DataFrame, rows: int) -> DataFrame:
    """phrases(phrase), held of ``index`` -> phrase, doc_id, dl, starts (sorted). ``rows`` bounds the number
    of terms of all phrases, for the broadcasts.

    The rarest term gives the candidates, the next one cuts them, and what is left looks the other terms up at once. Terms and
    phrases travel as numbers."""
    asked = terms_of(phrases)
    spread = held.join(small(asked.select("term").distinct(), rows), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # A phrase with a term that no text holds loses that row, and with it the whole phrase.
    weighed = asked.join(small(spread, rows), "term")
    whole = Window.partitionBy("phrase")
    placed = weighed.withColumn("there", F.count(F.lit(1)).over(whole)).filter("there = n").withColumn("nth", F.row_number().over(whole.orderBy("df", "off")))
    codes = written(placed.select("term").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    numbers = written(placed.filter("nth = 1").select("phrase", "n").withColumn("p", F.monotonically_increasing_id()), "phrases")
    steps = written(placed.join(codes, "term").join(numbers.select("phrase", "p"), "phrase").select("p", "n", "code", F.col("off").alias("o"), "nth"), "steps")

    def postings(some: DataFrame) -> DataFrame:
        """Of the terms of these steps only."""
        wanted = codes.join(some.select("code").distinct(), "code", "left_semi")
        return held.join(small(wanted, rows), "term").select("doc_id", "dl", "code", "at")

    shifted = F.filter(F.transform("at", lambda x: x - F.col("o")), lambda x: x >= 0)
    first, second, rest = steps.filter("nth = 1"), steps.filter("nth = 2").select("p", "code", "o"), steps.filter("nth > 2").select("p", "code", "o")
    found = postings(first).join(small(first, rows), "code").select("p", "n", "doc_id", "dl", shifted.alias("starts")).filter("size(starts) > 0")

    def met(some: DataFrame, by: DataFrame) -> DataFrame:
        probes = some.join(small(by, rows), "p").join(postings(by).select("doc_id", "code", "at"), ["doc_id", "code"])
        return probes.select("p", "n", "doc_id", "dl", F.array_intersect("starts", shifted).alias("starts")).filter("size(starts) > 0")

    two = written(met(found.filter("n > 1"), second), "candidates")
    # An array is never longer than the rarest term's positions; there is one for each other term.
    folded = F.aggregate(F.slice("all", 2, F.size("all")), F.element_at("all", 1), lambda a, b: F.array_intersect(a, b))
    joined = met(two.filter("n > 2"), rest).groupBy("p", "n", "doc_id", "dl").agg(F.collect_list("starts").alias("all")).filter("size(all) = n - 2")
    several = joined.select("p", "doc_id", "dl", folded.alias("starts")).filter("size(starts) > 0")
    every = [x.select("p", "doc_id", "dl", "starts") for x in (found.filter("n = 1"), two.filter("n = 2"), several)]
    named = every[0].unionByName(every[1]).unionByName(every[2]).join(small(numbers.select("p", "phrase"), rows), "p")
    return named.select("phrase", "doc_id", "dl", F.sort_array("starts").alias("starts"))


def bm25(asked: DataFrame, held: DataFrame, whole: DataFrame, rows: int, k: int = 8) -> DataFrame:
    """asked(qid, phrase), whole of ``totals`` -> qid, doc_id, score, rank: a phrase weighs as a term does,
    by the texts that hold it and how often."""
    found = matches(asked, held, rows).select("phrase", "doc_id", "dl", F.size("starts").alias("tf"))
    n_docs = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = n_docs.join(F.broadcast(whole)).select("phrase", "avgdl", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"))  # one row
    scored = found.join(small(asked.join(weighed, "phrase"), rows), "phrase")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))
    return top(scored.groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score")), "doc_id", k)


def matching(phrases: DataFrame, held: DataFrame, rows: int) -> DataFrame:
    """phrases(owner, phrase) -> doc_id, owner: the documents that hold a phrase of another one: all that a
    search for its names has to look at. A phrase of several owners is the smallest one's, as a name is."""
    owners = phrases.filter("phrase <> ''").groupBy("phrase").agg(F.min("owner").alias("owner"))
    found = matches(owners, held, rows).select("phrase", "doc_id")
    return found.join(small(owners, rows), "phrase").filter("owner <> doc_id").select("doc_id", "owner").distinct()
