"""Retrieval operators over batches of questions: every result is keyed by ``qid``."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

K1, B = 1.2, 0.75
RRF = 60
DIMS = 512
#: Rows of one block of vectors, and of questions.
VECTORS, QUESTIONS = 16_384, 2_048
#: Rows that a broadcast table may have (terms or ids: some 50 MB); numbers of question vectors that are
#: sent to all tasks (48 MB); documents multiplied with them at a time.
SMALL, ENTRIES, DENSE_ROWS = 500_000, 2_000_000, 2_000
#: Tokens that a task looks at together.
TOKENS = 200_000


def runs(lists: pa.ListArray, wanted: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of token lists: (different tokens, number of tokens of each list, then for each list and token of it: list, token, where
    its positions begin and end), and last all positions in that order. With ``wanted`` only these tokens count."""
    flat = lists.flatten()
    size = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    if wanted is None:
        coded = flat.dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary
    else:
        code, names = pc.fill_null(pc.index_in(flat, wanted), -1).to_numpy(), wanted
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    mine = np.flatnonzero(code >= 0)
    key = row[mine] * (len(names) + 1) + code[mine]
    order = np.argsort(key, kind="stable")  # positions stay ascending
    mine, key = mine[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return names, size, row[mine[first]], code[mine[first]], np.append(first, len(key)), place[mine]


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their lists hold about TOKENS tokens: arrays of a task stay some tens of MB. A longer text is a piece of its own."""
    for batch in batches:
        size = np.cumsum(np.nan_to_num(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOKENS, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def wanted_terms(asked: DataFrame, rows: int) -> pa.Array | None:
    """The different terms, if ``rows``, a bound of them that was counted, lets them go to all tasks."""
    return pa.array([r.term for r in asked.select("term").distinct().collect()], pa.string()) if rows <= SMALL else None


def term_counts(docs: DataFrame, asked: DataFrame, rows: int) -> DataFrame:
    """docs, one row a document -> doc_id, dl, term, tf of the asked terms (``rows`` bounds their number). A text's tokens stand in one
    row, so they are counted there, and nothing is shuffled."""
    wanted = wanted_terms(asked, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, size, row, code, ends, _ = runs(batch.column(1), wanted)
            columns = [batch.column(0).take(pa.array(row)), pa.array(size[row]), names.take(pa.array(code)), pa.array(np.diff(ends))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "dl", "term", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", T.index_tokens("text").alias("w")).mapInArrow(count, f"doc_id {kind}, dl bigint, term string, tf bigint")
    return found if wanted is not None else found.join(asked.select("term").distinct(), "term", "left_semi").select("doc_id", "dl", "term", "tf")


def doc_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, dl: every index token counts."""
    return docs.select("doc_id", F.size(T.index_tokens("text")).cast("bigint").alias("dl"))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return docs.select("doc_id", F.explode(T.index_tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(questions: DataFrame) -> DataFrame:
    """qid, term: distinct content terms, folded as the index is."""
    return questions.select("qid", F.explode(T.terms("text")).alias("w")).select("qid", F.translate("w", T.ACCENTED, T.PLAIN).alias("term")).distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for a broadcast if `rows`, a bound of its rows that was counted, is no more than SMALL;
    else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if rows <= SMALL else df


def bm25(questions: DataFrame, docs: DataFrame, k: int = 8, scope: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score, rank: the k best of ``bm25_scores``, ties to the smaller id."""
    return top(bm25_scores(questions, docs, scope), "doc_id", k)


def bm25_scores(questions: DataFrame, docs: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score of every document with a term of the question. Frequencies and lengths are of all documents; a scope
    (doc_id) restricts the answer only. Scores are rounded to 6 decimals.

    A document's length travels with its terms, so texts are cut once for the counts and once for the
    totals. Only the questions' terms leave the scan; where these are few, no join shuffles, and a
    frequent term is no hot key."""
    asked = query_terms(questions)
    rows = asked.count()
    found = term_counts(docs, asked, rows)
    totals = doc_lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    spread = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = spread.join(F.broadcast(totals)).select("term", "avgdl", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"))
    per_term = found.join(small(asked.join(weighed, "term"), rows), "term")
    if scope is not None:
        per_term = per_term.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))
    return per_term.groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def top(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def hash_vectors(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs(id, text), one row an id -> id, v array of (bucket, weight): the sparse unit vector. A term adds +-1 to
    bucket crc32 % 512, the sign by bit 16; buckets are damped by a square root and normalised. All inside a row: no shuffle. Texts
    without a term, or whose signs cancel, have no row."""
    dims = DIMS

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, _, row, code, ends, _ = runs(batch.column(1))
            h = np.array([zlib.crc32(t.encode()) for t in names.to_pylist()], np.int64)
            signed = np.where(h & (1 << 16), 1, -1) * 1.0
            key, at = np.unique(row * dims + h[code] % dims, return_inverse=True) if len(row) else (np.empty(0, np.int64), np.empty(0, np.int64))
            x = np.bincount(at, signed[code] * np.diff(ends), len(key)) if len(row) else np.empty(0)
            key, x = key[x != 0], x[x != 0]
            whose, start = np.unique(key // dims, return_index=True)
            norm = np.sqrt(np.bincount(np.searchsorted(whose, key // dims), np.abs(x), len(whose)))
            weight = np.sign(x) * np.sqrt(np.abs(x)) / norm[np.searchsorted(whose, key // dims)]
            entries = pa.StructArray.from_arrays([pa.array(key % dims), pa.array(weight)], names=["bucket", "weight"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), entries)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), lists], names=[id_col, "v"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, T.terms("text").alias("w")).mapInArrow(embed, f"{id_col} {kind}, v array<struct<bucket:bigint,weight:double>>")


def hash_embedding(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, bucket, weight: a row for each entry of ``hash_vectors``."""
    return hash_vectors(docs, id_col).select(id_col, F.explode("v").alias("e")).select(id_col, "e.bucket", "e.weight")


def dense(asked: DataFrame, held: DataFrame, k: int = 8) -> DataFrame:
    """Cosine top-k of sparse unit vectors: asked (qid, bucket, weight), held (doc_id, v) of ``hash_vectors`` or (doc_id, bucket, weight). A
    question and a document without a common bucket are no pair; ties go to the smaller id.

    The questions, up to ENTRIES numbers, are sent to all tasks, which keep k documents a question; more
    questions than that are joined on buckets."""
    head = asked.select("qid", "bucket", "weight").limit(ENTRIES + 1).toPandas()
    if len(head) > ENTRIES:
        flat = held.select("doc_id", F.explode("v").alias("e")).select("doc_id", "e.*") if "v" in held.columns else held
        pairs = asked.select("qid", "bucket", F.col("weight").alias("a")).join(flat, "bucket")
        return top(pairs.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("a") * F.col("weight")), 6).alias("score")), "doc_id", k)
    ids, at = np.unique(head.qid.to_numpy("int64"), return_inverse=True)
    sent = held.sparkSession.sparkContext.broadcast((ids, at, head.bucket.to_numpy("int64"), head.weight.to_numpy("float64")))
    questions, dims, step = QUESTIONS, DIMS, DENSE_ROWS

    def best(batches):
        ids, at, bucket, weight = sent.value
        order = np.argsort(at, kind="stable")
        at, bucket, weight = at[order], bucket[order], weight[order]
        kept = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))  # question, document, score
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                docs, lists = part.column(0).to_numpy(), part.column(1)
                x = np.zeros((len(docs), dims))
                at_bucket, at_weight = (c.to_numpy() for c in lists.flatten().flatten())
                x[np.repeat(np.arange(len(docs)), pc.list_value_length(lists).to_numpy()), at_bucket] = at_weight
                filled = (x != 0).astype("float32")
                new = [kept]
                for first in range(0, len(ids), questions):
                    a, b = np.searchsorted(at, [first, first + questions])
                    q = np.zeros((min(questions, len(ids) - first), dims))
                    q[at[a:b] - first, bucket[a:b]] = weight[a:b]
                    score = np.round(q @ x.T, 6) + 0.0
                    met = (q != 0).astype("float32") @ filled.T > 0
                    i, j = np.nonzero(met & (score >= least[first : first + len(q), None]))
                    new.append((i + first, docs[j], score[i, j]))
                who, doc, score = (np.concatenate(c) for c in zip(*new))
                order = np.lexsort((doc, -score, who))
                who, doc, score = who[order], doc[order], score[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                kept = tuple(c[rank < k] for c in (who, doc, score))
                last = rank == k - 1
                least[who[last]] = score[last]
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["qid", "doc_id", "score"])

    rows = held.select("doc_id", "v") if "v" in held.columns else held.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "weight")).alias("v"))
    return top(rows.mapInArrow(best, "qid bigint, doc_id bigint, score double"), "doc_id", k)


def vector_top_k(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """Exact top-k of dense vectors: asked (qid, q array<double>), held (vec_id, v array<double>). The
    questions are a stated set and are compared with all rows, block against block, by a matrix product;
    of each pair of blocks only a question's k best (and what ties with the last) are shuffled."""
    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((held, VECTORS), (asked, QUESTIONS)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("qid").alias("id"), F.col("q").alias("v"), F.lit(True).alias("asks"), deal("qid", parts).alias("part"), spread(blocks).alias("block"))
    right = held.select(F.col("vec_id").alias("id"), "v", F.lit(False).alias("asks"), spread(parts).alias("part"), deal("vec_id", blocks).alias("block"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf.asks], pdf[~pdf.asks]
        if not len(q) or not len(x):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []}).astype({"qid": "int64", "vec_id": "int64"})
        score = np.round(np.stack(q.v.to_list()) @ np.stack(x.v.to_list()).T, 6) + 0.0
        score[q.id.to_numpy()[:, None] == x.id.to_numpy()[None, :]] = -np.inf
        least = -np.partition(-score, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        return pd.DataFrame({"qid": q.id.to_numpy()[i], "vec_id": x.id.to_numpy()[j], "score": score[i, j]})

    rows = left.unionByName(right).withColumn("size", F.size("v"))
    pairs = rows.groupBy("part", "block", "size").applyInPandas(best, "qid bigint, vec_id bigint, score double")
    return top(pairs, "vec_id", k)


def fuse(*ranked: tuple[DataFrame, float]) -> DataFrame:
    """Weighted reciprocal rank fusion of (qid, doc_id, rank) lists; ties by order of appearance."""
    rows = None
    for order, (df, weight) in enumerate(ranked):
        part = df.select("qid", "doc_id", F.lit(order).alias("src"), "rank", (F.lit(float(weight)) / (F.col("rank") + RRF)).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("qid", "doc_id").agg(F.round(F.sum("w"), 9).alias("score"), F.min(F.struct("src", "rank")).alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("bigint")).select("qid", "doc_id", "score", "rank")


def drop_repeats(hits: DataFrame, docs: DataFrame, k: int = 8, rows: int = SMALL + 1) -> DataFrame:
    """The first of hits with one text (case and white space aside) stays; then the first k. `rows` is a
    bound of the number of hits: few are sent to the texts, so that no text is shuffled."""
    texts = docs.select("doc_id", "text").join(small(hits, rows), "doc_id")
    keyed = texts.select("qid", "doc_id", "score", "rank", F.xxhash64(T.norm_key("text")).alias("key"))
    first = keyed.withColumn("r", F.row_number().over(Window.partitionBy("qid", "key").orderBy("rank"))).filter("r = 1")
    again = first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("bigint"))
    return again.filter(F.col("n") <= k).select("qid", "doc_id", "score", F.col("n").alias("rank"))


def hybrid(questions: DataFrame, docs: DataFrame, k: int = 8, pool: int = 40) -> DataFrame:
    """BM25 and hash vectors, fused, repeats dropped."""
    vectors = hash_vectors(docs)
    asked = hash_embedding(questions, "qid")
    fused = fuse((dense(asked, vectors, pool), 1.0), (bm25(questions, docs, pool), 1.0))
    # No question has more than both pools.
    return drop_repeats(fused, docs, k, 2 * pool * questions.count())
