"""Search queries over documents (each a passage) with the benchmark items as questions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import retrieval as R
from lectern.plans.common import STOP_SQL, crc_sql, read


def questions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def passages(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents").select(F.explode(T.terms("text")).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings_stats(spark, sf_dir):
    p = R.postings(passages(spark, sf_dir))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def avg_doc_len(spark, sf_dir):
    return R.doc_lengths(passages(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


def bm25_topk(spark, sf_dir):
    return R.bm25(questions(spark, sf_dir), passages(spark, sf_dir)).select("qid", "doc_id", "score", "rank")


def bm25_scoped(spark, sf_dir):
    docs = passages(spark, sf_dir)
    return R.bm25(questions(spark, sf_dir), docs, scope=docs.filter("lang = 'fr'")).select("qid", "doc_id", "score", "rank")


def hash_embed_documents(spark, sf_dir):
    return R.hash_embedding(passages(spark, sf_dir)).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def vector_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    return R.vector_top_k(asked, rows.select("vec_id", "v"), 10).select("qid", "vec_id", "score", "rank")


def rrf_fusion(spark, sf_dir):
    q, d = questions(spark, sf_dir), passages(spark, sf_dir)
    by_lang = R.bm25(q, d, 40, scope=d.filter("lang = 'en'"))
    return R.fuse((R.bm25(q, d, 40), 1.0), (by_lang, 0.5)).filter("rank <= 8")


def hybrid_search(spark, sf_dir):
    return R.hybrid(questions(spark, sf_dir), passages(spark, sf_dir))


def _norm(text):
    """Compatibility forms, case, commas in thousands, minus signs, apostrophes and white space made alike."""
    if text is None:
        return None
    t = re.sub(r"(?<=\d),(?=\d{3})", "", unicodedata.normalize("NFKC", text).lower())
    return re.sub(r"\s+", " ", t.replace("−", "-").replace("’", "'")).strip()


def hit_counts(hits: DataFrame) -> DataFrame:
    """hits(qid, rank, text, evidence) -> n, hit_1, hit_3, hit_8: a hit holds the whole evidence, both
    normalised, in Arrow batches of the few hits of a question."""

    @F.pandas_udf("boolean")
    def holds(text: pd.Series, evidence: pd.Series) -> pd.Series:
        wanted = {e: _norm(e) for e in evidence.unique()}
        return pd.Series([None if t is None or e is None else wanted[e] in _norm(t) for t, e in zip(text, evidence)], dtype="object")

    found = hits.groupBy("qid").agg(F.min(F.when(holds("text", "evidence"), F.col("rank"))).alias("first"))
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum((F.coalesce(F.col("first") <= k, F.lit(False))).cast("bigint")).alias(f"hit_{k}") for k in (1, 3, 8)),
    )


def hit_at_k(spark, sf_dir):
    q, d = questions(spark, sf_dir), passages(spark, sf_dir)
    hits = R.small(R.bm25(q, d, 8), 8 * q.count())
    return hit_counts(d.select("doc_id", "text").join(hits, "doc_id").join(q.withColumnRenamed("text", "evidence"), "qid"))


def near_duplicate_first(spark, sf_dir):
    d = passages(spark, sf_dir).select("doc_id", F.sha2(T.norm_key("text"), 256).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


def contaminated(items: DataFrame, docs: DataFrame) -> DataFrame:
    """items(qid, item), docs(doc_id, text) -> qid, doc_id where the text holds the whole item, whatever
    stands beside it. The item's words that its own other characters bound on both sides are whole words
    of such a text too: candidates share the first eight of these (or all, if fewer; an equi-join), then
    the text is compared. Items without such a word are a query set compared with every text."""
    word = "[\\p{L}\\p{N}]"
    inner = F.slice(F.regexp_extract_all("item", F.lit(f"(?<=[^\\p{{L}}\\p{{N}}]){word}++(?=[^\\p{{L}}\\p{{N}}])"), F.lit(0)), 1, 8)
    asked = items.filter("item IS NOT NULL").withColumn("inner", inner).withColumn("n", F.size("inner"))
    keys = asked.filter("n > 0").select("qid", "n", F.xxhash64(F.array_join("inner", " ")).alias("key"))
    # The run lengths that occur, at most eight numbers.
    lengths = keys.agg(F.collect_set("n").alias("lengths"))
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"{word}++"), F.lit(0)).alias("w")).crossJoin(F.broadcast(lengths))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
    grams = words.select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.size("w")), runs)))).alias("key"))
    found = grams.join(keys.select("qid", "key"), "key").select("qid", "doc_id").distinct()
    texts = found.join(asked.filter("n > 0").select("qid", "item"), "qid").join(docs.select("doc_id", "text"), "doc_id")
    short = docs.select("doc_id", "text").crossJoin(F.broadcast(asked.filter("n = 0").select("qid", "item")))
    return texts.select("qid", "doc_id", "item", "text").unionByName(short).filter(F.contains("text", F.col("item"))).select("qid", "doc_id")


def contamination_hits(spark, sf_dir):
    """Documents that hold a benchmark item's whole text."""
    return contaminated(questions(spark, sf_dir).withColumnRenamed("text", "item"), passages(spark, sf_dir))


ASKED = f"""asked AS (SELECT DISTINCT item_id AS qid, strip_accents(w) AS term FROM (
    SELECT item_id, unnest(CASE WHEN len(c) > 0 THEN c ELSE a END) AS w FROM (
    SELECT item_id, a, list_filter(a, lambda x: x NOT IN ({STOP_SQL})) AS c FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS a FROM benchmark))))"""
TOKENS = "tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS term FROM documents)"
BM25 = f"""WITH {ASKED}, {TOKENS},
dl AS (SELECT doc_id, lang, len(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS dl FROM documents),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM dfs, tot),
sc AS (SELECT qid, doc_id, lang, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM asked JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL)"""
_PLAIN = "regexp_replace(regexp_replace(lower({t}), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g')"
_NORM = f"trim(regexp_replace(translate({_PLAIN}, '−’', '-'''), '\\s+', ' ', 'g'))"
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)"

#: Hash vectors of documents (kind d) and questions (kind q): vec(kind, id, bucket, w).
VECTORS = f"""v_in AS (SELECT 'q' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents),
v_term AS (SELECT kind, id, unnest(CASE WHEN len(b) > 0 THEN b ELSE a END) AS term FROM (SELECT kind, id, a, list_filter(a, lambda x: x NOT IN ({STOP_SQL})) AS b
    FROM (SELECT kind, id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS a FROM v_in))),
{crc_sql('v_term', 'term')},
v_sum AS (SELECT kind, id, h % 512 AS bucket, sum(CASE WHEN h & 65536 <> 0 THEN 1 ELSE -1 END) AS x FROM v_term JOIN crc_of USING (term) GROUP BY ALL HAVING x <> 0),
vec AS MATERIALIZED (SELECT kind, id, bucket, sign(x) * sqrt(abs(x)) / sqrt(sum(abs(x)) OVER (PARTITION BY kind, id)) AS w FROM v_sum)"""

QUERIES = {f.__name__: f for f in (tokenize_terms, postings_stats, avg_doc_len, bm25_topk, bm25_scoped, hash_embed_documents, vector_topk, rrf_fusion, hybrid_search, hit_at_k, near_duplicate_first, contamination_hits)}
SQL = {
    "tokenize_terms": f"""SELECT term, count(*) AS n FROM (SELECT unnest(CASE WHEN len(c) > 0 THEN c ELSE a END) AS term FROM (
        SELECT a, list_filter(a, lambda x: x NOT IN ({STOP_SQL})) AS c FROM (
        SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS a FROM documents))) GROUP BY term""",
    "postings_stats": f"""WITH {TOKENS}, p AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)
        SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM p GROUP BY term""",
    "avg_doc_len": """SELECT count(*) AS n, round(avg(dl), 6) AS avgdl, max(dl)::BIGINT AS longest FROM (
        SELECT len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS dl FROM documents)""",
    "bm25_topk": f"{BM25} SELECT qid, doc_id, score, {_RANK} AS rank FROM sc QUALIFY {_RANK} <= 8",
    "bm25_scoped": f"{BM25} SELECT qid, doc_id, score, {_RANK} AS rank FROM sc WHERE lang = 'fr' QUALIFY {_RANK} <= 8",
    "hash_embed_documents": f"WITH RECURSIVE {VECTORS} SELECT id AS doc_id, bucket, round(w, 6) AS weight FROM vec WHERE kind = 'd'",
    "hybrid_search": f"""{BM25.replace('WITH ', 'WITH RECURSIVE ', 1)}, {VECTORS},
        cosine AS (SELECT q.id AS qid, d.id AS doc_id, round(sum(q.w * d.w), 6) AS score FROM vec q JOIN vec d USING (bucket) WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
        u AS (SELECT qid, doc_id, {_RANK} AS r, 0 AS src FROM cosine QUALIFY r <= 40 UNION ALL SELECT qid, doc_id, {_RANK}, 1 FROM sc QUALIFY {_RANK} <= 40),
        f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (r + 60)), 9) AS score, min(src * 1000 + r) AS seen FROM u GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc_id) AS place FROM f),
        o AS (SELECT p.* FROM p JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY qid, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY place) = 1)
        SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM o QUALIFY rank <= 8""",
    "vector_topk": """WITH s AS (SELECT a.vec_id AS qid, b.vec_id, round(list_dot_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 10""",
    "rrf_fusion": f"""{BM25}, a AS (SELECT qid, doc_id, {_RANK} AS r FROM sc QUALIFY {_RANK} <= 40),
        b AS (SELECT qid, doc_id, {_RANK} AS r FROM sc WHERE lang = 'en' QUALIFY {_RANK} <= 40),
        u AS (SELECT *, 0 AS src, 1.0 / (r + 60) AS w FROM a UNION ALL SELECT *, 1, 0.5 / (r + 60) FROM b),
        f AS (SELECT qid, doc_id, round(sum(w::DOUBLE), 9) AS score, min(src * 1000 + r) AS seen FROM u GROUP BY ALL)
        SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc_id) AS rank FROM f
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc_id) <= 8""",
    "hit_at_k": f"""{BM25}, h AS (SELECT qid, doc_id, {_RANK} AS r FROM sc QUALIFY {_RANK} <= 8),
        f AS (SELECT qid, min(CASE WHEN contains({_NORM.format(t='d.text')}, {_NORM.format(t='b.text')}) THEN r END) AS first
            FROM h JOIN benchmark b ON b.item_id = qid JOIN documents d USING (doc_id) GROUP BY qid)
        SELECT count(*) AS n, count(*) FILTER (first <= 1) AS hit_1, count(*) FILTER (first <= 3) AS hit_3, count(*) FILTER (first <= 8) AS hit_8 FROM f""",
    "near_duplicate_first": """SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1""",
    "contamination_hits": "SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
}
