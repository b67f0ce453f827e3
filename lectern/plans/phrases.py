"""Phrase queries over documents: clauses of the benchmark items, and names as a citation prefilter."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import phrases as P
from lectern.plans.common import read
from lectern.shared import written


def _index(docs, phrases):
    """The postings of the phrases' terms, written once and read for every step, and the number of terms."""
    asked = P.terms_of(phrases)
    rows = asked.count()
    return written(P.index(docs, asked.select("term").distinct(), rows), "postings"), rows


def bm25_phrases(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    asked = P.clauses(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"))
    held, rows = _index(docs, asked)
    return P.bm25(asked, held, P.totals(docs), rows).select("qid", "doc_id", "score", "rank")


def citation_prefilter(spark, sf_dir):
    """The first four words of every document whose id is divisible by 50 stand for its name."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    named = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("owner"), F.array_join(F.slice(T.index_tokens("text"), 1, 4), " ").alias("phrase"))
    held, rows = _index(docs, named)
    return P.matching(named, held, rows)


_TOK = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
QUERIES = {f.__name__: f for f in (bm25_phrases, citation_prefilter)}
SQL = {
    "bm25_phrases": f"""WITH doc AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents),
        tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM doc),
        clause AS (SELECT item_id AS qid, unnest(regexp_split_to_array(text, '[.,;:!?\\n]+')) AS c FROM benchmark),
        asked AS (SELECT DISTINCT qid, {_TOK.format('c')} AS p FROM clause WHERE len({_TOK.format('c')}) > 0),
        pos AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM doc),
        hit AS (SELECT p, doc_id, len(w) AS dl, count(*) AS tf FROM (SELECT DISTINCT p FROM asked) JOIN pos ON term = p[1] JOIN doc USING (doc_id)
            WHERE w[i:i + len(p) - 1] = p GROUP BY ALL),
        idf AS (SELECT p, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf
            FROM (SELECT p, count(*) AS df FROM hit GROUP BY p), tot),
        sc AS (SELECT qid, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
            FROM asked JOIN hit USING (p) JOIN idf USING (p), tot GROUP BY ALL)
        SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 8""",
    "citation_prefilter": f"""WITH doc AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents),
        named AS (SELECT min(doc_id) AS owner, w[1:4] AS p FROM doc WHERE doc_id % 50 = 0 AND len(w) > 0 GROUP BY w[1:4])
        SELECT DISTINCT doc_id, owner FROM named JOIN doc ON owner <> doc_id AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')""",
}
