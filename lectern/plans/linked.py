"""The search path and linked contexts over documents, with the benchmark items as questions.

A row of documents is a chunk, five rows are a section and ten a document; a chunk refers to the one seven rows
on, every third chunk to that one's whole document, by its first word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.functions import text as T
from lectern.operators import rerank, search, tables
from lectern.plans.common import STOP_SQL, crc_sql, read
from lectern.plans.search import BM25, questions


def corpus(spark, sf_dir) -> search.Corpus:
    five, ten = F.floor(F.col("doc_id") / 5).alias("section_id"), F.floor(F.col("doc_id") / 10).alias("d")
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), ten, five, "text").withColumnRenamed("d", "doc_id")
    lead = F.array_join(F.slice(T.words("text"), 1, 30), " ")
    card = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", lead.alias("lead")))), lambda x: x["lead"]), " ").alias("text")
    return search.Corpus(chunks, chunks.groupBy("doc_id").agg(card), chunks.groupBy("section_id", "doc_id").agg(card))


def references(chunks: DataFrame) -> DataFrame:
    """src, dst_doc, dst, label."""
    there = chunks.select((F.col("chunk_id") - 7).alias("src"), F.col("chunk_id").alias("to"), F.col("doc_id").alias("dst_doc"), F.coalesce(F.get(T.words("text"), F.lit(0)), F.lit("")).alias("label"))
    return there.join(chunks.select(F.col("chunk_id").alias("src")), "src").select("src", "dst_doc", F.when(F.col("src") % 3 != 0, F.col("to")).alias("dst"), "label")


def _found(spark, sf_dir):
    held = corpus(spark, sf_dir)
    ready = held.prepare(questions(spark, sf_dir))
    return held, ready, ready.search()


def corpus_search(spark, sf_dir):
    return _found(spark, sf_dir)[2].select("qid", "rank", "chunk_id", "score")


def linked_context(spark, sf_dir):
    held, ready, hits = _found(spark, sf_dir)
    hits = search.written(hits, "hits")
    more = ready.linked(hits, references(held.chunks))
    whole = tables.section_texts(held.chunks.withColumn("ordinal", F.col("chunk_id")))
    shown = search.contexts(hits, more, whole)
    return shown.select("qid", "n", "section_id", "chunk_id", "whole", "score", F.sha2("text", 256).alias("text_sha256"), "via")


def rerank_windows(spark, sf_dir):
    """Windows of every document, with the scores of their shared words with the item of the same number."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = questions(spark, sf_dir).select("qid", F.col("text").alias("question"))
    pairs = docs.withColumn("qid", F.col("id") % 40).join(items, "qid")
    n = pairs.select("qid", "id", F.size(rerank.windows("text")).alias("windows"))
    return rerank.rerank(pairs).join(n, ["qid", "id"])


_WIN = """CASE WHEN length({t}) <= 1200 THEN [{t}] ELSE list_transform(range(0, least(3, ceil((length({t}) - 400) / 800.0))::BIGINT), lambda i: substr({t}, i * 800 + 1, 1200)) END"""
_WORDS = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')"
_OVERLAP = f"""list_max(list_transform({_WIN.format(t='c.text')}, lambda p: len(list_intersect(list_distinct({_WORDS.format(t='lower(q.text)')}), list_distinct({_WORDS.format(t='lower(p)')})))))::DOUBLE - 1"""
_TOP = "row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {then})"
_CORPUS = f"""{BM25.replace('WITH ', 'WITH RECURSIVE ', 1)},
c AS (SELECT doc_id AS chunk_id, doc_id // 10 AS doc_id, doc_id // 5 AS section_id, text FROM documents),
lead AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:30], ' ') AS l FROM c),
v_in AS (SELECT 'q' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'c', chunk_id, text FROM c
    UNION ALL SELECT 'd', doc_id, string_agg(l, ' ' ORDER BY chunk_id) FROM lead GROUP BY doc_id
    UNION ALL SELECT 's', section_id, string_agg(l, ' ' ORDER BY chunk_id) FROM lead GROUP BY section_id),
v_term AS (SELECT kind, id, unnest(CASE WHEN len(b) > 0 THEN b ELSE a END) AS term FROM (SELECT kind, id, a, list_filter(a, lambda x: x NOT IN ({STOP_SQL})) AS b
    FROM (SELECT kind, id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS a FROM v_in))),
{crc_sql('v_term', 'term')},
v_sum AS (SELECT kind, id, h % 512 AS bucket, sum(CASE WHEN h & 65536 <> 0 THEN 1 ELSE -1 END) AS x FROM v_term JOIN crc_of USING (term) GROUP BY ALL HAVING x <> 0),
vec AS MATERIALIZED (SELECT kind, id, bucket, sign(x) * sqrt(abs(x)) / sqrt(sum(abs(x)) OVER (PARTITION BY kind, id)) AS w FROM v_sum),
cosine AS MATERIALIZED (SELECT q.id AS qid, o.kind, o.id, round(sum(q.w * o.w), 6) AS score FROM vec q JOIN vec o USING (bucket) WHERE q.kind = 'q' AND o.kind <> 'q' GROUP BY ALL),
lexical AS MATERIALIZED (SELECT qid, sc.doc_id AS chunk_id, c.doc_id, section_id, score FROM sc JOIN c ON chunk_id = sc.doc_id),
scope AS MATERIALIZED (SELECT qid, id AS doc_id FROM (SELECT *, {_TOP.format(by='qid', then='id')} AS r FROM cosine WHERE kind = 'd') WHERE r <= 5
    UNION SELECT qid, doc_id FROM (SELECT *, {_TOP.format(by='qid', then='chunk_id')} AS r FROM lexical) WHERE r <= 40),
a1 AS (SELECT qid, chunk_id, {_TOP.format(by='qid', then='id')} AS r FROM cosine JOIN c ON kind = 'c' AND chunk_id = id JOIN scope USING (qid, doc_id) QUALIFY r <= 40),
a2 AS (SELECT qid, chunk_id, {_TOP.format(by='qid', then='chunk_id')} AS r FROM lexical JOIN scope USING (qid, doc_id) QUALIFY r <= 40),
a3s AS (SELECT qid, id, {_TOP.format(by='qid', then='id')} AS place FROM cosine JOIN scope USING (qid) WHERE kind = 's' AND id // 2 = doc_id QUALIFY place <= 10),
a3 AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY place, chunk_id) AS r FROM a3s JOIN c ON section_id = id),
fused AS (SELECT qid, chunk_id, round(sum(w), 9) AS score, min(src * 100000 + r) AS seen FROM (SELECT *, 0 AS src, 1.0::DOUBLE / (r + 60) AS w FROM a1
    UNION ALL SELECT *, 1, 1.0::DOUBLE / (r + 60) FROM a2 UNION ALL SELECT *, 2, 0.5::DOUBLE / (r + 60) FROM a3) GROUP BY ALL),
pool AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, chunk_id) AS at_r FROM fused QUALIFY at_r <= 30),
scored AS (SELECT qid, at_r, c.*, {_OVERLAP} AS score FROM pool JOIN c USING (chunk_id) JOIN benchmark q ON item_id = qid),
once AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY score DESC, at_r) = 1),
hit AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, at_r) AS rank FROM once QUALIFY rank <= 8)"""
_LINKED = f"""{_CORPUS},
edge AS (SELECT c.chunk_id AS src, t.doc_id AS dst_doc, CASE WHEN c.chunk_id % 3 <> 0 THEN t.chunk_id END AS dst, coalesce({_WORDS.format(t='t.text')}[1], '') AS label
    FROM c JOIN c t ON t.chunk_id = c.chunk_id + 7),
gone AS (SELECT qid, rank AS at_r, chunk_id AS seed, dst_doc, dst, 'cited as "' || label || '" in [{{n}}]' AS via FROM hit JOIN edge ON src = chunk_id WHERE rank <= 3),
come AS (SELECT qid, rank AS at_r, chunk_id AS seed, src AS to_chunk, 'cites [{{n}}] as "' || label || '"' AS via FROM hit JOIN edge ON dst = chunk_id WHERE rank <= 3),
whole1 AS (SELECT * FROM gone WHERE dst IS NULL QUALIFY row_number() OVER (PARTITION BY qid, dst_doc ORDER BY at_r, via) = 1),
whole AS (SELECT * FROM whole1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY at_r, dst_doc) <= 3),
in1 AS (SELECT qid, dst_doc, chunk_id, {_TOP.format(by='qid, dst_doc', then='chunk_id')} AS r FROM whole JOIN lexical USING (qid) WHERE doc_id = dst_doc QUALIFY r <= 40),
in2 AS (SELECT qid, dst_doc, id AS chunk_id, {_TOP.format(by='qid, dst_doc', then='id')} AS r FROM whole JOIN cosine USING (qid) WHERE kind = 'c' AND id // 10 = dst_doc QUALIFY r <= 40),
in3 AS (SELECT qid, dst_doc, chunk_id, round(sum(1.0::DOUBLE / (r + 60)), 9) AS score FROM (SELECT * FROM in1 UNION ALL SELECT * FROM in2) GROUP BY ALL),
in4 AS (SELECT *, {_TOP.format(by='qid, dst_doc', then='chunk_id')} AS r FROM in3 QUALIFY r <= 3),
cand AS (SELECT qid, at_r, seed, 0 AS way, dst AS to_chunk, via FROM gone WHERE dst IS NOT NULL UNION ALL SELECT qid, at_r, seed, 1, to_chunk, via FROM come
    UNION ALL SELECT qid, at_r, seed, 2, chunk_id, via FROM whole JOIN in4 USING (qid, dst_doc)),
cand1 AS (SELECT * FROM cand WHERE (qid, to_chunk) NOT IN (SELECT (qid, chunk_id) FROM hit) QUALIFY row_number() OVER (PARTITION BY qid, to_chunk ORDER BY way, at_r, via) = 1),
cand2 AS (SELECT cand1.*, c.*, {_OVERLAP} AS score FROM cand1 JOIN c ON chunk_id = to_chunk JOIN benchmark q ON item_id = qid),
cand3 AS (SELECT * FROM cand2 WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, way, at_r, chunk_id) <= 6),
cand4 AS (SELECT * FROM cand3 QUALIFY row_number() OVER (PARTITION BY qid, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY score DESC, way, at_r, chunk_id) = 1),
link AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, way, at_r, chunk_id) AS rank FROM cand4 QUALIFY rank <= 3),
full_text AS (SELECT section_id, string_agg(text, chr(10) ORDER BY chunk_id) AS full_t FROM c GROUP BY section_id),
grp AS (SELECT qid, section_id, max(score) AS score, min(rank) AS first_r, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS some_t FROM hit GROUP BY ALL),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_r) AS i FROM grp JOIN full_text USING (section_id)),
room AS (SELECT qid, least(coalesce((SELECT sum(length(text)) FROM link WHERE link.qid = g.qid), 0), 2250)::BIGINT AS reserve FROM g GROUP BY qid),
w AS (SELECT qid, 0::BIGINT AS i, 9000 - reserve AS room_left, false AS stop, NULL::BIGINT AS section_id, NULL::DOUBLE AS score, NULL::VARCHAR AS text, NULL::BOOLEAN AS whole FROM room
    UNION ALL SELECT qid, i, CASE WHEN stopped THEN room_left ELSE room_left - length(substr(t, 1, room_left)) END, stopped, section_id, score, substr(t, 1, room_left), is_whole
    FROM (SELECT w.qid, g.i, w.room_left, g.section_id, g.score, (f.is_whole) AS is_whole, CASE WHEN is_whole THEN full_t ELSE some_t END AS t,
        w.stop OR w.room_left <= 0 OR (length(CASE WHEN is_whole THEN full_t ELSE some_t END) > w.room_left AND w.i > 0 AND w.room_left < 400) AS stopped
        FROM w JOIN g ON g.qid = w.qid AND g.i = w.i + 1, LATERAL (SELECT len({_WORDS.format(t='full_t')}) <= 350 AND length(full_t) <= w.room_left AS is_whole) f)),
main AS MATERIALIZED (SELECT * FROM w WHERE i > 0 AND NOT stop),
after AS (SELECT qid, arg_max(room_left, i) AS room_left, coalesce(max(i) FILTER (NOT stop), 0) AS n FROM w GROUP BY qid),
lk AS MATERIALIZED (SELECT link.*, (SELECT m.i FROM main m JOIN hit h ON h.qid = m.qid AND h.section_id = m.section_id WHERE h.qid = link.qid AND h.chunk_id = link.seed) AS home,
    EXISTS (SELECT 1 FROM main m WHERE m.qid = link.qid AND m.section_id = link.section_id AND contains(m.text, link.text)) AS there FROM link),
x AS (SELECT qid, 0::BIGINT AS rank, room_left + reserve AS room_left, n, false AS put, NULL::BIGINT AS section_id, NULL::BIGINT AS chunk_id, NULL::DOUBLE AS score, NULL::VARCHAR AS text, NULL::VARCHAR AS via FROM after JOIN room USING (qid)
    UNION ALL SELECT qid, rank, CASE WHEN ok THEN room_left - length(substr(text, 1, room_left)) ELSE room_left END, CASE WHEN ok THEN n + 1 ELSE n END, ok, section_id, chunk_id, score, substr(text, 1, room_left), replace(via, '{{n}}', home::VARCHAR)
    FROM (SELECT x.qid, lk.rank, x.room_left, x.n, lk.section_id, lk.chunk_id, lk.score, lk.text, lk.via, lk.home,
        lk.home IS NOT NULL AND NOT lk.there AND x.room_left >= least(400, length(lk.text)) AS ok FROM x JOIN lk ON lk.qid = x.qid AND lk.rank = x.rank + 1))
SELECT qid, i AS n, section_id, NULL::BIGINT AS chunk_id, whole, score, sha256(text) AS text_sha256, '' AS via FROM main
UNION ALL SELECT qid, n, section_id, chunk_id, false, score, sha256(text), via FROM x WHERE put"""

QUERIES = {f.__name__: f for f in (corpus_search, linked_context, rerank_windows)}
SQL = {
    "corpus_search": f"{_CORPUS} SELECT qid, rank, chunk_id, score FROM hit",
    "linked_context": _LINKED,
    "rerank_windows": f"SELECT item_id AS qid, doc_id AS id, {_OVERLAP} AS score, len({_WIN.format(t='c.text')}) AS windows FROM documents c JOIN benchmark q ON item_id = doc_id % 40",
}
