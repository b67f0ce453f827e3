"""Registered queries of scopes, filters and structure, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import cascade, scopes, section_chunks
from lectern.plans.common import read


def _scores(spark, sf_dir):
    """Sections are labels, their cards the sums of their vectors in 1/1024, so that scores are integers."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("bigint")).alias("v"))
    parts = v.select("vec_id", "label", F.posexplode("v").alias("i", "x"))
    cards = parts.groupBy("label", "i").agg(F.sum("x").alias("c"))
    asked = parts.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "i", "x")
    scored = asked.join(F.broadcast(cards), "i")  # labels x 64 rows
    return scored.groupBy("qid", F.col("label").alias("section_id")).agg(F.sum(F.col("x") * F.col("c")).alias("score")), v


def label_scope_topk(spark, sf_dir):
    scores, _ = _scores(spark, sf_dir)
    return scopes.first_by(scores, ["qid"], [F.desc("score"), "section_id"], scopes.CARDS).select("qid", "section_id", F.col("rank").cast("bigint").alias("rank"), "score")


def section_rank_expand(spark, sf_dir):
    scores, v = _scores(spark, sf_dir)
    chunks = v.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("section_id"))
    return scopes.section_chunks_ranked(scores, chunks)


def document_shortlist(spark, sf_dir):
    """Stand-in scores: a card is near a page if their lengths are, and the first such documents are hits. Only lengths count: of documents
    of one length the first ones stand for all, and pages of one length share theirs. So near pairs are listed by length, not by page."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.expr("lang <> 'fr'").alias("able"))
    asked = read(spark, sf_dir, "pages").select(F.col("page_id").alias("qid"), F.length("html").alias("n"))
    searchable = docs.filter("able")
    by_id = F.asc_nulls_last("doc_id")

    def first_near(rows, order, n):
        """qid, d, doc_id, able: for each row of a page the first n of the documents less than 40 longer or shorter."""
        held = scopes.first_by(rows, ["n_chars"], [by_id], n).drop("rank")
        # Lengths less than 40 apart lie in one or in neighbouring buckets of 40.
        bucket = lambda c: F.floor(F.col(c) / 40)
        spread = held.withColumn("b", F.explode(F.array(bucket("n_chars") - 1, bucket("n_chars"), bucket("n_chars") + 1)))
        near = asked.select("n").distinct().withColumn("b", bucket("n")).join(spread, "b").withColumn("d", F.abs(F.col("n") - F.col("n_chars"))).filter("d < 40")
        return asked.join(scopes.first_by(near, ["n"], order, n).drop("rank"), "n").select("qid", "d", "doc_id", "able")

    cards = first_near(searchable, ["d", by_id], scopes.CARDS).select("qid", "doc_id", (-F.col("d")).alias("score"))
    placed = scopes.first_by(first_near(docs, [by_id], 3), ["qid"], [by_id], 3)
    hits = placed.select("qid", "doc_id", F.when(F.col("able"), F.col("rank")).alias("rank"))  # a place taken by a text not searchable is no hit
    return scopes.shortlist(searchable.select("doc_id"), cards, hits)


def figures_per_section(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("section_id"), F.col("event_id").alias("chunk_id"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat("event_type", (F.col("event_id") % 4).cast("string"))).alias("ref"))
    return scopes.figures(e).select("section_id", "ref", F.col("rank").cast("bigint").alias("rank"))


def caption_figures(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("chunk_id"), F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 9 == 0, "").otherwise((F.col("event_id") % 5).cast("string")).alias("loc"), "event_type")
    return scopes.beside_caption(e.filter("event_type = 'view'"), e.filter("event_type <> 'view' AND chunk_id % 2 = 0"))


def failure_memo(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), "doc_id").alias("path"), (F.col("doc_id") % 3).alias("mtime"), F.col("n_chars").alias("size"), "doc_id")
    failed = d.filter("doc_id % 4 = 0").withColumn("size", F.when(F.col("doc_id") % 8 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return scopes.to_try(d, failed).select("path", "mtime", "size")


def decoded_properties(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).between(10, 50).alias("mid"))


def documents_in_list(spark, sf_dir):
    wanted = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    docs = read(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    return docs.join(wanted, "doc_id", "left_semi").select("doc_id", "key", "lang")


def document_listing(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return scopes.first_by(d, ["source"], [F.desc("n_chars"), "doc_id"], 1 << 30).select("source", "doc_id", F.col("rank").cast("bigint").alias("rank"))


def mask_spans(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    label = F.element_at(F.array(*(F.lit(x) for x in [*scopes.MASKABLE, "OTHER"])), (F.col("event_id") % 6 + 1).cast("int"))
    start = (F.col("event_id") * 7919) % 400
    spans = e.select(F.col("user_id").alias("doc_id"), label.alias("label"), start.alias("start"), (start + 5 + F.col("event_id") % 11).alias("end"), ((F.col("event_id") % 10) / 10).alias("score"))
    return scopes.spans_to_mask(spans)


def _lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    lines = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("idx", "text")).filter("trim(text) <> ''")
    return lines.select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"), F.when(F.rlike("text", F.lit("^[-*] ")), "list_item").otherwise("para").alias("kind"), "text",
        F.lit(None).cast("int").alias("level_hint"), F.lit(None).cast("double").alias("size"), F.lit(False).alias("bold"), F.lit("body").alias("style"), F.lit("md").alias("format"),
    )


def shape_headings(spark, sf_dir):
    return cascade.shape(_lines(spark, sf_dir)).select("doc_id", "idx", "level", "strong")


def structure_cascade(spark, sf_dir):
    levels, verdicts = cascade.infer(_lines(spark, sf_dir))
    counted = levels.groupBy("doc_id").agg(F.count("level").alias("headings"), F.sum(F.col("ambiguous").cast("bigint")).alias("unsure"))
    return verdicts.join(counted, "doc_id")


def section_chunk_pack(spark, sf_dir):
    lines = _lines(spark, sf_dir).select(F.col("doc_id").alias("section_id"), "idx", "kind", "text", F.lit("").alias("loc"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(0).alias("header"))
    return section_chunks.chunk(lines)


QUERIES = {
    f.__name__: f
    for f in (
        label_scope_topk, section_rank_expand, document_shortlist, figures_per_section, caption_figures, failure_memo, decoded_properties,
        documents_in_list, document_listing, mask_spans, shape_headings, structure_cascade, section_chunk_pack,
    )
}

_SCORES = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e FROM embeddings),
    p AS (SELECT vec_id, label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v), c AS (SELECT label, i, sum(x) AS c FROM p GROUP BY ALL),
    s AS (SELECT p.vec_id AS qid, c.label AS section_id, sum(p.x * c.c)::BIGINT AS score FROM p JOIN c USING (i) WHERE p.vec_id % 100 = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section_id) AS rank FROM s)"""
SQL = {
    "label_scope_topk": f"{_SCORES} SELECT qid, section_id, rank, score FROM r WHERE rank <= 5",
    "section_rank_expand": f"""{_SCORES} SELECT qid, vec_id AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank, vec_id) AS rank
        FROM r JOIN v ON v.label = section_id WHERE rank <= 10""",
    "document_shortlist": """WITH n AS (SELECT page_id AS qid, doc_id, lang, abs(length(html) - n_chars) AS d FROM pages JOIN documents ON abs(length(html) - n_chars) < 40),
        c AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY d, doc_id) AS r FROM n WHERE lang <> 'fr'),
        h AS (SELECT qid, doc_id, lang, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS r FROM n)
        SELECT qid, doc_id FROM c WHERE r <= 5 UNION SELECT qid, doc_id FROM h WHERE r <= 3 AND lang <> 'fr'""",
    "figures_per_section": """WITH e AS (SELECT user_id AS section_id, event_type || (event_id % 4) AS ref, min(event_id) AS c FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)
        SELECT section_id, ref, row_number() OVER (PARTITION BY section_id ORDER BY c) AS rank FROM e QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY c) <= 3""",
    "caption_figures": """SELECT a.event_id AS chunk_id, b.event_id AS image_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 5 = b.event_id % 5
        WHERE a.event_type = 'view' AND b.event_type <> 'view' AND b.event_id % 2 = 0 AND a.event_id % 9 <> 0 AND b.event_id % 9 <> 0""",
    "failure_memo": """SELECT 'f' || doc_id AS path, doc_id % 3 AS mtime, n_chars AS size FROM documents WHERE NOT (doc_id % 4 = 0 AND doc_id % 8 <> 0)""",
    "decoded_properties": """SELECT event_id, (props->>'k')::BIGINT AS k, coalesce((props->>'k')::BIGINT, 0) BETWEEN 10 AND 50 AS mid FROM events""",
    "documents_in_list": """SELECT doc_id, sha256(text) AS key, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "document_listing": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents",
    "mask_spans": """WITH RECURSIVE s AS (SELECT DISTINCT user_id AS doc_id, ['EMAIL', 'TELEPHONENUM', 'IBAN', 'CREDITCARDNUMBER', 'IP', 'OTHER'][event_id % 6 + 1] AS label,
            (event_id * 7919) % 400 AS a, (event_id * 7919) % 400 + 5 + event_id % 11 AS b FROM events WHERE event_id % 10 >= 5 AND event_id % 6 <> 5),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, -b, label) AS i FROM s),
        w AS (SELECT doc_id, i, label, a, b, b AS until, true AS keep FROM o WHERE i = 1
            UNION ALL SELECT o.doc_id, o.i, o.label, o.a, o.b, CASE WHEN o.a < w.until THEN w.until ELSE o.b END, o.a >= w.until FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1)
        SELECT doc_id, label, a AS start, b AS "end" FROM w WHERE keep""",
    "shape_headings": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents),
        k AS (SELECT *, lead(length(t)) OVER (PARTITION BY doc_id ORDER BY idx) AS after FROM l WHERE trim(t) <> ''),
        m AS (SELECT *, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) AS capitals,
            length(regexp_replace(t, '[^\\p{N}]', '', 'g')) AS digits, len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '')) AS n FROM k)
        SELECT doc_id, idx, 1::BIGINT AS level, letters >= 4 AND capitals > 0.8 * letters AS strong FROM m WHERE length(t) BETWEEN 1 AND 120 AND m.n <= 10
        AND NOT regexp_matches(rtrim(t), '[.,;]$') AND letters >= 3 AND letters * 10 >= (letters + digits) * 3 AND after >= 3 * length(t)""",
}
