"""The relational core: statistics, sessions, synchronisation, evaluation, structure, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunks, links, structure, sync
from lectern.plans.common import STOP_SQL, read

ACT = "index-1"


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.size(T.words("text")).cast("bigint")
    return _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(w).alias("words"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))


def status_format_histogram(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def content_hash_duplicates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def stem_fold_terms(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", F.explode(T.content_terms("text")).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def split_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.chunk_sentences("text")).cast("bigint").alias("n_sentences"))


def lead_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.lead("text", 60).alias("card"))


def chunk_pack(spark, sf_dir):
    return chunks.pack(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ordinal", "words")


def chunk_ctx(spark, sf_dir):
    held = _docs(spark, sf_dir).select("doc_id", F.concat_ws(" > ", "source", "lang").alias("path"))
    packed = chunks.pack(_docs(spark, sf_dir).select("doc_id", "text"))
    return packed.join(held, "doc_id").select("doc_id", "ordinal", F.sha2(F.concat("path", F.lit("\n"), "text"), 256).alias("ctx_sha"))


def numbers_canonical(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("num"))
    return t.groupBy("doc_id").agg(F.countDistinct("num").alias("n_numbers"))


def canonical_numbers(spark, sf_dir):
    """Different numbers of a document in one form, where numbers_canonical counts raw runs of digits."""
    t = _docs(spark, sf_dir).select("doc_id", F.explode(T.numbers("text")).alias("num"))
    return t.groupBy("doc_id").agg(F.countDistinct("num").alias("n_numbers"))


def language_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.italian("text").alias("italian"))


def coverage_pairs(spark, sf_dir):
    """Assistant turns against the user turn before them."""
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("asked", F.lag("text").over(w)).withColumn("who", F.lag("role").over(w)).filter("role = 'assistant' AND who = 'user'")
    return pairs.select("conv_id", "turn", F.round(T.coverage(T.content_terms("text"), T.content_terms("asked")), 6).alias("coverage"))


def session_window(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).filter("r <= 4").select("conv_id", "turn", "role")


def memory_trigger(spark, sf_dir):
    g = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("messages"))
    return g.select("conv_id", "chars", "messages", ((F.col("chars") >= 6000) & (F.col("messages") > 6)).alias("fold"))


def session_titles(spark, sf_dir):
    first = read(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", F.array_join(F.slice(T.words("t"), 1, 6), " ").alias("title"))


def boilerplate_lines(spark, sf_dir):
    """Lines, digits made alike, that stand in at least two documents of a source."""
    lines = _docs(spark, sf_dir).select("source", "doc_id", F.explode(F.split("text", "\n")).alias("l"))
    norm = F.regexp_replace(F.trim(F.lower("l")), "[0-9]+", "#")
    per = lines.select("source", "doc_id", norm.alias("line")).filter("line <> ''").distinct()
    return per.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter("n_docs >= 2")


def profile_votes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    votes = e.select(F.lit("md").alias("format"), F.concat(F.lit("s"), (F.col("user_id") % 97).cast("string")).alias("style"), F.when(F.col("event_id") % 10 == 0, 4).otherwise(F.col("user_id") % 97 % 4).cast("bigint").alias("level"), F.lit(1).alias("weight"))
    return structure.learned_levels(votes)


def _snapshots(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("size"))
    path = lambda tag: F.concat(F.lit(tag), F.col("doc_id").cast("string"))
    known = d.filter("doc_id % 7 <> 0").select(path("f").alias("path"), "sha", F.lit(1).cast("bigint").alias("mtime"), "size", F.when(F.col("doc_id") % 11 == 0, F.lit("old")).otherwise(F.lit(ACT)).alias("index_sig"))
    listing = d.filter("doc_id % 5 <> 0 OR doc_id % 10 = 0").select(
        F.when(F.col("doc_id") % 10 == 0, path("moved")).otherwise(path("f")).alias("path"), "sha",
        F.when(F.col("doc_id") % 13 == 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("mtime"), "size", F.lit(True).alias("settled"),
    )
    return known, listing


def sync_diff(spark, sf_dir):
    return sync.actions(*_snapshots(spark, sf_dir), ACT)


def embedding_reuse(spark, sf_dir):
    d = _docs(spark, sf_dir)
    old = d.filter("doc_id % 3 = 0").select("text", F.array(F.col("n_chars").cast("double")).alias("vector"))
    reused = sync.reusable_vectors(old, d.select("doc_id", "text"))
    return reused.agg(F.count(F.lit(1)).alias("n"), F.count("vector").alias("reused"))


def page_outlinks(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("href").alias("n_targets"))


def html_blocks(spark, sf_dir):
    from lectern.sources.html import blocks

    b = blocks(read(spark, sf_dir, "pages"))
    return b.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def heading_candidates(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return lines.filter(structure.headingish("text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def outcome_rollup(spark, sf_dir):
    j = read(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    r = j.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("bigint").alias("good"), F.round(F.avg("toxic"), 6).alias("toxic_share"))
    return r.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "n", "good", "toxic_share")


def threshold_grid(spark, sf_dir):
    """Replay of an accept threshold on length: right minus three times wrong, for each threshold of a
    fixed grid; one pass, the grid is columns of one aggregate."""
    j = read(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    grid = [100 * i for i in range(1, 13)]
    sums = j.agg(*(F.sum(F.when(F.col("n_chars") >= g, F.when(F.col("quality") == 1, 1).otherwise(-3)).otherwise(0)).cast("bigint").alias(f"g{g}") for g in grid))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(g).cast("bigint").alias("threshold"), F.col(f"g{g}").alias("score")) for g in grid))).alias("x")).select("x.*")


AXES = ([-1000, -10, -9, -8, -7, -6, -5, -4, -3], [0.0, 0.3, 0.4, 0.5, 0.6, 0.7], [0.0, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95])


def threshold_replay(spark, sf_dir):
    """9 x 6 x 7 thresholds over the labelled documents; the measures come from lengths and ids, every fiftieth has no relevance."""
    from lectern.operators import evals

    j = read(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    relevance = F.when(F.col("doc_id") % 50 != 0, (F.col("n_chars") % 1000).cast("double") / 100 - 11)
    run = j.select(relevance.alias("relevance"), ((F.col("n_chars") % 97).cast("double") / 97).alias("support"), ((F.col("doc_id") % 89).cast("double") / 88).alias("verifier"), (F.col("quality") == 1).alias("good"))
    return evals.replay(run, *AXES)


def fit_holdout_split(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id")
    code = F.aggregate(F.transform(F.split(F.col("doc_id").cast("string"), "(?!^)(?!$)"), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    return d.groupBy((code % 2 == 0).alias("fit")).agg(F.count(F.lit(1)).alias("n"))


def pii_counts(spark, sf_dir):
    """Distinct e-mail addresses and IPv4-like values per document, case aside."""
    kinds = {"EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "IP": "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"}
    rows = None
    for label, p in kinds.items():
        part = _docs(spark, sf_dir).select("doc_id", F.lit(label).alias("label"), F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("doc_id", "label").agg(F.countDistinct(F.lower("v")).alias("n"))


def pii_mask(spark, sf_dir):
    """Stable placeholders: the nth different value of a document, in order of first appearance."""
    p = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
    v = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("i", "v"))
    first = v.groupBy("doc_id", F.lower("v").alias("value")).agg(F.min("i").alias("i"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return first.select("doc_id", "value", F.concat(F.lit("[EMAIL_"), n.cast("string"), F.lit("]")).alias("placeholder"))


def pii_mask_text(spark, sf_dir):
    """The masked texts, all labels, where pii_mask lists the placeholders of e-mail addresses."""
    from lectern.operators import pii

    return pii.mask(_docs(spark, sf_dir))


def pii_mask_fields(spark, sf_dir):
    """Ten documents at a time are the fields of one: the same value has the same placeholder in all ten."""
    from lectern.operators import pii

    d = _docs(spark, sf_dir)
    return pii.mask_fields(d.select(F.floor(F.col("doc_id") / 10).alias("doc_id"), F.col("doc_id").alias("seq"), "text"))[0]


def _lines(spark, sf_dir):
    """Documents line by line: doc_id, idx, line."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).withColumn("idx", F.col("idx").cast("bigint"))


def link_local(spark, sf_dir):
    """Of every four lines the first is made a caption, the second refers to it and to a section of eight lines, the fourth is an image
    on the caption's page."""
    rows, at, four = _lines(spark, sf_dir).filter("idx < 4000"), F.col("idx") % 4, F.floor(F.col("idx") / 4).cast("string")
    said = F.concat("line", F.lit(" see Figure "), four, F.lit(", and Section "), F.floor(F.col("idx") / 8).cast("string"))
    chunks = rows.select(
        (F.col("doc_id") * 100_000 + F.col("idx")).alias("chunk_id"), "doc_id", F.when(at == 0, F.concat(F.lit("Figure "), four, F.lit(": "), "line")).when(at == 1, said).otherwise(F.col("line")).alias("text"),
        F.when(at == 3, "image").otherwise("text").alias("kind"), F.concat(F.lit("page "), four).alias("loc"),
    )
    heads = rows.filter("idx % 8 = 0").select("doc_id", F.col("idx").alias("ordinal"), F.concat(F.floor(F.col("idx") / 8).cast("string"), F.lit(" Part")).alias("title"), (F.col("doc_id") * 100_000 + F.col("idx")).alias("first_chunk"))
    return links.inside(chunks, heads).select("src_doc", "src", "dst", "kind", "label")


def section_paths(spark, sf_dir):
    """Lines as blocks: every third one is a heading whose level comes from its length, the others are body."""
    level = F.when(F.col("idx") % 3 == 0, 1 + F.length("line") % 4)
    blocks = _lines(spark, sf_dir).select("doc_id", "idx", F.substring("line", 1, 20).alias("text"), level.alias("level"))
    return structure.tree(blocks).select("doc_id", "idx", "section", "parent", "path")


_WORD = "[\\p{L}\\p{N}_]"
_NAMES = (corpus_stats, status_format_histogram, content_hash_duplicates, stem_fold_terms, split_sentences, lead_summary, chunk_pack, chunk_ctx, numbers_canonical, language_id, coverage_pairs, session_window, memory_trigger, session_titles, boilerplate_lines, profile_votes, sync_diff, embedding_reuse, page_outlinks, html_blocks, heading_candidates, outcome_rollup, threshold_grid, threshold_replay, fit_holdout_split, pii_counts, pii_mask, link_local, section_paths)
QUERIES = {f.__name__: f for f in _NAMES}


def _content(col: str) -> str:
    stop = STOP_SQL + "".join(f", '{w}'" for w in T.META)
    first = "CASE WHEN length(f) > 5 THEN regexp_replace(f, '[aeio]$', '') ELSE f END"
    return f"""list_distinct(list_transform(list_transform(list_transform(list_filter(
        regexp_extract_all(regexp_replace(lower({col}), '\\[[0-9]{{1,2}}\\]', ' ', 'g'), '{_WORD}{{3,}}'),
        lambda w: w NOT IN ({stop}) AND NOT regexp_full_match(w, '[0-9]+')), lambda w: strip_accents(w)), lambda f: {first}),
        lambda g: CASE WHEN length(g) > 4 THEN regexp_replace(g, 's$', '') ELSE g END))"""


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_IT = ", ".join(f"'{w}'" for w in T.ITALIAN)
SQL = {
    "corpus_stats": f"SELECT count(*) AS n_docs, sum(len({_WORDS}))::BIGINT AS words, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents",
    "status_format_histogram": "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL",
    "content_hash_duplicates": "SELECT sha256(text) AS sha, min(doc_id) AS kept, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "stem_fold_terms": f"SELECT term, count(*) AS n_docs FROM (SELECT unnest({_content('text')}) AS term FROM documents) GROUP BY term",
    "split_sentences": "SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))::BIGINT AS n_sentences FROM documents",
    "lead_summary": f"SELECT doc_id, CASE WHEN len(w) > 60 THEN array_to_string(w[1:60], ' ') || ' ...' ELSE array_to_string(w, ' ') END AS card FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
    "numbers_canonical": "SELECT doc_id, count(DISTINCT n) AS n_numbers FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS n FROM documents) GROUP BY doc_id",
    "language_id": f"SELECT doc_id, len(list_filter(w, lambda x: x IN ({_IT}))) >= greatest(1, len(w) // 8) AS italian FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}+') AS w FROM documents)",
    "coverage_pairs": f"""WITH p AS (SELECT *, lag(text) OVER w AS asked, lag(role) OVER w AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        t AS (SELECT conv_id, turn, {_content('text')} AS a, {_content('asked')} AS b FROM p WHERE role = 'assistant' AND who = 'user')
        SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(a), 6) END::DOUBLE AS coverage FROM t""",
    "session_window": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
    "memory_trigger": "SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS messages, sum(length(text)) >= 6000 AND count(*) > 6 AS fold FROM conversations GROUP BY conv_id",
    "session_titles": "SELECT conv_id, array_to_string(list_filter(regexp_split_to_array(arg_min(text, turn), '\\s+'), lambda x: x <> '')[1:6], ' ') AS title FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "boilerplate_lines": """SELECT source, line, count(*) AS n_docs FROM (SELECT DISTINCT source, doc_id, regexp_replace(trim(lower(l)), '[0-9]+', '#', 'g') AS line
        FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE line <> '' GROUP BY ALL HAVING count(*) >= 2""",
    "profile_votes": """WITH v AS (SELECT 's' || (user_id % 97) AS style, (CASE WHEN event_id % 10 = 0 THEN 4 ELSE user_id % 97 % 4 END)::BIGINT AS level, count(*) AS w FROM events GROUP BY ALL)
        SELECT 'md' AS format, style, level FROM (SELECT *, sum(w) OVER (PARTITION BY style) AS total,
        row_number() OVER (PARTITION BY style ORDER BY w DESC, level) AS r FROM v) WHERE r = 1 AND total >= 2 AND w * 10 >= total * 8""",
    "sync_diff": f"""WITH d AS (SELECT doc_id, sha256(text) AS sha, n_chars AS size FROM documents),
        k AS (SELECT 'f' || doc_id AS path, sha, size, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE '{ACT}' END AS sig FROM d WHERE doc_id % 7 <> 0),
        l AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'moved' ELSE 'f' END || doc_id AS path, sha, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS mtime, size FROM d WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0),
        here AS (SELECT path, CASE WHEN mtime <> 1 THEN 'updated' WHEN sig <> '{ACT}' THEN 'rebuilt' END AS action FROM k JOIN l USING (path)),
        gone AS (SELECT * FROM k WHERE path NOT IN (SELECT path FROM l)), fresh AS (SELECT * FROM l WHERE path NOT IN (SELECT path FROM k)),
        heads AS (SELECT sha, min(path) AS head FROM fresh GROUP BY sha),
        moved AS (SELECT head AS path, old FROM heads JOIN (SELECT sha, min(path) AS old FROM gone GROUP BY sha) USING (sha))
        SELECT path, action FROM here WHERE action IS NOT NULL
        UNION ALL SELECT f.path, CASE WHEN f.path IN (SELECT path FROM moved) THEN 'renamed' WHEN f.sha IN (SELECT sha FROM k) OR f.path <> head THEN 'duplicate' ELSE 'added' END FROM fresh f JOIN heads USING (sha)
        UNION ALL SELECT path, 'removed' FROM gone WHERE path NOT IN (SELECT old FROM moved)""",
    "embedding_reuse": "SELECT count(*) AS n, count(*) FILTER (text IN (SELECT text FROM documents WHERE doc_id % 3 = 0)) AS reused FROM documents",
    "page_outlinks": """SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""",
    "heading_candidates": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), m AS (SELECT *,
        length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{N}]', '', 'g')) AS digits,
        len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '')) AS n FROM l)
        SELECT doc_id, count(*) AS n FROM m WHERE length(t) BETWEEN 1 AND 120 AND m.n <= 14 AND NOT regexp_matches(rtrim(t), '[.,;]$')
        AND letters >= 3 AND letters * 10 >= (letters + digits) * 3 GROUP BY doc_id""",
    "chunk_pack": """WITH RECURSIVE s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents),
        e AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM s),
        w AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(a[i], '\\s+'), lambda x: x <> '')) AS n FROM e),
        c AS (SELECT doc_id, i, n, unnest(range(0, (n + 259) // 260)) AS j FROM w WHERE n > 0),
        p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, least(260, n - j * 260) AS n FROM c),
        r AS (SELECT doc_id, k, 0::BIGINT AS bin, n::BIGINT AS used, n::BIGINT AS size FROM p WHERE k = 1
        UNION ALL SELECT p.doc_id, p.k, r.bin + CASE WHEN r.used + p.n > 260 THEN 1 ELSE 0 END,
            CASE WHEN r.used + p.n > 260 THEN p.n ELSE r.used + p.n END, p.n FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
        SELECT doc_id, bin AS ordinal, sum(size)::BIGINT AS words FROM r GROUP BY ALL""",
    "outcome_rollup": "SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, sum(quality)::BIGINT AS good, round(avg(toxic), 6) AS toxic_share FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)",
    "threshold_grid": "SELECT threshold::BIGINT AS threshold, sum(CASE WHEN n_chars >= threshold THEN CASE WHEN quality = 1 THEN 1 ELSE -3 END ELSE 0 END)::BIGINT AS score FROM labels JOIN documents USING (doc_id), (SELECT unnest(range(100, 1201, 100)) AS threshold) GROUP BY threshold",
    "threshold_replay": f"""SELECT relevance, support, verifier, coalesce(sum(CASE WHEN ok THEN 1 END), 0)::BIGINT AS n, coalesce(sum(CASE WHEN ok THEN CASE WHEN quality = 1 THEN 1 ELSE -3 END END), 0)::BIGINT AS score
        FROM (SELECT quality, relevance, support, verifier, (doc_id % 50 = 0 OR (n_chars % 1000)::DOUBLE / 100 - 11 >= relevance) AND (n_chars % 97)::DOUBLE / 97 >= support AND (doc_id % 89)::DOUBLE / 88 >= verifier AS ok
        FROM labels JOIN documents USING (doc_id), (SELECT unnest({AXES[0]}::DOUBLE[]) AS relevance), (SELECT unnest({AXES[1]}::DOUBLE[]) AS support), (SELECT unnest({AXES[2]}::DOUBLE[]) AS verifier)) GROUP BY ALL""",
    "fit_holdout_split": "SELECT list_sum(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))) % 2 = 0 AS fit, count(*) AS n FROM documents GROUP BY 1",
    "pii_counts": """SELECT doc_id, label, count(DISTINCT lower(v)) AS n FROM (
        SELECT doc_id, 'EMAIL' AS label, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS v FROM documents
        UNION ALL SELECT doc_id, 'IP', unnest(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) FROM documents) GROUP BY ALL""",
    "pii_mask": """WITH m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+') AS a FROM documents),
        v AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM m), f AS (SELECT doc_id, lower(a[i]) AS value, min(i) AS i FROM v GROUP BY ALL)
        SELECT doc_id, value, '[EMAIL_' || row_number() OVER (PARTITION BY doc_id ORDER BY i) || ']' AS placeholder FROM f""",
    "link_local": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        r AS (SELECT doc_id AS src_doc, doc_id * 100000 + i AS src, i // 4 AS g, i // 8 AS s, i FROM l WHERE i % 4 = 1 AND i < 4000)
        SELECT src_doc, src, src - 1 AS dst, 'figure' AS kind, 'Figure ' || g AS label FROM r
        UNION ALL SELECT src_doc, src, src + 2, 'figure', 'Figure ' || g FROM r JOIN l ON doc_id = src_doc AND l.i = r.i + 2
        UNION ALL SELECT src_doc, src, src_doc * 100000 + 8 * s, 'section', 'Section ' || s FROM r""",
    "section_paths": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
        b AS (SELECT doc_id, idx, substr(line, 1, 20) AS text, CASE WHEN idx % 3 = 0 THEN 1 + length(line) % 4 END AS level FROM l),
        h AS (SELECT * FROM b WHERE level IS NOT NULL),
        above AS (SELECT x.doc_id, x.idx, y.idx AS up, y.text AS title FROM b x JOIN h y ON x.doc_id = y.doc_id AND y.idx < x.idx AND y.level < coalesce(x.level, 99)
            WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.doc_id = y.doc_id AND z.idx > y.idx AND z.idx < x.idx AND z.level <= y.level)),
        per AS (SELECT doc_id, idx, list(up ORDER BY up) AS ups, list(title ORDER BY up) FILTER (title <> '') AS titles FROM above GROUP BY ALL)
        SELECT b.doc_id, b.idx, CASE WHEN level IS NOT NULL THEN b.idx ELSE ups[-1] END AS section, CASE WHEN level IS NOT NULL THEN ups[-1] ELSE ups[-2] END AS parent,
            array_to_string(list_concat(coalesce(titles, []), CASE WHEN level IS NOT NULL AND text <> '' THEN [text] ELSE [] END), ' > ') AS path
        FROM b LEFT JOIN per USING (doc_id, idx)""",
}


def ground_sentences(spark, sf_dir):
    """Assistant turns, sentence by sentence, against the user turn before them as the only passage."""
    from lectern.operators import grounding

    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    qid = F.col("conv_id") * 1000 + F.col("turn")
    pairs = c.withColumn("asked", F.lag("text").over(w)).withColumn("who", F.lag("role").over(w)).filter("role = 'assistant' AND who = 'user'").select(qid.alias("qid"), "text", "asked")
    claims = grounding.check(pairs.select("qid", F.col("text").alias("answer")), pairs.select("qid", F.lit(1).alias("n"), F.col("asked").alias("text")))
    return claims.select("qid", "sent", F.coalesce("support", F.lit(0.0)).alias("support"), F.coalesce("reason", F.lit("")).alias("reason"))


def context_pack(spark, sf_dir):
    """The hits of every benchmark item packed into the default budget; a document is one section."""
    from lectern.operators import context
    from lectern.plans import search

    hits = search.bm25_topk(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    rows = hits.select("qid", "rank", F.col("doc_id").alias("section_id"), "text", "score")
    packed = context.pack(rows, _docs(spark, sf_dir).select(F.col("doc_id").alias("section_id"), F.col("text").alias("full")))
    return packed.select("qid", "n", "section_id", F.length("text").cast("bigint").alias("chars"))


def numbering_runs(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    found = structure.numbering(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return _docs(spark, sf_dir).select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES |= {f.__name__: f for f in (ground_sentences, context_pack, numbering_runs, canonical_numbers, pii_mask_text, pii_mask_fields)}
SQL["context_pack"] = """WITH RECURSIVE r AS MATERIALIZED (SELECT qid, rank AS k, doc_id, length(text) AS n, text FROM (BM25) JOIN documents USING (doc_id)),
    p AS (SELECT qid, k, doc_id, n, row_number() OVER (PARTITION BY qid ORDER BY k) AS i FROM r),
    w AS (SELECT qid, i, 9000 - least(n, 9000) AS room, least(n, 9000) AS shown, doc_id, false AS stop FROM p WHERE i = 1
        UNION ALL SELECT p.qid, p.i, CASE WHEN x THEN room ELSE room - least(p.n, room) END, CASE WHEN x THEN 0 ELSE least(p.n, room) END, p.doc_id, x
        FROM (SELECT p.*, w.room, (w.stop OR w.room <= 0 OR (p.n > w.room AND w.room < 400)) AS x FROM w JOIN p ON p.qid = w.qid AND p.i = w.i + 1) p)
    SELECT qid, i AS n, doc_id AS section_id, shown::BIGINT AS chars FROM w WHERE NOT stop"""


def _bm25_sql() -> str:
    from lectern.plans import search

    return search.SQL["bm25_topk"]


SQL["context_pack"] = SQL["context_pack"].replace("(BM25)", f"({_bm25_sql()})")
SQL["numbering_runs"] = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents),
    m AS (SELECT *, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{N}]', '', 'g')) AS digits,
        len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '')) AS n FROM l),
    h AS (SELECT doc_id, idx, regexp_matches(t, '^([0-9]{1,2}|[A-Z])((\\.[0-9]{1,2}){0,4})[.)]?\\s+[\\p{Lu}0-9"''(]') AND length(t) BETWEEN 1 AND 120 AND m.n <= 14
        AND NOT regexp_matches(rtrim(t), '[.,;]$') AND letters >= 3 AND letters * 10 >= (letters + digits) * 3 AS hit,
        regexp_extract(t, '^([0-9]{1,2}|[A-Z])((\\.[0-9]{1,2}){0,4})[.)]?\\s+[\\p{Lu}0-9"''(]', 2) = '' AS flat FROM m),
    r AS (SELECT *, hit AND flat AS weak, sum(CASE WHEN hit AND flat THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM h),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, weak ORDER BY idx) AS k, count(*) OVER (PARTITION BY doc_id, run, weak) AS len FROM r),
    c AS (SELECT doc_id, count(*) AS n FROM p WHERE hit AND NOT (weak AND k % 2 = 0 AND k < len) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN c.n >= 3 THEN c.n ELSE 0 END::BIGINT AS n FROM documents LEFT JOIN c USING (doc_id)"""
SQL["chunk_ctx"] = """WITH RECURSIVE s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents),
    e AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM s),
    w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(a[i], '\\s+'), lambda x: x <> '') AS g FROM e),
    c AS (SELECT doc_id, i, g, unnest(range(0, (len(g) + 259) // 260)) AS j FROM w WHERE len(g) > 0),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, g[j * 260 + 1:j * 260 + 260] AS g FROM c),
    r AS (SELECT doc_id, k, 0::BIGINT AS bin, len(g)::BIGINT AS used FROM p WHERE k = 1
    UNION ALL SELECT p.doc_id, p.k, r.bin + CASE WHEN r.used + len(p.g) > 260 THEN 1 ELSE 0 END,
        CASE WHEN r.used + len(p.g) > 260 THEN len(p.g) ELSE r.used + len(p.g) END FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1),
    t AS (SELECT doc_id, bin AS ordinal, string_agg(array_to_string(g, ' '), ' ' ORDER BY k) AS text FROM r JOIN p USING (doc_id, k) GROUP BY ALL)
    SELECT doc_id, ordinal, sha256(source || ' > ' || lang || chr(10) || t.text) AS ctx_sha FROM t JOIN documents USING (doc_id)"""
