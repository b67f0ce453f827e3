"""The thin opN_ queries of the contracts, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import licenses, quality
from lectern.llm.chat import op11_chat_formatting, op11_sql
from lectern.llm.common import read
from lectern.llm.dedup import OP2_SQL, op2_near_dedup
from lectern.llm.knn import OP10_SQL, op10_top_k
from lectern.llm.langid import op7_language_id
from lectern.llm.lloyd import op13_centroid_clustering, op13_sql
from lectern.llm.mixing import op4_mixing
from lectern.llm.packing import op9_packing
from lectern.llm.pii import op6_pii
from lectern.llm.spelling import OP12_SQL, op12_spelling_variants
from lectern.llm.suffix import OP8_SQL, op8_repeated_bytes
from lectern.llm.toxicity import op3_toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    first = F.transform("places", lambda x: x["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(first).cast("bigint").alias("first_word"),
        F.array_max(first).cast("bigint").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _op1_sql() -> str:
    grams = ", ".join(f"({t}, {j}, '{a} {b} {c}')" for t, j, a, b, c in licenses.template_grams())
    info = ", ".join(
        f"({t}, '{label}', {len(w) - licenses.K + 1}, {str(b).lower()})" for t, (label, w, b) in enumerate(licenses.TEMPLATES)
    )
    return f"""
WITH template(tid, label, grams, base) AS (VALUES {info}), gram(tid, tpos, g) AS (VALUES {grams}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
pos AS (SELECT rid, w, unnest(range(0, len(w) - {licenses.K - 1})) AS i FROM docs),
vote AS (SELECT rid, tid, i - tpos AS diag, tpos FROM pos JOIN gram ON g = w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]),
place AS (SELECT rid, label, diag FROM vote JOIN template USING (tid) WHERE base
    GROUP BY rid, tid, label, grams, diag HAVING count(DISTINCT tpos) = grams),
step AS (SELECT *, diag - lag(diag) OVER (PARTITION BY rid, tid ORDER BY diag) > {licenses.NEAR} AS fresh
    FROM (SELECT DISTINCT rid, tid, diag FROM vote JOIN template USING (tid) WHERE NOT base)),
cluster AS (SELECT rid, tid, diag, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY rid, tid ORDER BY diag) AS c FROM step),
span AS (SELECT rid, label, count(DISTINCT tpos) AS votes, grams FROM vote JOIN cluster USING (rid, tid, diag)
    JOIN template USING (tid) GROUP BY rid, tid, c, label, grams HAVING votes * 100 >= grams * {licenses.SHARE}),
based AS (SELECT rid, count(*) AS n, min(diag) AS f, max(diag) AS l,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY rid),
named AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT rid, label FROM place UNION ALL SELECT rid, label FROM span) GROUP BY rid),
scored AS (SELECT rid, max(votes::DOUBLE / grams::DOUBLE) AS s FROM span GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
    coalesce(based.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
    CASE WHEN n > 0 THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN based USING (rid) LEFT JOIN named USING (rid) LEFT JOIN scored USING (rid)"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality.apply_policy(entries, quality.STANDARD)
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE.mask)) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept"
    )


def _op5_sql() -> str:
    ok = " AND ".join(f"NOT ({rule})" for rule in quality.RULES.values())
    word = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{word}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM docs),
pos AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM words),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM pos),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win),
covered AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1),
rep AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
measured AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs
    FROM words LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    ({quality.RULES['few_words']} OR {quality.RULES['repeated_words']}) AS base_failed, ({ok}) AS kept FROM measured"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_near_dedup, op3_toxicity, op4_mixing, op5_quality_rules, op6_pii, op7_language_id, op8_repeated_bytes, op9_packing, op10_top_k, op11_chat_formatting, op12_spelling_variants, op13_centroid_clustering)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op2_near_dedup": OP2_SQL, "op5_quality_rules": _op5_sql(), "op8_repeated_bytes": OP8_SQL, "op10_top_k": OP10_SQL, "op11_chat_formatting": op11_sql(), "op12_spelling_variants": OP12_SQL, "op13_centroid_clustering": op13_sql()}
