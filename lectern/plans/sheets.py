"""Spreadsheet headers over cells made of documents: a line is a row, its first words are cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import sheets
from lectern.plans.common import read


def cells(spark, sf_dir):
    """Every seventh row is blank, some cells are, and below the second row of each block the words' lengths stand for numbers."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter("i % 7 <> 6")
    each = lines.select("doc_id", "i", F.posexplode(F.slice(F.split("line", " "), 1, 6)).alias("j", "w")).filter("length(w) > 0 AND (length(w) + i) % 5 <> 0 AND NOT (i % 7 = 0 AND i % 2 = 1 AND j > 0)")
    v = F.when((F.col("i") % 7 >= 2) & ((F.col("j") >= 1) | (F.col("i") % 3 == 0)), F.length("w").cast("string")).otherwise(F.concat(F.lit("n:"), "w"))
    return each.select(F.col("doc_id").alias("sheet"), (F.col("i") + 1).alias("r"), (F.col("j") + 1).alias("c"), v.alias("v"), ((F.col("i") % 7 == 0) & (F.col("doc_id") % 2 == 0)).alias("bold"))


def sheet_headers(spark, sf_dir):
    found = sheets.tables(cells(spark, sf_dir))
    return found.select("sheet", "range", "header_row", "ambiguous", F.array_join("names", "|").alias("names"))


def sheet_titles(spark, sf_dir):
    return sheets.titles(sheets.rows_of(sheets.regions(cells(spark, sf_dir))))


_ROWS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
w AS (SELECT doc_id, i, unnest(string_split(line, ' ')[1:6]) AS w, unnest(range(least(6, len(string_split(line, ' '))))) AS j FROM l WHERE i % 7 <> 6),
cell AS (SELECT doc_id AS sheet, i + 1 AS r, j + 1 AS c, i % 7 = 0 AND doc_id % 2 = 0 AS bold, i % 7 >= 2 AND (j >= 1 OR i % 3 = 0) AS num,
    CASE WHEN num THEN length(w)::VARCHAR ELSE 'n:' || w END AS v FROM w WHERE length(w) > 0 AND (length(w) + i) % 5 <> 0 AND NOT (i % 7 = 0 AND i % 2 = 1 AND j > 0)),
g1 AS (SELECT *, r - dense_rank() OVER (PARTITION BY sheet ORDER BY r) AS g FROM cell),
g2 AS (SELECT *, c - dense_rank() OVER (PARTITION BY sheet, g ORDER BY c) AS h, min(r) OVER (PARTITION BY sheet, g) AS r0, max(r) OVER (PARTITION BY sheet, g) AS r1 FROM g1),
reg AS MATERIALIZED (SELECT *, min(c) OVER (PARTITION BY sheet, g, h) AS c0, max(c) OVER (PARTITION BY sheet, g, h) AS c1 FROM g2),
row1 AS (SELECT sheet, g, h, r0, r1, c0, c1, r, count(*) AS filled, sum(num::INT) AS numeric_n, bool_or(bold) AS bold, arg_min(v, c) AS first_v, arg_min(num::INT, c) AS first_num FROM reg GROUP BY ALL),
row2 AS (SELECT *, filled = 1 AND r - r0 + 1 = row_number() OVER (PARTITION BY sheet, g, h, filled = 1 ORDER BY r) AS alone FROM row1),
rowt AS MATERIALIZED (SELECT *, r0 + greatest(0, least(sum(alone::INT) OVER (PARTITION BY sheet, g, h), r1 - r0 - 1)) AS top FROM row2)"""
_HEADS = f"""{_ROWS},
below AS (SELECT *, CASE WHEN lead(r) OVER w = r + 1 THEN lead(numeric_n::DOUBLE / filled) OVER w ELSE 0 END AS nb FROM rowt WINDOW w AS (PARTITION BY sheet, g, h ORDER BY r)),
score AS (SELECT *, r - top AS i, CASE WHEN r - top < 5 AND r < r1 THEN round((0.45::DOUBLE * ((filled - numeric_n)::DOUBLE / filled) + 0.25::DOUBLE * (filled::DOUBLE / (c1 - c0 + 1)) + 0.2::DOUBLE * coalesce(nb, 0)
    + CASE WHEN bold THEN 0.1::DOUBLE ELSE 0 END) * pow(0.95::DOUBLE, r - top), 9) ELSE 0 END AS s FROM below),
tab AS MATERIALIZED (SELECT sheet, g, h, top, r1, c0, c1, r1 - top + 1 AS n, list({{'s': -s, 'i': i}} ORDER BY -s, i) FILTER (i BETWEEN 0 AND 4) AS best,
    coalesce(bool_or(i = 0 AND filled > 1 AND (numeric_n - first_num)::DOUBLE / (filled - 1) >= 0.5), false) AND r1 - top + 1 > 1 AS bare FROM score GROUP BY sheet, g, h, top, r1, c0, c1),
runs AS (SELECT *, coalesce(-best[1].s, 0) AS s1, coalesce(-best[2].s, 0) AS s2, sum((NOT bare)::INT) OVER (PARTITION BY sheet, c0, c1 ORDER BY top) AS run FROM tab),
short AS (SELECT *, min(top) FILTER (n <= 3) OVER (PARTITION BY sheet, c0, c1, run) AS st FROM runs),
known AS MATERIALIZED (SELECT *, bare AND st IS NOT NULL AND top > st AS lends, CASE WHEN s1 > 0 THEN best[1].i ELSE 0 END AS hr FROM short),
col AS (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM known),
lent AS (SELECT k.sheet, k.c0, k.c1, k.top, x.c, string_agg(x.v, ' / ' ORDER BY x.r) AS v
    FROM known k JOIN (SELECT DISTINCT ON (sheet, g, h, c, v) sheet, g, h, c, v, r FROM reg JOIN (SELECT sheet, g, h, top FROM known) USING (sheet, g, h) WHERE r >= top ORDER BY r) x USING (sheet, g, h) GROUP BY ALL),
named AS (SELECT col.*, CASE WHEN lends THEN coalesce(lent.v, 'col' || (col.c - col.c0 + 1)) ELSE coalesce(reg.v, 'col' || chr((64 + col.c)::INT)) END AS name FROM col
    LEFT JOIN reg ON reg.sheet = col.sheet AND reg.g = col.g AND reg.h = col.h AND reg.c = col.c AND reg.r = col.top + col.hr
    LEFT JOIN lent ON lends AND lent.sheet = col.sheet AND lent.c0 = col.c0 AND lent.c1 = col.c1 AND lent.top = col.st AND lent.c = col.c)
SELECT sheet, chr((64 + c0)::INT) || top || ':' || chr((64 + c1)::INT) || r1 AS range, CASE WHEN lends THEN -1 ELSE hr END::INTEGER AS header_row,
    NOT lends AND n > 1 AND (s1 < 0.5 OR s1 - s2 < 0.15) AS ambiguous, string_agg(name, '|' ORDER BY c) AS names FROM named GROUP BY sheet, c0, c1, top, r1, lends, hr, n, s1, s2"""
QUERIES = {f.__name__: f for f in (sheet_headers, sheet_titles)}
SQL = {"sheet_headers": _HEADS, "sheet_titles": f"{_ROWS} SELECT sheet, r::INTEGER AS r, first_v AS text FROM rowt WHERE r < top"}
