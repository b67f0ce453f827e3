"""Tables of spreadsheets: regions of filled cells, their titles, header rows and column names.

All works on cells(sheet, r, c, v, bold), one row a filled cell, with windows inside a sheet; a table is never
held in one row. A region is a run of filled rows, then of filled columns. Single cells above a table of more than
two rows are titles. Of the first five rows the best scored one is the header: text, filled, numbers below, bold.
Names of merged cells above it go before its own. A region that starts with numbers and follows a short one of
the same columns has that one as its header (header_row -1).

Defined results: cells without a value are no cells; a table without any scored row has its first as header; of
several merged cells above one column the lowest counts; an empty sheet has no region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that may be the header, the least score and lead of a clear one, rows of a region that may be another's header,
# share of numbers in a first row of data.
SCANNED, LEAST, MARGIN, SHORT, NUMERIC = 5, 0.5, 0.15, 3, 0.5
NUMBER = "(?i)^\\s*[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?\\s*$"
REGION = ("sheet", "g", "h")


def is_number(v) -> Column:
    t = F.col(v) if isinstance(v, str) else v
    return F.rlike(F.translate(t, ",%€$", "."), F.lit(NUMBER))


def letters(c: Column) -> Column:
    """Column 1 is A, 27 is AA; up to three letters."""
    one = lambda x: F.char(F.lit(64) + x)
    low, mid = (c - 1) % 26 + 1, F.floor((c - 1) / 26)
    return F.concat(
        F.when(mid > 26, one(F.floor((mid - 1) / 26))).otherwise(F.lit("")), F.when(mid > 0, one((mid - 1) % 26 + 1)).otherwise(F.lit("")), one(low)
    )


def regions(cells: DataFrame) -> DataFrame:
    """Cells with their region: (sheet, g, h) and its edges r0, r1, c0, c1."""
    some = cells.filter("v IS NOT NULL AND v <> ''").select("sheet", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v", F.coalesce("bold", F.lit(False)).alias("bold"))
    rows = some.withColumn("g", F.col("r") - F.dense_rank().over(Window.partitionBy("sheet").orderBy("r")))
    columns = rows.withColumn("h", F.col("c") - F.dense_rank().over(Window.partitionBy("sheet", "g").orderBy("c")))
    wide, one = Window.partitionBy("sheet", "g"), Window.partitionBy(*REGION)
    return columns.select("*", F.min("r").over(wide).alias("r0"), F.max("r").over(wide).alias("r1"), F.min("c").over(one).alias("c0"), F.max("c").over(one).alias("c1"))


def rows_of(found: DataFrame) -> DataFrame:
    """A row for each row of a region that has a cell: filled, numeric, bold, and top, the first row below the titles."""
    number = is_number("v").cast("int")
    edges = [*REGION, "r0", "r1", "c0", "c1", "r"]
    rows = found.groupBy(*edges).agg(
        F.count(F.lit(1)).alias("filled"), F.sum(number).alias("numeric"), F.max("bold").alias("bold"), F.min_by("v", "c").alias("first"), F.min_by(number, "c").alias("first_numeric")
    )
    # Rows with one cell that follow each other from the region's first.
    lead = F.row_number().over(Window.partitionBy(*REGION, F.col("filled") == 1).orderBy("r"))
    leading = F.coalesce((F.col("filled") == 1) & (F.col("r") - F.col("r0") + 1 == lead), F.lit(False)).cast("int")
    titles = F.greatest(F.lit(0), F.least(F.sum("leading").over(Window.partitionBy(*REGION)), F.col("r1") - F.col("r0") - 1))
    return rows.withColumn("leading", leading).withColumn("top", (F.col("r0") + titles).cast("int")).drop("leading")


def titles(rows: DataFrame) -> DataFrame:
    """sheet, r, text of single cells above tables."""
    return rows.filter("r < top").select("sheet", "r", F.col("first").alias("text"))


def scored(rows: DataFrame) -> DataFrame:
    """A row a region: header_row (from 0 at ``top``), ambiguous, n_rows, headerless."""
    there = Window.partitionBy(*REGION).orderBy("r")
    below = F.when(F.lead("r").over(there) == F.col("r") + 1, F.lead(F.col("numeric") / F.col("filled")).over(there))
    base = 0.45 * ((F.col("filled") - F.col("numeric")) / F.col("filled")) + 0.25 * (F.col("filled") / (F.col("c1") - F.col("c0") + 1)) + 0.2 * F.coalesce(below, F.lit(0.0)) + F.when(F.col("bold"), 0.1).otherwise(0.0)
    i = F.col("r") - F.col("top")
    score = F.when((i < SCANNED) & (F.col("r") < F.col("r1")), F.round(base * F.pow(F.lit(0.95), i), 9)).otherwise(0.0)
    kept = rows.withColumn("score", score).withColumn("i", i)  # below 0: titles; a table may have no cell below them
    data = (F.col("filled") > 1) & ((F.col("numeric") - F.col("first_numeric")) / (F.col("filled") - 1) >= NUMERIC)
    per = kept.groupBy(*REGION, "top", "r1", "c0", "c1").agg(
        F.sort_array(F.collect_list(F.when(F.col("i").between(0, SCANNED - 1), F.struct((-F.col("score")).alias("s"), F.col("i").alias("i"))))).alias("best"),  # at most five
        F.coalesce(F.max(F.when(F.col("i") == 0, data)), F.lit(False)).alias("headerless"),
    )
    n = F.col("r1") - F.col("top") + 1
    first, second = F.coalesce(-F.get("best", F.lit(0))["s"], F.lit(0.0)), F.coalesce(-F.get("best", F.lit(1))["s"], F.lit(0.0))
    unsure = (n > 1) & ((first < LEAST) | (first - second < MARGIN))
    at = F.when(first > 0, F.get("best", F.lit(0))["i"]).otherwise(0)
    return per.select(*REGION, "top", "r1", "c0", "c1", n.alias("n_rows"), at.cast("int").alias("header_row"), unsure.alias("ambiguous"), (F.col("headerless") & (n > 1)).alias("headerless"))


def borrowed(tables: DataFrame) -> DataFrame:
    """Tables with ``from_g, from_h``, the region whose rows are the header, if any.

    In the order of a sheet a table is preceded by the last one of its columns with a header of its own. Of a run that begins with
    such a table or goes on without headers, the first short one is the header of all that follow it."""
    order = Window.partitionBy("sheet", "c0", "c1").orderBy("top")
    run = tables.withColumn("run", F.sum((~F.col("headerless")).cast("int")).over(order))
    mine = Window.partitionBy("sheet", "c0", "c1", "run")
    first = F.min(F.when(F.col("n_rows") <= SHORT, F.struct("top", "g", "h"))).over(mine)
    held = run.withColumn("s", first)
    takes = F.col("s").isNotNull() & F.col("headerless") & (F.col("top") > F.col("s.top"))
    return held.select(*tables.columns, F.when(takes, F.col("s.g")).alias("from_g"), F.when(takes, F.col("s.h")).alias("from_h"))


def tables(cells: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """cells, merged(sheet, m_r0, m_r1, m_c0, m_c1) -> sheet, top, r1, c0, c1, range, header_row, ambiguous, names."""
    found = regions(cells)
    known = borrowed(scored(rows_of(found)))
    held = found.select(*REGION, "r", "c", "v")
    head = held.join(known.select(*REGION, "top", "header_row"), list(REGION)).filter("r = top + header_row").select(*REGION, "c", "v")
    if merged is not None:
        above = merged.join(held.select("sheet", F.col("r").alias("m_r0"), F.col("c").alias("m_c0"), F.col("v").alias("label")), ["sheet", "m_r0", "m_c0"])
        over = above.select("sheet", "m_r0", "m_r1", "label", F.explode(F.sequence("m_c0", "m_c1")).alias("c"))
        reach = over.join(known.select(*REGION, "top", "header_row", "c0", "c1"), "sheet").filter("m_r0 >= top AND m_r1 < top + header_row AND c BETWEEN c0 AND c1")
        prefix = reach.groupBy(*REGION, "c").agg(F.max_by("label", "m_r0").alias("p"))
        joined = F.when(F.col("p").isNotNull() & (F.col("p") != F.col("v")), F.concat("p", F.lit(" / "), "v")).otherwise(F.col("v"))
        head = head.join(prefix, [*REGION, "c"], "left").select(*REGION, "c", joined.alias("v"))
    named = head.groupBy(*REGION).agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("own"))  # a header row
    # The rows of a header region are at most SHORT.
    lent = known.filter("from_g IS NOT NULL").select("sheet", F.col("from_g").alias("g"), F.col("from_h").alias("h")).distinct().join(known.select(*REGION, "top"), list(REGION))
    parts = held.join(lent, list(REGION)).filter("r >= top").groupBy(*REGION, "c").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("x"))
    parts = parts.select(*REGION, F.struct("c", F.array_join(F.array_distinct(F.transform("x", lambda x: x["v"])), " / ").alias("v")).alias("e"))
    taken = parts.groupBy("sheet", F.col("g").alias("from_g"), F.col("h").alias("from_h")).agg(F.map_from_entries(F.collect_list("e")).alias("theirs"))
    both = known.join(named, list(REGION), "left").join(taken, ["sheet", "from_g", "from_h"], "left")
    columns = F.sequence("c0", "c1")
    mine = F.transform(columns, lambda c: F.coalesce(F.try_element_at("own", c), F.concat(F.lit("col"), letters(c))))
    others = F.transform(columns, lambda c: F.coalesce(F.try_element_at("theirs", c), F.concat(F.lit("col"), (c - F.col("c0") + 1).cast("string"))))
    lends = F.col("from_g").isNotNull()
    place = F.concat(letters(F.col("c0")), F.col("top").cast("string"), F.lit(":"), letters(F.col("c1")), F.col("r1").cast("string"))
    return both.select(
        "sheet", "top", "r1", "c0", "c1", place.alias("range"), F.when(lends, -1).otherwise(F.col("header_row")).alias("header_row"),
        (~lends & F.col("ambiguous")).alias("ambiguous"), F.when(lends, others).otherwise(mine).alias("names"),
    )
