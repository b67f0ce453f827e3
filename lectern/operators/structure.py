"""Heading inference and section trees over a blocks table (doc_id, idx, text, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERED = "^([0-9]{1,2}|[A-Z])((?:\\.[0-9]{1,2}){0,4})[.)]?\\s+[\\p{Lu}0-9\"'(]"


def headingish(text) -> Column:
    """Short, no closing mark, mostly letters."""
    t = F.col(text) if isinstance(text, str) else text
    letters = F.length(F.regexp_replace(t, "[^\\p{L}]", ""))
    digits = F.length(F.regexp_replace(t, "[^\\p{N}]", ""))
    n_words = F.size(F.array_remove(F.split(F.trim(t), "\\s+"), ""))
    return (
        F.length(t).between(1, 120) & (n_words <= 14) & ~F.rlike(F.rtrim(t), F.lit("[.,;]$")) & (letters >= 3) & (letters * 10 >= (letters + digits) * 3)
    )


def numbering(blocks: DataFrame) -> DataFrame:
    """doc_id, idx, level, strong of numbered headings. Inside a run of weak (one-component) hits every
    second one that is not the last goes (a list, not headings); three hits are needed over all."""
    parts = F.size(F.split(F.regexp_extract("text", NUMBERED, 2), "\\.", -1))
    hits = blocks.withColumn("hit", F.rlike("text", F.lit(NUMBERED)) & headingish("text"))
    hits = hits.withColumn("depth", F.when(F.col("hit"), parts)).withColumn("weak", F.coalesce(F.col("hit") & (F.col("depth") == 1), F.lit(False)))
    runs = hits.withColumn("run", F.sum((~F.col("weak")).cast("int")).over(Window.partitionBy("doc_id").orderBy("idx")))
    in_run = Window.partitionBy("doc_id", "run", "weak")
    placed = runs.withColumn("p", F.row_number().over(in_run.orderBy("idx"))).withColumn("len", F.count(F.lit(1)).over(in_run))
    kept = placed.filter(F.col("hit") & ~(F.col("weak") & (F.col("p") % 2 == 0) & (F.col("p") < F.col("len"))))
    enough = kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter("n >= 3")
    return enough.select("doc_id", "idx", F.least("depth", F.lit(4)).cast("bigint").alias("level"), (F.col("depth") > 1).alias("strong"))


def tree(blocks: DataFrame, deepest: int = 6) -> DataFrame:
    """blocks(doc_id, idx, text, level; level null for body) -> doc_id, idx, text, level, section, parent, path. ``section`` is the
    heading that a block stands under (its own idx for a heading, null before the first one), ``parent`` the section above it, ``path``
    the titles down to it, empty ones left out. Levels may skip; those beyond ``deepest`` count as ``deepest``.

    A heading of level l is open as long as no later one has a level up to l, so the open ones are found with one last value for each
    level: all of them share one window, and nothing grows along a document."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("level").isNotNull(), F.greatest(F.lit(1), F.least("level", F.lit(deepest))))  # both skip nulls
    rows = blocks.select("doc_id", "idx", "text", here.alias("level"))
    seen = rows.select("*", *(F.last(F.when(F.col("level") == n, F.struct("idx", "text")), ignorenulls=True).over(w).alias(f"h{n}") for n in range(1, deepest + 1)))
    top = F.coalesce("level", F.lit(deepest + 1))
    above = [F.greatest(F.lit(-1), *(F.coalesce(F.col(f"h{m}.idx"), F.lit(-1)) for m in range(1, n))) if n > 1 else F.lit(-1) for n in range(1, deepest + 1)]
    stack = F.filter(F.array(*(F.when((F.lit(n) < top) & (F.col(f"h{n}.idx") > above[n - 1]), F.col(f"h{n}")) for n in range(1, deepest + 1))), lambda x: x.isNotNull())
    held = seen.select("doc_id", "idx", "text", "level", stack.alias("open"))
    titles = F.filter(F.transform("open", lambda x: x["text"]), lambda t: t != "")
    last, heading = F.get("open", F.size("open") - 1)["idx"], F.col("level").isNotNull()
    before = F.when(F.size("open") > 1, F.get("open", F.size("open") - 2)["idx"])
    path = F.array_join(F.when(heading & (F.col("text") != ""), F.concat(titles, F.array("text"))).otherwise(titles), " > ")
    return held.select("doc_id", "idx", "text", "level", F.when(heading, F.col("idx")).otherwise(last).alias("section"), F.when(heading, last).otherwise(before).alias("parent"), path.alias("path"))


def breadcrumbs(headings: DataFrame) -> DataFrame:
    """headings(doc_id, idx, level, title) -> doc_id, idx, level, title, path."""
    return tree(headings.withColumnRenamed("title", "text")).select("doc_id", "idx", "level", F.col("text").alias("title"), "path")


def learned_levels(votes: DataFrame) -> DataFrame:
    """format, style, level: styles with two votes or more of which the top level has 80 percent."""
    per = votes.groupBy("format", "style", "level").agg(F.sum("weight").alias("w"))
    by = Window.partitionBy("format", "style")
    ranked = per.withColumn("total", F.sum("w").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("w"), "level")))
    return ranked.filter((F.col("r") == 1) & (F.col("total") >= 2) & (F.col("w") * 10 >= F.col("total") * 8)).select("format", "style", "level")
