"""Text lines of PDF pages (doc_id, page, text, size, bold, y0, y1, page_height) to blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND, REPEAT = 0.08, 0.4
PAGE_NUMBER = "(?i)^\\W*(?:page|pagina|pag\\.?)?\\s*[0-9]{1,4}(?:\\s*(?:/|of|di)\\s*[0-9]{1,4})?\\W*$"


def norm(text):
    return F.regexp_replace(F.trim(F.lower(text)), "[0-9]+", "#")


def stamps(lines: DataFrame) -> DataFrame:
    """Without lines of single characters, set along an edge."""
    return lines.filter(~F.forall(F.split(F.trim("text"), "\\s+"), lambda t: F.length(t) == 1))


def boilerplate(lines: DataFrame) -> DataFrame:
    """Lines without page numbers and without what the edge bands of many pages repeat."""
    edge = (F.col("y1") > F.col("page_height") * (1 - BAND)) | (F.col("y0") < F.col("page_height") * BAND)
    marked = lines.withColumn("edge", edge).withColumn("norm", norm(F.col("text")))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    repeats = marked.filter("edge").groupBy("doc_id", "norm").agg(F.countDistinct("page").alias("on"))
    joined = marked.join(pages, "doc_id").join(repeats, ["doc_id", "norm"], "left")
    often = F.coalesce(F.col("on") >= F.greatest(F.lit(2.0), F.col("pages") * REPEAT), F.lit(False))
    return joined.filter(~(F.col("edge") & (often | F.rlike("text", F.lit(PAGE_NUMBER))))).select(*lines.columns)


def merge(lines: DataFrame) -> DataFrame:
    """doc_id, page, idx, size, bold, text: lines of one box and style are one block; a hyphen before a
    lower-case letter is undone."""
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    before = lambda c: F.lag(c).over(order)
    cut = (before("box") != F.col("box")) | (before("page") != F.col("page")) | (F.abs(before("size") - F.col("size")) > 0.5) | (before("bold") != F.col("bold")) | F.rlike("text", F.lit("^\\s*[•▪‣\\-–]\\s"))
    groups = lines.withColumn("idx", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(order))
    joined = groups.groupBy("doc_id", "idx").agg(F.min("page").alias("page"), F.max("size").alias("size"), F.max("bold").alias("bold"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    text = F.regexp_replace(F.array_join(F.transform("l", lambda x: F.trim(x["text"])), "\n"), "(?<=\\p{L})-\\n(?=\\p{Ll})", "")
    return joined.select("doc_id", "page", "idx", "size", "bold", F.regexp_replace(text, "\\n", " ").alias("text"))


def scanned(lines: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, page of pages with little text."""
    return lines.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars")).filter(F.col("chars") < least).select("doc_id", "page")
