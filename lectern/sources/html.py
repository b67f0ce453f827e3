"""Layout blocks of web pages: headings, paragraphs and list items in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "(?is)<(h[1-6]|p|li)(?:\\s[^>]*)?>(.*?)</\\1>"


def blocks(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> doc_id, idx, kind, level_hint, text."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(BLOCK), F.lit(2)).alias("body"))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("idx", "b"))
    tag = F.lower("b.tag")
    bare = F.trim(F.regexp_replace(F.regexp_replace("b.body", "<[^>]*>", " "), "\\s+", " "))
    kind = F.when(tag == "p", "para").when(tag == "li", "list_item").otherwise("heading")
    return rows.select("doc_id", "idx", kind.alias("kind"), F.when(F.startswith(tag, F.lit("h")), F.substring(tag, 2, 1).cast("int")).alias("level_hint"), bare.alias("text")).filter("text <> ''")
