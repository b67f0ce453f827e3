"""Summary cards of sections and documents, and dominant typography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def section_cards(sections: DataFrame) -> DataFrame:
    """sections(doc_id, ordinal, parent, title, text) -> doc_id, ordinal, card: the first 60 words and up
    to ten titles of children."""
    kids = sections.filter("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("ordinal")).agg(F.sort_array(F.collect_list(F.struct(F.col("ordinal").alias("o"), "title"))).alias("k"))
    names = F.array_join(F.transform(F.slice("k", 1, 10), lambda x: x["title"]), "; ")
    card = F.concat_ws("\n", F.nullif(T.lead("text", 60), F.lit("")), F.concat(F.lit("Subsections: "), names))
    return sections.join(kids, ["doc_id", "ordinal"], "left").select("doc_id", "ordinal", card.alias("card"))


def document_cards(sections: DataFrame) -> DataFrame:
    """doc_id, card: the first 120 words of the first section with text, and an outline of up to 25
    titles of levels one and two."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    first = sections.filter("text <> ''").withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc_id", T.lead("text", 120).alias("lead"))
    outline = sections.filter("level BETWEEN 1 AND 2 AND title <> ''").withColumn("r", F.row_number().over(w)).filter("r <= 25")
    titles = outline.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "title"))), lambda x: x["title"]), "; ").alias("o"))
    card = F.concat_ws("\n", "lead", F.concat(F.lit("Outline: "), F.col("o")))
    return sections.select("doc_id").distinct().join(first, "doc_id", "left").join(titles, "doc_id", "left").select("doc_id", card.alias("card"))


def style_key(size, bold, style) -> Column:
    return F.concat_ws("|", F.bround(F.coalesce(size, F.lit(0.0))).cast("int").cast("string"), bold.cast("int").cast("string"), F.coalesce(style, F.lit("")))


def dominant_style(blocks: DataFrame) -> DataFrame:
    """doc_id, style: the one that covers most characters; of equals the one seen first."""
    sums = blocks.groupBy("doc_id", "style").agg(F.sum(F.length("text")).alias("c"), F.min("idx").alias("i"))
    return sums.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), "i"))).filter("r = 1").select("doc_id", "style")
