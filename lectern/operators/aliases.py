"""Names under which other documents may cite a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import STOPWORDS

LEAST = 4
# First words of titles that name nothing, and site names after a dash.
GENERIC = "(?i)^(chapter|capitolo|slide|heading|sheet|foglio|untitled|document|documento|sezione|section|table|tabella|figure|figura)(?![\\p{L}\\p{N}_])"
SITE = "(?i)\\s+[-–—|]\\s+(wikipedia|wikipédia|treccani|britannica|arxiv)(?![\\p{L}\\p{N}_]).*$"


def names(docs: DataFrame, every: bool = False) -> DataFrame:
    """docs(doc_id, title, path) -> doc_id, alias, exact: names that a text may cite. Names of several
    words are lower-cased and match in any case; one word must be capitalised and either qualified
    (something was cut off the title) or of irregular case. Of documents with one name the first wins, unless
    ``every`` one is asked for."""
    bare = F.regexp_replace("title", SITE, "")
    paren = F.filter(F.transform(F.regexp_extract_all(bare, F.lit("\\(([^)]*)\\)"), F.lit(1)), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit("\\p{Lu}")))
    plain = F.trim(F.regexp_replace(bare, "\\s*\\([^)]*\\)", ""))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*?)(?:\\.[^./]*)?$", 1), "[_\\-\\s]+", " ")
    offered = F.concat(
        F.array(F.struct(plain.alias("name"), ((bare != F.col("title")) | F.contains("title", F.lit("("))).alias("qualified"))),
        F.transform(paren, lambda x: F.struct(x.alias("name"), F.lit(True).alias("qualified"))),
        F.filter(F.array(F.struct(F.trim(stem).alias("name"), F.lit(True).alias("qualified"))), lambda x: F.size(F.split(x["name"], " ")) >= 3),
    )
    one_space = F.trim(F.regexp_replace("o.name", "\\s+", " "))
    rows = docs.select("doc_id", F.explode(offered).alias("o")).select("doc_id", one_space.alias("name"), "o.qualified")
    rows = rows.filter((F.length("name") >= LEAST) & F.rlike("name", F.lit("\\p{L}")) & ~F.contains("name", F.lit("�")) & ~F.rlike("name", F.lit(GENERIC)))
    many = F.contains("name", F.lit(" "))
    single = ~F.lower("name").isin(*STOPWORDS) & F.rlike("name", F.lit("^\\p{Lu}")) & (F.col("qualified") | ~F.rlike("name", F.lit("^\\p{Lu}\\p{Ll}*$")))
    kept = rows.filter(many | single).select("doc_id", F.when(many, F.lower("name")).otherwise(F.col("name")).alias("alias"), (~many).alias("exact"))
    if every:
        return kept.distinct()
    first = kept.withColumn("r", F.row_number().over(Window.partitionBy("alias").orderBy("doc_id"))).filter("r = 1")
    return first.select("doc_id", "alias", "exact")

