"""The structure cascade: which blocks are headings, at what level, and how sure that is.

Blocks: doc_id, idx, kind (para, list_item, heading, table, image), text, level_hint, size, bold, style,
format. Every rule is a set of windows and aggregates per document; nothing is iterated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.structure import NUMBERED, headingish

# Limits and words of the rules.
LARGER, GAP, BODY_LIKE = 1.05, 0.75, 0.5
SHARE, SHARE_BLOCKS = 0.6, 20
LEVELS, LONG_WORDS, SHAPE_WORDS, NUMBERED_HITS = 4, 800, 10, 3
KEYWORD = "(?i)^(chapter|capitolo|section|sezione|part|parte|appendix|appendice|allegato|articolo|art\\.)\\s+([0-9]+|[ivxlc]+|[a-z])\\b"


def by_doc():
    return Window.partitionBy("doc_id")


def _n_words(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.trim(text), "\\s+"), ""))


def eligible() -> Column:
    """A paragraph or list item without a hint that looks like a heading."""
    return F.col("kind").isin("para", "list_item") & F.col("level_hint").isNull() & headingish("text")


def body(blocks: DataFrame) -> DataFrame:
    """doc_id, body_size, body_style, body_bold: the size that most characters of paragraphs have (half points), and the style of
    most characters of paragraphs and list items without a hint."""
    n = F.length("text")
    sized = blocks.filter("kind = 'para' AND size > 0").groupBy("doc_id", (F.round(F.col("size") * 2) / 2).alias("s")).agg(F.sum(n).alias("w"), F.min("idx").alias("first"))
    styled = blocks.filter("kind IN ('para', 'list_item') AND level_hint IS NULL").groupBy("doc_id", "style", "bold").agg(F.sum(n).alias("w"), F.min("idx").alias("first"))
    most = lambda df, *cols: df.groupBy("doc_id").agg(F.max_by(F.struct(*cols), F.struct("w", -F.col("first"))).alias("x"))
    size = most(sized, "s").select("doc_id", F.col("x.s").alias("body_size"))
    style = most(styled, "style", "bold").select("doc_id", F.col("x.style").alias("body_style"), F.col("x.bold").alias("body_bold"))
    return blocks.select("doc_id").distinct().join(size, "doc_id", "left").join(style, "doc_id", "left")


def numbered(blocks: DataFrame) -> DataFrame:
    """doc_id, idx, level, strong by heading numbers and key words; inside a run of weak hits every second one that is not the
    last goes, and a document needs NUMBERED_HITS."""
    word = F.lower(F.regexp_extract("text", KEYWORD, 1))
    depth = F.size(F.split(F.regexp_extract("text", NUMBERED, 2), "\\.", -1))
    keyed, counted = eligible() & (word != ""), eligible() & F.rlike("text", F.lit(NUMBERED))
    hits = blocks.select(
        "doc_id", "idx", (keyed | counted).alias("hit"), (keyed | (depth > 1)).alias("strong"),
        F.when(keyed, F.when(word.startswith("art"), 2).otherwise(1)).otherwise(F.least(depth, F.lit(LEVELS))).cast("bigint").alias("level"),
    )
    hits = hits.withColumn("weak", F.col("hit") & ~F.col("strong"))
    runs = hits.withColumn("run", F.sum((~F.col("weak")).cast("int")).over(by_doc().orderBy("idx")))
    run = Window.partitionBy("doc_id", "run", "weak")
    placed = runs.withColumn("p", F.row_number().over(run.orderBy("idx"))).withColumn("len", F.count(F.lit(1)).over(run))
    kept = placed.filter(F.col("hit") & ~(F.col("weak") & (F.col("p") % 2 == 0) & (F.col("p") < F.col("len"))))
    return kept.withColumn("n", F.count(F.lit(1)).over(by_doc())).filter(F.col("n") >= NUMBERED_HITS).select("doc_id", "idx", "level", "strong")


def typography(blocks: DataFrame, of: DataFrame) -> DataFrame:
    """doc_id, idx, level, strong: larger than the document's body, or bold where the body is not."""
    rows = blocks.join(of, "doc_id").withColumn("all", F.count(F.lit(1)).over(by_doc()))
    known = (F.col("size") > 0) & (F.col("body_size") > 0)
    strong = F.coalesce(known & (F.col("size") >= F.col("body_size") * LARGER) & (F.col("size") - F.col("body_size") >= GAP), F.lit(False))
    like = F.coalesce(~known | (F.abs(F.col("size") - F.col("body_size")) <= BODY_LIKE), F.lit(True))
    weak = F.coalesce(F.col("bold"), F.lit(False)) & ~F.coalesce(F.col("body_bold"), F.lit(False)) & like
    found = rows.filter(eligible()).withColumn("strong", strong).filter(F.col("strong") | weak)
    found = found.withColumn("n", F.count(F.lit(1)).over(by_doc())).withColumn("weak_n", F.sum((~F.col("strong")).cast("int")).over(by_doc()))
    crowded = lambda n: (F.col("all") >= SHARE_BLOCKS) & (F.col(n) / F.col("all") > SHARE)
    kept = found.filter(~crowded("n") & (F.col("strong") | ~crowded("weak_n")))
    rank = F.dense_rank().over(by_doc().orderBy(F.desc(F.bround(F.coalesce("size", F.lit(0.0)))), F.desc("strong")))
    return kept.select("doc_id", "idx", F.least(rank, F.lit(LEVELS)).cast("bigint").alias("level"), "strong")


def shape(blocks: DataFrame) -> DataFrame:
    """doc_id, idx, level, strong: short lines before a block at least three times as long."""
    following = blocks.withColumn("next", F.lead(F.length("text")).over(by_doc().orderBy("idx")))
    n_letters = F.length(F.regexp_replace("text", "[^\\p{L}]", ""))
    capitals = F.length(F.regexp_replace("text", "[^\\p{Lu}]", ""))
    found = following.filter(eligible() & (_n_words("text") <= SHAPE_WORDS) & (F.col("next") >= 3 * F.length("text")))
    return found.select("doc_id", "idx", F.lit(1).cast("bigint").alias("level"), ((n_letters >= 4) & (capitals > 0.8 * n_letters)).alias("strong"))


def infer(blocks: DataFrame, profile: DataFrame | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(levels: doc_id, idx, level, ambiguous; verdicts: doc_id, strategy, confidence). profile: format, style, level (see
    ``structure.learned_levels``); overrides: doc_id, text, level, where 0 says body."""
    facts = blocks.groupBy("doc_id").agg(
        F.first("format").alias("form"), F.count("level_hint").alias("hints"), F.sum(_n_words("text")).alias("words")
    )
    slides = F.col("form").isin("pptx", "xlsx") & (F.col("hints") > 0)
    facts = facts.withColumn("hinted", slides | (F.col("hints") >= 2) | ((F.col("hints") == 1) & (F.col("words") < LONG_WORDS))).withColumn("pdf", F.col("form") == "pdf")

    rows = blocks.select("doc_id", "idx", "text", "level_hint", "format", "style", eligible().alias("able")).join(facts, "doc_id")
    if profile is not None:
        learned = profile.select("format", "style", F.col("level").alias("learned"))
        rows = rows.join(learned, ["format", "style"], "left").withColumn("learned", F.when(F.col("able") & (F.col("learned") > 0), F.col("learned")))
    else:
        rows = rows.withColumn("learned", F.lit(None).cast("bigint"))
    side = lambda df, tag: df.select("doc_id", "idx", F.struct("level", "strong").alias(tag))
    rows = (
        rows.join(side(numbered(blocks), "num"), ["doc_id", "idx"], "left")
        .join(side(typography(blocks, body(blocks)), "typ"), ["doc_id", "idx"], "left")
        .join(side(shape(blocks), "shp"), ["doc_id", "idx"], "left")
    )
    has = lambda c: F.max(F.col(c).isNotNull()).over(by_doc())
    rows = rows.select("*", has("num").alias("any_num"), has("typ").alias("any_typ"), has("shp").alias("any_shp"), has("learned").alias("any_learned"))
    fallback = ~F.col("any_num") & ~F.col("any_typ") & ((F.col("words") >= LONG_WORDS) | F.col("pdf"))
    explicit, by_profile = F.col("hinted") & ~F.col("pdf"), F.col("any_learned")
    cand = F.coalesce("num", "typ", F.when(fallback, F.col("shp")))
    rows = rows.withColumn("explicit", explicit).withColumn("cand", F.when(~explicit & ~by_profile, cand))
    used = F.col("cand").isNotNull() & (~F.col("hinted") | F.col("cand.strong"))
    level = F.when(~explicit & by_profile, F.col("learned")).when(used, F.col("cand.level")).otherwise(F.col("level_hint").cast("bigint"))
    rows = rows.withColumn("level", level).withColumn("ambiguous", F.coalesce(used & ~F.col("cand.strong"), F.lit(False)))
    verdicts = rows.groupBy("doc_id").agg(
        *(F.first(c).alias(c) for c in ("explicit", "hinted", "any_learned", "any_num", "any_typ", "words")),
        F.count("cand").alias("cands"), F.sum(F.col("ambiguous").cast("int")).alias("unsure"),
    )
    rule = F.when(F.col("any_num") & F.col("any_typ"), "numbering+typography").when(F.col("any_num"), "numbering").when(F.col("any_typ"), "typography").otherwise("shape")
    strategy = (
        F.when(F.col("explicit"), "explicit").when(F.col("any_learned"), "profile")
        .when(F.col("hinted"), F.when(F.col("cands") > 0, F.concat(F.lit("outline+"), rule)).otherwise("explicit"))
        .when(F.col("cands") == 0, "none").otherwise(rule)
    )
    confidence = (
        F.when(F.col("explicit"), 0.95).when(F.col("any_learned") | F.col("hinted"), 0.9)
        .when(F.col("cands") == 0, F.when(F.col("words") >= LONG_WORDS, 0.2).otherwise(0.6))
        .when(F.col("unsure") == 0, 0.85).otherwise(F.greatest(F.lit(0.3), 0.85 - 0.5 * F.col("unsure") / F.col("cands")))
    )
    levels = rows.select("doc_id", "idx", "text", "level", "ambiguous")
    if overrides is not None:
        said = overrides.select("doc_id", "text", F.col("level").cast("bigint").alias("said"))
        ruled = levels.join(said, ["doc_id", "text"], "left")
        levels = ruled.withColumn("level", F.when(F.col("said").isNull(), F.col("level")).otherwise(F.nullif("said", F.lit(0)))).withColumn("ambiguous", F.col("ambiguous") & F.col("said").isNull())
    return levels.select("doc_id", "idx", "level", "ambiguous"), verdicts.select("doc_id", strategy.alias("strategy"), confidence.cast("double").alias("confidence"))


def outline_before(blocks: DataFrame, levels: DataFrame, last: int = 12) -> DataFrame:
    """doc_id, idx, outline: of each ambiguous candidate, the texts of the last headings before it."""
    rows = blocks.select("doc_id", "idx", "text").join(levels, ["doc_id", "idx"])
    sure = F.when(F.col("level").isNotNull() & ~F.col("ambiguous"), F.col("text"))
    before = F.collect_list(sure).over(by_doc().orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("outline", F.slice(before, F.greatest(F.size(before) - last + 1, F.lit(1)), F.lit(last))).filter("ambiguous").select("doc_id", "idx", "outline")
