"""Chunks of a section: lines packed to a word target, tables cut by rows under a repeated header, figures alone.

Blocks: section_id, idx, kind, text, loc, rows array<array<string>>, header (index of a table's header row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import chunks

# Words that a chunk aims at, and rows of a table's chunk.
TARGET_WORDS, TABLE_ROWS = 180, 20


def row_text(cells: Column) -> Column:
    """A Markdown table row; pipes in cells are escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def _words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(text), "\\s+"), ""))


def table_chunks(tables: DataFrame) -> DataFrame:
    """section_id, idx, part, text, loc. A chunk takes TABLE_ROWS rows, or half of that, again and again, until its words fit; rows
    before the header stand in the first chunk, and a table of a header only is one chunk."""
    data = F.slice("rows", F.col("header") + 2, F.greatest(F.size("rows"), F.lit(1)))
    rows = tables.select("section_id", "idx", "loc", F.get("rows", F.col("header")).alias("names"), F.slice("rows", F.lit(1), F.col("header")).alias("preamble"), data.alias("data"))
    sizes = F.transform("data", lambda r: F.coalesce(_words(F.array_join(r, " ")), F.lit(0)))
    steps = [TABLE_ROWS >> i for i in range(TABLE_ROWS.bit_length())]
    state = "struct<until:int,out:array<struct<a:int,n:int>>>"

    def step(a: Column, i: Column) -> Column:
        fits = lambda s: F.aggregate(F.slice(F.col("sizes"), i + 1, F.lit(s)), F.lit(0), lambda x, y: x + y) <= chunks.MAX_WORDS
        take = F.coalesce(*(F.when(fits(s), F.lit(s)) for s in steps[:-1]), F.lit(1))
        took = F.least(take, F.size("sizes") - i)
        fresh = F.struct((i + took).alias("until"), F.concat(a["out"], F.array(F.struct(i.alias("a"), took.alias("n")))).alias("out")).cast(state)
        return F.when(i < a["until"], a).otherwise(fresh)

    start = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<a:int,n:int>>").alias("out")).cast(state)
    none = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("n")))
    cut = rows.withColumn("sizes", sizes).withColumn(
        "cuts", F.when(F.size("data") == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("data") - 1, F.lit(0))), start, step, lambda a: a["out"]))
    )
    each = cut.select("*", F.posexplode("cuts").alias("part", "c"))
    rule = F.transform("names", lambda _: F.lit("---"))
    mine = F.transform(F.slice("data", F.col("c.a") + 1, F.col("c.n")), row_text)
    lead = F.transform("preamble", lambda r: F.array_join(F.filter(r, lambda c: c != ""), " "))
    lines = F.concat(F.when(F.col("part") == 0, lead).otherwise(F.array().cast("array<string>")), F.array(row_text(F.col("names")), row_text(rule)), mine)
    loc = F.when(F.col("c.n") == 0, F.col("loc")).otherwise(F.concat("loc", F.lit(" rows "), F.col("c.a") + 1, F.lit("-"), F.col("c.a") + F.col("c.n")))
    return each.select("section_id", "idx", F.col("part").cast("bigint").alias("part"), F.array_join(lines, "\n").alias("text"), loc.alias("loc"))


def chunk(blocks: DataFrame) -> DataFrame:
    """section_id, ordinal, kind (text, table, image), text, loc. Lines are packed in order until the next one would pass TARGET_WORDS;
    tables and figures end a chunk, long lines are split first."""
    line = F.when(F.col("kind") == "list_item", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    lines = blocks.filter("kind <> 'table'").select("section_id", "idx", F.when(F.col("kind") == "image", "image").otherwise("text").alias("kind"), "loc", line.alias("text"))
    short = lines.filter(_words(F.col("text")) <= chunks.MAX_WORDS).select("*", F.lit(0).cast("bigint").alias("part"))
    long = lines.filter(_words(F.col("text")) > chunks.MAX_WORDS).withColumn("doc_id", F.struct("section_id", "idx", "kind", "loc"))
    split = chunks.pack(long).select("doc_id.*", "text", F.col("ordinal").alias("part"))
    pieces = short.unionByName(split)
    # A run of lines ends where a table or a figure stands between.
    stops = blocks.filter("kind IN ('table', 'image')").select("section_id", "idx", F.lit(True).alias("stop")).distinct()
    placed = pieces.filter("kind = 'text'").select("section_id", "idx", "part", "text", "loc", F.lit(False).alias("stop")).unionByName(
        stops.select("section_id", "idx", F.lit(-1).cast("bigint").alias("part"), F.lit("").alias("text"), F.lit("").alias("loc"), "stop")
    )
    order = Window.partitionBy("section_id").orderBy("idx", "part")
    runs = placed.withColumn("run", F.sum(F.col("stop").cast("int")).over(order)).filter("NOT stop")
    held = runs.groupBy("section_id", "run").agg(F.sort_array(F.collect_list(F.struct("idx", "part", "text", "loc"))).alias("p"))
    bins = chunks.greedy_bins(F.transform("p", lambda x: _words(x["text"])), TARGET_WORDS)
    binned = held.select("section_id", F.explode(F.arrays_zip(F.col("p"), bins.alias("b"))).alias("z"), "run").select("section_id", "run", "z.b", "z.p")
    packed = binned.groupBy("section_id", "run", "b").agg(F.sort_array(F.collect_list("p")).alias("p"))
    first_loc = F.element_at(F.filter(F.concat(F.transform("p", lambda x: x["loc"]), F.array(F.lit(""))), lambda x: x != ""), 1)
    text = packed.select("section_id", F.col("p")[0]["idx"].alias("idx"), F.col("p")[0]["part"].alias("part"), F.lit("text").alias("kind"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.coalesce(F.when(F.size(F.filter("p", lambda x: x["loc"] != "")) > 0, first_loc), F.lit("")).alias("loc"))
    tables = table_chunks(blocks.filter("kind = 'table'").select("section_id", "idx", "loc", "rows", "header")).select("section_id", "idx", "part", F.lit("table").alias("kind"), "text", "loc")
    images = pieces.filter("kind = 'image'").select("section_id", "idx", "part", "kind", "text", "loc")
    ordinal = F.row_number().over(Window.partitionBy("section_id").orderBy("idx", "part")) - 1
    return text.unionByName(tables).unionByName(images).select("section_id", ordinal.cast("bigint").alias("ordinal"), "kind", "text", "loc")
