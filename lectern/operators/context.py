"""Packing of ranked hits into a character budget, and one hop along the reference graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

BUDGET, LEAST, WHOLE_WORDS = 9000, 400, 350


def pack(hits: DataFrame, sections: DataFrame, budget: int = BUDGET) -> DataFrame:
    """hits(qid, rank, section_id, text, score), sections(section_id, full) -> qid, n, section_id, whole,
    score, text. Sections come in order of their best hit: whole if short and fitting, else their hits;
    the text that exceeds the budget is cut, unless something is shown and little room is left."""
    listed = grouped(hits, sections)
    packed = listed.select("qid", F.posexplode(shown("g", F.lit(budget))["out"]).alias("i", "c"))
    return packed.select("qid", (F.col("i") + 1).cast("bigint").alias("n"), "c.*")


def grouped(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """qid, g: the sections of a question's hits by their best hit, with their whole text and the hits' texts."""
    part = hits.groupBy("qid", "section_id").agg(
        F.min("rank").alias("first"), F.max("score").alias("score"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("h")
    )
    joined = part.join(sections, "section_id").select(
        "qid",
        F.struct(
            "first", "section_id", "score", "full",
            (F.size(T.words("full")) <= WHOLE_WORDS).alias("short"),
            F.array_join(F.transform("h", lambda x: x["text"]), "\n\n").alias("some"),
        ).alias("g"),
    )
    return joined.groupBy("qid").agg(F.sort_array(F.collect_list("g")).alias("g"))


def shown(groups, budget: Column) -> Column:
    """struct(left, stop, out): what of ``grouped`` fits, and the budget that is left. A question has a handful of groups."""
    row = "struct<section_id:bigint,whole:boolean,score:double,text:string>"
    state = f"struct<left:int,stop:boolean,out:array<{row}>>"
    start = F.struct(budget.cast("int").alias("left"), F.lit(False).alias("stop"), F.array().cast(f"array<{row}>").alias("out")).cast(state)

    def step(a: Column, g: Column) -> Column:
        whole = g["short"] & (F.length(g["full"]) <= a["left"])
        text = F.when(whole, g["full"]).otherwise(g["some"])
        stop = a["stop"] | (a["left"] <= 0) | ((F.length(text) > a["left"]) & (F.size(a["out"]) > 0) & (a["left"] < LEAST))
        cut = F.substring(text, F.lit(1), F.greatest(a["left"], F.lit(0)))
        one = F.struct(g["section_id"].cast("bigint").alias("section_id"), whole.alias("whole"), g["score"].cast("double").alias("score"), cut.alias("text"))
        return F.when(stop, F.struct(a["left"].alias("left"), F.lit(True).alias("stop"), a["out"].alias("out")).cast(state)).otherwise(
            F.struct((a["left"] - F.length(cut)).alias("left"), F.lit(False).alias("stop"), F.concat(a["out"], F.array(one)).alias("out")).cast(state)
        )

    return F.aggregate(groups, start, step)


def follow(hits: DataFrame, edges: DataFrame, seeds: int = 3, most: int = 3) -> DataFrame:
    """hits(qid, rank, chunk_id), edges(src, dst, label) -> qid, chunk_id, via: one hop from the first
    hits, cited before citing, nothing that is a hit already."""
    top = hits.filter(F.col("rank") <= seeds)
    out = top.join(edges, F.col("chunk_id") == F.col("src")).select("qid", "rank", F.lit(0).alias("way"), F.col("dst").alias("to"), F.format_string('cited as "%s" in [%d]', "label", "rank").alias("via"))
    into = top.join(edges, F.col("chunk_id") == F.col("dst")).select("qid", "rank", F.lit(1).alias("way"), F.col("src").alias("to"), F.format_string('cites [%d] as "%s"', "rank", "label").alias("via"))
    new = out.unionByName(into).withColumnRenamed("to", "chunk_id").join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    first = new.withColumn("r", F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("way", "rank", "via"))).filter("r = 1")
    order = Window.partitionBy("qid").orderBy("way", "rank", "chunk_id")
    return first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("qid", "chunk_id", "via", "n")
