"""License scans by diagonal voting (native: DataFrame functions only).

The documents' rolling k-gram hashes are joined to the positions of the templates' k-grams. A hit at
word i of the document and word j of the template votes for the diagonal i - j. Votes are aggregated
by diagonal, neighbouring diagonals (a word more or less in the document) are merged, and a merged
span is verified by the share of the template's k-grams that it holds. A template of the base list
counts only where one diagonal holds all of its k-grams, that is, where its words stand consecutively.

The join is a broadcast of the template table, whose size is fixed by this file (checked below);
nearly all k-grams end there, before anything is shuffled. One extra row per document, the marker,
passes the join, so that documents without a hit keep their row without a second scan of the texts.

Defined results: null texts are empty and have no words; identical rows (same id and text) each get
a row; rows with the same id and other texts are judged one by one; an empty table gives no rows; only
the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import let, lower_ascii

#: Separators of words, once A-Z is lower-cased.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
K = 3
#: Merge diagonals that are at most so many words apart.
NEAR = 3
#: A merged span must hold this share of its template's k-grams, in percent.
SHARE = 60
MARK = -1

# License phrases and notices, with their labels. The first list counts consecutive
# words only; the second tolerates edits.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
TEMPLATES = tuple((label, phrase.split(), True) for label, phrase in PHRASES) + tuple(
    (label, notice.split(), False) for label, notice in NOTICES
)
#: The mask of a template's k-grams is one bigint.
assert all(K <= len(words) <= 62 + K for _, words, _ in TEMPLATES)


def template_grams() -> list[tuple[int, int, str, str, str]]:
    return [
        (t, j, *words[j : j + K]) for t, (_, words, _) in enumerate(TEMPLATES) for j in range(len(words) - K + 1)
    ]


def template_table(spark: SparkSession) -> DataFrame:
    """gram, tid, tpos; the marker included. At most 62 rows a template."""
    values = ", ".join(f"(xxhash64('{a}', '{b}', '{c}'), {t}, {j})" for t, j, a, b, c in template_grams())
    return spark.sql(f"SELECT * FROM VALUES ({MARK}L, {MARK}, 0), {values} AS t(gram, tid, tpos)")


def grams(words: Column) -> Column:
    """Hashes of all runs of K words."""
    return F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1),
        F.greatest(F.size(words) - (K - 1), F.lit(0)),
    )


def diagonals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, tid, diag, mask (bit j: k-gram j of the template), n."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(lower_ascii(text), BREAK), "")
    read = df.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        let(words, lambda w: F.struct(F.size(w).alias("n"), F.concat(F.array(F.lit(MARK).cast("bigint")), grams(w)).alias("g"))).alias("w"),
    )
    # The outer form: the plain one makes the optimizer evaluate the array once more, for a filter.
    # The array is taken out of the struct first: a field beside it would carry it into every row.
    flat = read.select("doc_id", "text_hash", F.col("w.n").cast("bigint").alias("n_words"), F.col("w.g").alias("g"))
    exploded = flat.select("doc_id", "text_hash", "n_words", F.posexplode_outer("g").alias("pos", "gram"))
    hits = exploded.join(F.broadcast(template_table(df.sparkSession)), "gram")
    hits = hits.filter((F.col("tid") != MARK) | (F.col("pos") == 0))
    return hits.groupBy(
        "doc_id", "text_hash", "n_words", "tid", (F.col("pos") - 1 - F.col("tpos")).alias("diag")
    ).agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"), F.count(F.lit(1)).alias("n"))


def _by_template(field: str) -> Column:
    values = {
        "full": [(1 << (len(w) - K + 1)) - 1 for _, w, _ in TEMPLATES],
        "grams": [len(w) - K + 1 for _, w, _ in TEMPLATES],
        "label": [label for label, _, _ in TEMPLATES],
        "base": [b for _, _, b in TEMPLATES],
    }[field]
    return F.array(*(F.lit(v) if field != "full" else F.lit(v).cast("bigint") for v in values))


def _merge(hits: Column) -> Column:
    """Sorted (tid, diag, mask) -> spans (tid, first, last, mask), neighbours merged."""
    span = "array<struct<tid:int,first:int,last:int,mask:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["tid"].alias("tid"), last["first"].alias("first"), x["diag"].alias("last"), last["mask"].bitwiseOR(x["mask"]).alias("mask")
        )
        fresh = F.struct(x["tid"].alias("tid"), x["diag"].alias("first"), x["diag"].alias("last"), x["mask"].alias("mask"))
        near = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["tid"] == x["tid"]) & (x["diag"] - F.try_element_at(acc, F.lit(-1))["last"] <= NEAR)
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(hits, F.array().cast(span), lambda acc, x: step(acc, x).cast(span))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places array<struct<tid,first>> of base phrases, spans of notices with their
    share of the template, labels. One row for each input row."""
    voted = diagonals(df, id_col, text_col)
    per_doc = voted.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sort_array(F.collect_list(F.when(F.col("tid") != MARK, F.struct("tid", "diag", "mask")))).alias("hits"),
        F.max(F.when(F.col("tid") == MARK, F.col("n"))).alias("copies"),
    )
    at = lambda field, tid: F.element_at(_by_template(field), tid + 1)
    whole = F.filter("hits", lambda x: at("base", x["tid"]) & (x["mask"] == at("full", x["tid"])))
    near = F.filter("hits", lambda x: ~at("base", x["tid"]))
    out = per_doc.select("doc_id", "n_words", "copies", whole.alias("places"), _merge(near).alias("merged")).select(
        "doc_id",
        "n_words",
        "copies",
        F.transform("places", lambda x: F.struct(at("label", x["tid"]).alias("label"), x["diag"].alias("first"))).alias("places"),
        F.transform(
            "merged",
            lambda s: F.struct(
                at("label", s["tid"]).alias("label"),
                s["first"].alias("first"),
                s["last"].alias("last"),
                F.bit_count(s["mask"]).cast("bigint").alias("votes"),
                at("grams", s["tid"]).cast("bigint").alias("grams"),
            ),
        ).alias("spans"),
    )
    good = F.filter("spans", lambda s: s["votes"] * 100 >= s["grams"] * SHARE)
    return (
        out.withColumn("spans", good)
        .withColumn("base_labels", F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"]))))
        .withColumn("labels", F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"])))))
        .withColumn(
            "score",
            F.when(F.size("places") > 0, F.lit(1.0)).otherwise(
                F.coalesce(F.array_max(F.transform("spans", lambda s: s["votes"].cast("double") / s["grams"].cast("double"))), F.lit(0.0))
            ),
        )
        .withColumn("copy", F.explode_outer(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .drop("copies", "copy")
    )
