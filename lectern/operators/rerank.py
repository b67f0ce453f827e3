"""Passages scored against questions, window by window.

A scorer takes rows (qid, id, question, passage) and gives them a ``score``. ``overlap`` is one made of column
expressions; ``batched`` makes one of a function over batches, for models. Long passages are scored in
windows and the largest score counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

# Characters of a window, from one start to the next, and windows of a passage.
WINDOW, STEP, WINDOWS = 1200, 800, 3
Scorer = Callable[[DataFrame], DataFrame]


def windows(text) -> Column:
    """Starts every STEP characters while more than a third of a window is left; short texts are one window."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.greatest(F.lit(1), F.least(F.lit(WINDOWS), F.ceil((F.length(t) - WINDOW // 3) / STEP))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * STEP + 1, F.lit(WINDOW)))
    return F.when(F.length(t) <= WINDOW, F.array(t)).otherwise(cut)


def overlap(rows: DataFrame) -> DataFrame:
    """Shared different words less one: relevant is what shares vocabulary."""
    met = F.array_intersect(T.words(F.lower("question")), T.words(F.lower("passage")))
    return rows.withColumn("score", F.size(met).cast("double") - 1)


def batched(score: Callable[[list[str], list[str]], list[float]]) -> Scorer:
    """A scorer of a function (questions, passages) -> scores that is called once a batch."""

    def scorer(rows: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pdf.assign(score=pd.Series(score(pdf.question.to_list(), pdf.passage.to_list()), index=pdf.index, dtype="float64"))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInPandas(run, f"{fields}, score double")

    return scorer


def rerank(pairs: DataFrame, scorer: Scorer = overlap) -> DataFrame:
    """pairs(qid, id, question, text) -> qid, id, score."""
    cut = pairs.select("qid", "id", "question", F.explode(windows("text")).alias("passage"))
    return scorer(cut).groupBy("qid", "id").agg(F.max("score").alias("score"))
