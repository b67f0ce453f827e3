"""Grading of runs and replay of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(text) -> Column:
    t = F.regexp_replace(F.lower(text), "(?<=[0-9]),(?=[0-9]{3})", "")
    return F.trim(F.regexp_replace(F.translate(t, "−’", "-'"), "\\s+", " "))


def has_all(text: Column, needles: Column) -> Column:
    return F.forall(needles, lambda n: F.contains(norm(text), norm(n)))


def outcomes(run: DataFrame) -> DataFrame:
    """run(id, answer_text, answered, answer array<array<string>> or null) -> id, outcome."""
    bare = F.regexp_replace("answer_text", "\\[[0-9]+\\]", "")
    right = F.exists("answer", lambda alt: has_all(bare, alt))
    return run.select(
        "id",
        F.when(F.col("answer").isNull(), F.when(F.col("answered"), "hallucinated").otherwise("refused")).when(~F.col("answered"), "refused").when(right, "correct").otherwise("wrong").alias("outcome"),
    )


def report(graded: DataFrame) -> DataFrame:
    """graded(set, outcome) -> a row per set and one for all, with precision over what was answered."""
    is_ = lambda o: F.sum((F.col("outcome") == o).cast("bigint"))
    sums = graded.rollup("set").agg(F.count(F.lit(1)).alias("n"), *(is_(o).alias(o) for o in ("correct", "wrong", "refused", "hallucinated")))
    precision = F.round(F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("hallucinated")), 6)
    return sums.select(F.coalesce("set", F.lit("ALL")).alias("set"), "n", "correct", "wrong", "refused", "hallucinated", precision.alias("precision"))


#: What a wrong or invented answer costs, in right ones.
COST = 3


def replay(run: DataFrame, relevance: list[float], support: list[float], verifier: list[float]) -> DataFrame:
    """run(relevance, support, verifier, good) -> relevance, support, verifier, n, score: for every cell of the grid (ascending
    thresholds) what is answered when each measure must reach its threshold, and right answers less COST times the others.

    A row falls into one bin, the number of thresholds it reaches on each axis; bins are counted with one shuffle, and a cell is
    the sum of the bins beyond it: three running sums over as many rows as the grid has bins. A missing relevance reaches every
    threshold, another missing measure none."""
    axes = {"relevance": relevance, "support": support, "verifier": verifier}
    reached = [F.aggregate(F.array(*(F.coalesce((F.col(a) >= t).cast("int"), F.lit(int(a == "relevance"))) for t in ts)), F.lit(0), lambda x, y: x + y).alias(f"b_{a}") for a, ts in axes.items()]
    value = F.when(F.col("good"), 1).otherwise(-COST).alias("score")
    bins = run.select(*reached, F.lit(1).alias("n"), value)
    edges = [F.explode(F.sequence(F.lit(0), F.lit(len(ts)))).alias(f"b_{a}") for a, ts in axes.items()]
    empty = run.sparkSession.range(1).select(edges[0]).select("*", edges[1]).select("*", edges[2]).select("*", F.lit(0).alias("n"), F.lit(0).alias("score"))
    cube = bins.groupBy(*(f"b_{a}" for a in axes)).agg(F.sum("n").alias("n"), F.sum("score").alias("score")).unionByName(empty).coalesce(1)  # no more rows than bins, twice
    cube = cube.groupBy(*(f"b_{a}" for a in axes)).agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
    for a in axes:
        beyond = Window.partitionBy(*(f"b_{x}" for x in axes if x != a)).orderBy(F.desc(f"b_{a}")).rowsBetween(Window.unboundedPreceding, 0)
        cube = cube.select(*(f"b_{x}" for x in axes), *(F.sum(c).over(beyond).alias(c) for c in ("n", "score")))
    at = [F.get(F.array(*(F.lit(float(t)) for t in ts)), F.col(f"b_{a}") - 1).alias(a) for a, ts in axes.items()]
    return cube.filter(" AND ".join(f"b_{a} > 0" for a in axes)).select(*at, F.col("n").cast("bigint").alias("n"), F.col("score").cast("bigint").alias("score"))


def choice(rows: DataFrame, labels: list[str]) -> DataFrame:
    """rows(req_id, token, logprob) -> req_id, label, p, a row for each label: the probabilities of stripped tokens, normalised; all
    alike where no token is a label."""
    token = F.trim("token")
    sums = rows.groupBy("req_id").agg(*(F.sum(F.when(token == x, F.exp("logprob")).otherwise(0.0)).alias(f"w{i}") for i, x in enumerate(labels)))
    total = sum((F.col(f"w{i}") for i in range(1, len(labels))), F.col("w0"))
    each = F.array(*(F.struct(F.lit(x).alias("label"), F.when(total > 0, F.col(f"w{i}") / total).otherwise(1.0 / len(labels)).alias("p")) for i, x in enumerate(labels)))
    return sums.select("req_id", F.explode(each).alias("x")).select("req_id", "x.*")
