"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. The exponent is bisected (many
sections of the interval in one aggregate each) until the weights' entropy reaches the target share of
ln(number of sources) or, if that would repeat a source more often than allowed, until the repetition
limit holds. The weights are realised over a token budget as permutations in blocks: a source's
documents are dealt into blocks by a hash, blocks are taken in order, documents inside a block by hash;
a source's budget is whole passes over its permutation and the longest prefix that fits.

Cumulative sums are two-level (blocks of a source, documents of a block), so a source with a third of
all rows is never summed in one task. Source totals and block totals are tables, nothing is collected
but the exponent.

Defined results: rows without a source form the source ''; null and empty texts have no tokens: they
come with every whole pass and with the prefix that reaches them; repeated rows are documents each, in
one place of the permutation if they are identical; with a single source, or none, alpha is 1; empty
tables give no rows; other columns are carried along whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, read, written


@dataclass(frozen=True)
class Mix:
    entropy: float = 0.95  # of ln(sources)
    repeat: float = 4.0  # passes over a source at most
    budget: float = 1.0  # times all tokens
    block_rows: int = 4096
    sections: int = 32
    rounds: int = 6
    seed: int = 7


def exponent(totals: DataFrame, how: Mix) -> float:
    """The largest alpha in [0, 1] whose entropy reaches the target, raised until no source is
    repeated more than ``how.repeat`` times. totals: source, tokens."""
    live = totals.filter("tokens > 0")
    base = live.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.min("tokens").alias("least")).first()
    if not base.n or base.n < 2:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(how.rounds):
        grid = [low + (high - low) * i / how.sections for i in range(how.sections + 1)]
        share = F.ln(F.col("tokens") / F.lit(float(base.t)))
        sums = live.agg(*(F.sum(F.exp(share * a)).alias(f"z{i}") for i, a in enumerate(grid)), *(F.sum(F.exp(share * a) * share * a).alias(f"e{i}") for i, a in enumerate(grid))).first()
        rare = math.log(base.least / base.t)
        ok = []
        for i, a in enumerate(grid):
            z, e = sums[f"z{i}"], sums[f"e{i}"]
            entropy = math.log(z) - e / z
            passes = math.exp(rare * (a - 1)) / z * how.budget  # of the smallest source
            ok.append((entropy >= how.entropy * math.log(base.n), passes <= how.repeat))
        # Entropy falls with alpha, the repetition of the smallest source does as well.
        reach = max((i for i, (e, _) in enumerate(ok) if e), default=0)
        allowed = min((i for i, (_, r) in enumerate(ok) if r), default=how.sections)
        at = max(reach, allowed)
        low, high = (grid[at], grid[min(at + 1, how.sections)]) if reach >= allowed else (grid[max(at - 1, 0)], grid[at])
    return low if reach >= allowed else high


def mix(df: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = True) -> DataFrame:
    """row (all columns of ``df``, or with ``carry`` off the id only), source, n_tokens, epoch (from
    1), block: one row for each time that a document is taken."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)) if carry else F.struct(F.col(id_col))
    rows = df.select(
        row.alias("row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), "")).cast("bigint").alias("n_tokens"),
        F.xxhash64(F.lit(how.seed), id_col, text_col).alias("h"),
        F.xxhash64(id_col, text_col).alias("tie"),
    )
    if not carry:
        rows = written(rows, "mixrows")
    totals = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "totals")
    alpha = exponent(totals, how)
    everything = totals.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha)))).alias("z"))
    plan = totals.join(F.broadcast(everything)).select(
        "source",
        F.greatest(F.lit(1), F.ceil(F.col("rows") / how.block_rows)).cast("int").alias("blocks"),
        "tokens",
        F.when(F.col("tokens") > 0, F.floor(F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / F.col("z") * F.col("all") * how.budget)).otherwise(0).cast("bigint").alias("quota"),
    )
    plan = written(
        plan.select("source", "blocks", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("int").alias("passes"), F.when(F.col("tokens") > 0, F.col("quota") % F.greatest("tokens", F.lit(1))).otherwise(0).alias("prefix")),
        "plan",
    )
    dealt = rows.join(plan, "source").withColumn("block", F.pmod(F.col("h"), F.col("blocks")).cast("int"))
    sums = rows.select("source", "h", "n_tokens").join(plan.select("source", "blocks"), "source").groupBy("source", F.pmod(F.col("h"), F.col("blocks")).cast("int").alias("block")).agg(F.sum("n_tokens").alias("in_block"))
    ahead = written(sums.withColumn("before", F.sum("in_block").over(Window.partitionBy("source").orderBy("block")) - F.col("in_block")).drop("in_block"), "ahead")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("h", "tie"))
    taken = dealt.join(ahead, ["source", "block"]).withColumn("copies", F.col("passes") + (F.col("before") + inside <= F.col("prefix")).cast("int"))
    return taken.filter("copies > 0").select("row", "source", "n_tokens", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, carry=False).select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", F.col("epoch").cast("bigint").alias("epoch"), F.col("block").cast("bigint").alias("block"))
