"""Quality rules as a bitmask ledger (native: DataFrame functions only, no shuffle).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; a policy is a versioned mask over those bits, so policies and ablations never read the texts
again: a policy is one bitwise AND, an ablation is an aggregate over the few distinct bit patterns.

Defined results: a null text has no words and fails ``few_words``; the same holds for an empty text;
repeated rows are judged alike, one result row per input row; an empty table gives an empty ledger;
only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, let

#: name -> failing condition over the measurements, in the order of the bits. Integer arithmetic
#: only, so that any engine gives the same bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 15 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "exclamations": "100 * n_bangs > 12 * word_chars",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("2", tuple(RULES))
POLICIES = {p.version: p for p in (BASE, STANDARD)}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")


#: Positions of words in the sorted windows: the low bits; the hash has the others.
POS_BITS = 24


def _window(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _packed(words: Column) -> Column:
    """Windows as (hash bits, position), sorted as plain longs, which code generation does in place."""
    windows = F.transform(
        words,
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
        .bitwiseAND(F.lit(-1 << POS_BITS))
        .bitwiseOR(i.cast("bigint").bitwiseAND(F.lit((1 << POS_BITS) - 1))),
    )
    return F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))


def _neighbours(array: Column, key) -> Column:
    """The elements whose key equals that of the element before or after them."""
    same = lambda x, j: F.coalesce(key(x) == key(F.get(array, j)), F.lit(False))
    return F.filter(array, lambda x, i: same(x, i + 1) | same(x, i - 1))


def _repeated(words: Column, packed: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. The packed hashes are short, so what
    they find is checked with whole 64-bit hashes; a text with more words than POS_BITS can number
    takes the second step with all of its windows."""
    short = F.transform(
        _neighbours(packed, lambda x: F.shiftright(x, POS_BITS)),
        lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int"),
    )
    found = F.when(F.size(words) <= 1 << POS_BITS, short).otherwise(F.sequence(F.lit(0), F.size(words) - 3))

    def covered(positions: Column) -> Column:
        pairs = F.sort_array(F.transform(positions, lambda i: F.struct(_window(words, i).alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.transform(_neighbours(s, lambda x: x["h"]), lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    return let(found, lambda f: F.when(F.size(f) == 0, F.lit(0)).otherwise(covered(f)))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements, all bigint."""
    read = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))
    marked = F.rlike(t, F.lit("[#*$%&|<>!]"))  # one pass for the many texts without any

    def chars(pattern: str) -> Column:
        return F.when(marked, F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).otherwise(F.lit(0))

    words = read.select(
        "doc_id",
        F.array_remove(F.split(t, SPACE), "").alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        chars("[#*$%&|<>]+").alias("n_symbols"),
        chars("!+").alias("n_bangs"),
    )
    sorted_ = words.select("*", _packed(F.col("w")).alias("packed"))
    measures = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.col("l.dup"),
        "n_repeat_words": _repeated(F.col("w"), F.col("packed")),
        "n_lines": F.col("l.n"),
        "n_bangs": F.col("n_bangs"),
    }
    return sorted_.select("doc_id", *(c.cast("bigint").alias(name) for name, c in measures.items()))


def fail_bits() -> Column:
    """The failure bits of a measured row."""
    bits = F.lit(0)
    for name, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)))
    return bits


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, measurements, ``fail_bits``: the ledger that policies are applied to."""
    return measure(df, id_col, text_col).withColumn("fail_bits", fail_bits())


def apply_policy(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Adds ``kept`` and ``policy``: no bit of the policy's mask is set."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0).withColumn(
        "policy", F.lit(policy.version)
    )


def ablation(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Per rule of the policy: documents failing it, documents that only it rejects (what dropping
    the rule would bring back), and the union of the other bits that its failures carry."""
    mask = policy.mask
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).alias("bit")) for r in policy.rules)))
    hit = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.lit(mask)) == F.col("r.bit")
    return (
        patterns.withColumn("r", rules)
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("bigint").alias("n_failed"),
            F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).cast("bigint").alias("n_only"),
            F.coalesce(F.bit_or(F.when(hit, F.col("fail_bits"))), F.lit(0)).alias("with_bits"),
        )
    )


def documents_kept(df: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that the policy keeps.

    The verdict passes through a generator of one row: a filter on it cannot be pushed down into the
    measurements, where the optimizer would put the splitting of the text into every lambda."""
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"))
    entries = ledger(row.select(F.col("row").alias("id"), "text"), "id")
    judged = apply_policy(entries, policy).select("doc_id", F.explode(F.array("kept")).alias("kept"))
    return judged.filter("kept").select("doc_id.*")
