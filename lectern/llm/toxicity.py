"""Toxicity by a weighted finite-state grammar over clauses.

Transducers in the (max, +) semiring, in hundredths, are composed once (``compose``):

* lexicon: a word -> insult ``I`` or threat ``H`` with its weight, target ``Y``, negation ``N``, report ``R``
  or other ``x``; an insult or threat may also be read as ``x`` for nothing;
* negation: for three words after ``N`` an insult loses ``NEGATED``, a threat is none;
* reported speech: a clause with an ``R`` anywhere loses ``REPORTED`` for each insult or threat (one branch
  promises the report and ends only where it came, the other ends only without one);
* match: accepts a clause in which insults have a target, before or after, with ``NEAR`` more where it is at
  most four words away, and threats have one within three words after them.

The weight of a clause is that of its best accepted path. A clause without such a path, and so any
isolated word, weighs nothing. Targets are the closed-class words that tie an insult to someone: pronouns,
articles, demonstratives and copulas. Insults are words and word beginnings learned from labelled rows
by log-odds, threats a fixed list. The composed transducer is determinised as it runs (states are
residual weights), and the steps seen are kept up to a bounded number. A logistic model of the clause
weights (sum, largest, number, share of clauses) gives the score.

The model is fitted on a bounded sample of labelled rows (``per_label``), chosen by a hash of the id;
whole texts are scored. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have no clause and get the score of a text without a match;
repeated rows score alike; a null id never trains and is not held out; without labels of both kinds all scores are 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import read
from lectern.llm.langid import part

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
BREAKS = frozenset(".!?;:\n")
STEMS = (4, 5, 6, 7)
NEAR, NEGATED, REPORTED, THREAT = 40, 100, 40, 160

# Closed-class words of the grammar, in English, French, German, Spanish and Italian.
TARGETS = frozenset(
    "you your yours he she they them him her his their it its this that these those who the a an is are was were be "
    "tu toi vous votre ton ta il elle ils elles leur son sa ses ce cette ces le la les un une des est sont "
    "du dich dir sie ihr euch er es ihn ihm sein der die das den dem ein eine einer ist sind war "
    "usted ustedes tus su sus él ella ellos el los las una este esta ese esa es son era "
    "voi lui lei loro lo gli uno questo questa sono".split()
)
NEGATIONS = frozenset("not never no isn don doesn won cannot ne pas jamais non nicht kein keine nie nunca jamás mai".split())
REPORTS = frozenset("said says quoted quote wrote called reported claimed dit écrit cité sagte schrieb zitierte dijo escribió citó disse scrisse".split())
THREATS = frozenset("kill hurt destroy beat murder stab shoot tuer töten matar uccidere".split())


@dataclass
class Fst:
    """arcs: state -> (input, output, weight, next state)."""

    starts: tuple
    final: frozenset
    arcs: dict


def negation() -> Fst:
    arcs: dict = {}
    for left in range(4):
        after = max(left - 1, 0)
        arcs[left] = [("N", "x", 0, 3), ("I", "I", -NEGATED if left else 0, after), *((s, s, 0, after) for s in "xYR")]
        if not left:
            arcs[left].append(("H", "H", 0, after))
    return Fst((0,), frozenset(range(4)), arcs)


def reported() -> Fst:
    arcs = {"none": [(s, s, 0, "none") for s in "xYIH"]}
    for state in ("promised", "seen"):
        arcs[state] = [("R", "x", 0, "seen"), ("x", "x", 0, state), ("Y", "Y", 0, state), ("I", "I", -REPORTED, state), ("H", "H", -REPORTED, state)]
    return Fst(("none", "promised"), frozenset(("none", "seen")), arcs)


def match() -> Fst:
    """open: no target yet; (seen, k): one was seen, the last at most 4 - k words ago; (due, k): one has to
    come within k words for an insult near to it, (object, k) likewise for a threat."""
    arcs: dict = {"open": [("x", "", 0, "open"), ("I", "", 0, "open"), ("I", "", NEAR, ("due", 4)), ("H", "", 0, ("object", 3)), ("Y", "", 0, ("seen", 4))]}
    for k in range(5):
        after = ("seen", max(k - 1, 0))
        arcs["seen", k] = [("x", "", 0, after), ("I", "", NEAR if k else 0, after), ("H", "", 0, ("object", 3)), ("Y", "", 0, ("seen", 4))]
        if not k:
            arcs["seen", k].append(("I", "", NEAR, ("due", 4)))
    for name, most in (("due", 4), ("object", 3)):
        for k in range(1, most + 1):
            arcs[name, k] = [("Y", "", 0, ("seen", 4))]
            if k > 1:
                arcs[name, k] += [("x", "", 0, (name, k - 1)), ("I", "", 0, (name, k - 1))]
    return Fst(("open",), frozenset(("seen", k) for k in range(5)), arcs)


def compose(first: Fst, second: Fst) -> Fst:
    """What ``second`` makes of the outputs of ``first``; only states that can be reached."""
    todo = [(a, b) for a in first.starts for b in second.starts]
    starts, arcs = tuple(todo), {}
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        by_input: dict = {}
        for i, o, w, to in second.arcs[state[1]]:
            by_input.setdefault(i, []).append((o, w, to))
        arcs[state] = [(i, o2, w + w2, (to, to2)) for i, o, w, to in first.arcs[state[0]] for o2, w2, to2 in by_input.get(o, ())]
        todo += [to for *_, to in arcs[state]]
    return Fst(starts, frozenset(s for s in arcs if s[0] in first.final and s[1] in second.final), arcs)


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    beta: np.ndarray | None = None

    def weight(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                w = max(w, self.stems.get(word[:n], 0.0))
        return w


class Lexicon(dict):
    """word -> (symbol, weight), kept for a bounded number of words."""

    def __init__(self, grammar: Grammar, limit: int):
        self.grammar, self.limit = grammar, limit

    def __missing__(self, word: str) -> tuple[str, int]:
        closed = ((("H", THREAT), THREATS), (("N", 0), NEGATIONS), (("R", 0), REPORTS), (("Y", 0), TARGETS))
        got = next((pair for pair, words in closed if word in words), None)
        if got is None:
            weight = round(100 * self.grammar.weight(word))
            got = ("I", weight) if weight else ("x", 0)
        if len(self) < self.limit:
            self[word] = got
        return got


class Matcher:
    """The composed transducer, determinised as it runs: a state holds each state that paths have come to
    and how much the best path there is behind the best of all."""

    def __init__(self, grammar: Grammar, limit: int = 300_000):
        self.known = Lexicon(grammar, limit)
        self.fst = compose(compose(negation(), reported()), match())
        self.start = tuple((s, 0) for s in self.fst.starts)
        self.steps: dict = {}
        self.by_input: dict = {}
        for state, arcs in self.fst.arcs.items():
            for i, _, w, to in arcs:
                self.by_input.setdefault((state, i), []).append((w, to))

    def step(self, state: tuple, symbol: str, weight: int) -> tuple[int, tuple]:
        best: dict = {}
        for s, behind in state:
            for read, gain in ((symbol, weight), ("x", 0)) if symbol in "IH" else ((symbol, 0),):
                for w, to in self.by_input.get((s, read), ()):
                    if (v := behind + gain + w) > best.get(to, -(1 << 60)):
                        best[to] = v
        top = max(best.values(), default=0)
        return top, tuple(sorted(((s, v - top) for s, v in best.items()), key=repr))

    def clause(self, symbols: list[tuple[str, int]]) -> float:
        """The weight of the best path that the grammar accepts, at least 0."""
        state, total = self.start, 0
        for symbol, weight in symbols:
            got = self.steps.get((state, symbol, weight))
            if got is None:
                got = self.step(state, symbol, weight)
                if len(self.steps) < 200_000:
                    self.steps[state, symbol, weight] = got
            total += got[0]
            state = got[1]
        return max((total + v for s, v in state if s in self.fst.final), default=0) / 100

    def features(self, text: str) -> tuple[float, float, float, float]:
        tokens = TOKEN.findall(text.lower())
        read = list(map(self.known.__getitem__, tokens))
        flagged = [i for i, (symbol, _) in enumerate(read) if symbol in "IH"]
        clauses, at = [], 0
        while at < len(flagged):
            first = last = flagged[at]
            while first and tokens[first - 1] not in BREAKS:
                first -= 1
            while last + 1 < len(tokens) and tokens[last + 1] not in BREAKS:
                last += 1
            while at < len(flagged) and flagged[at] <= last:
                at += 1
            if (c := self.clause(read[first : last + 1])) > 0:
                clauses.append(c)
        if not clauses:
            return 0.0, 0.0, 0.0, 0.0
        return math.log1p(sum(clauses)), max(clauses), math.log1p(len(clauses)), min(1.0, 10 * len(clauses) / len(tokens))


def fit(rows: list[tuple[str, int]]) -> Grammar:
    n = Counter(y for _, y in rows)
    grammar = Grammar()
    if not n[0] or not n[1]:
        return grammar
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for text, y in rows:
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        found = {(0, w) for w in words} | {(k, w[:k]) for w in words for k in STEMS if len(w) > k}
        seen[y].update(found)
    for (k, w), a in seen[1].items():
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((seen[0][k, w] + 0.5) / (n[0] + 1))
        if a >= 4 and odds > 2.0 and a / n[1] > 8 * seen[0][k, w] / n[0]:
            (grammar.stems if k else grammar.words)[w] = odds / 4
    matcher = Matcher(grammar)
    x = np.array([(1.0, *matcher.features(t)) for t, _ in rows])
    y = np.array([y for _, y in rows], float)
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridge logistic model
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1]), x.T @ (y - p) - 0.5 * beta)
    grammar.beta = beta
    return grammar


def score(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    # Plain values, bounded by the training sample: the package need not be on the executors.
    shared = df.sparkSession.sparkContext.broadcast((grammar.words, grammar.stems, None if grammar.beta is None else grammar.beta.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems, beta = shared.value
        matcher = Matcher(Grammar(words, stems))
        for batch in batches:
            x = np.array([(1.0, *matcher.features(t.as_py() or "")) for t in batch.column(1)]).reshape(-1, 5)
            s = 1 / (1 + np.exp(-np.clip(x @ np.array(beta), -30, 30))) if beta is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def sample(docs: DataFrame, labels: DataFrame, per_label: int = 2_500, most_chars: int = 20_000) -> list[tuple[str, int]]:
    """Bounded: per label the rows whose id hashes lowest, of the texts of at most ``most_chars``
    characters; a label that has longer texts only trains on their first ``most_chars``. Of an id
    labelled twice the larger label counts."""
    once = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (part(5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", (F.length("text") > most_chars).alias("long"))
    usable = once.join(texts.select("doc_id", "long"), "doc_id").groupBy("doc_id", "toxic").agg(F.min("long").alias("long"))
    order = Window.partitionBy("toxic").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    ranked = usable.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_label)
    chosen = ranked.withColumn("only", F.min("long").over(Window.partitionBy("toxic"))).filter("long = only").select("doc_id", "toxic", "long")
    rows = texts.join(F.broadcast(chosen), ["doc_id", "long"]).select("doc_id", F.substring("text", 1, most_chars).alias("text"), "toxic").collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit(sample(docs, read(spark, sf_dir, "labels")))
    return score(docs, grammar).select(
        "doc_id", F.coalesce(part(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
