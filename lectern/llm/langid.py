"""Language spans of mixed text by Viterbi over word scores, and a document's language.

A word's script, from code-point ranges, narrows the languages that it may have to those seen in that
script in training. Character n-grams (word ends marked) give each word a log-probability per
language; a Viterbi pass over the words with a penalty for each switch labels spans. The document's
language has the most letters in those spans.

The model is fitted on a bounded sample of the labelled rows: ``per_lang`` rows a language, those of
the smallest hash of their text, so the choice is the same at every partitioning; the table of n-grams
has a fixed number of buckets. Whole texts are labelled, whatever their length.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
language first in order; rows without a language never train; repeated rows are judged alike; with no
row to learn from everything is ``und``; only the named columns are read.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import read

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode L); ``WORD`` alone also takes numerals such as ½ or Ⅷ."""
    found = WORD.findall(text.lower())
    if found and not "".join(found).isalpha():
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    return found


BUCKETS = 1 << 16
ORDERS = (1, 2, 3)

# Unicode ranges of scripts (first, last code point, script).
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1E00, 0x1EFF, "Latin"), (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
NAMES = tuple(dict.fromkeys(s for _, _, s in SCRIPTS)) + ("Other",)
_FIRST = np.array([a for a, _, _ in SCRIPTS])
_LAST = np.array([b for _, b, _ in SCRIPTS])
_INDEX = np.array([NAMES.index(s) for _, _, s in SCRIPTS])


def script_of(word: str) -> int:
    """Of the first letter."""
    k = int(np.searchsorted(_FIRST, ord(word[0]), "right")) - 1
    return int(_INDEX[k]) if k >= 0 and ord(word[0]) <= _LAST[k] else len(NAMES) - 1


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x langs
    scripts: np.ndarray  # scripts x langs: seen in training
    penalty: float = 12.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the number of the word of each."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer(("".join(f" {w} " for w in words)).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    found, of = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        ahead = np.zeros(len(codes), np.uint64)
        ahead[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h ^ (ahead + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            ok = left >= n
            found.append((h[ok] >> np.uint64(48)).astype(np.int64))
            of.append(word[ok])
    return np.concatenate(found), np.concatenate(of)


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, lang)."""
    langs = sorted({lang for _, lang in rows})
    counts = np.full((BUCKETS, len(langs)), 0.0)
    scripts = np.zeros((len(NAMES), len(langs)), bool)
    for text, lang in rows:
        words = words_of(text)
        if words:
            k = langs.index(lang)
            counts[:, k] += np.bincount(buckets(words)[0], minlength=BUCKETS)
            for w in set(words):
                scripts[script_of(w), k] = True
    logp = np.log((counts + 0.05) / (counts.sum(0) + 0.05 * BUCKETS))
    return Model(langs, (logp - logp.mean(1, keepdims=True)).astype(np.float32), scripts)


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    found, of = buckets(words)
    out = np.stack([np.bincount(of, model.logp[found, k], len(words)) for k in range(len(model.langs))], 1)
    allowed = model.scripts[[script_of(w) for w in words]]
    allowed |= ~allowed.any(1, keepdims=True)
    return np.where(allowed, out, -50.0)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; one pass, memory in proportion to the words."""
    n, langs = scores.shape
    best = int(scores.sum(0).argmax())
    if langs == 1:
        return np.zeros(n, np.int64)
    # One language is the best path if no stretch of words gains by leaving it: one switch at an end
    # of the text, two elsewhere.
    gain = np.concatenate([[0.0], np.cumsum(np.delete(scores, best, 1).max(1) - scores[:, best], dtype=np.float64)])
    if gain.max() <= penalty and gain[-1] - gain.min() <= penalty and (gain - np.minimum.accumulate(gain)).max() <= 2 * penalty:
        return np.full(n, best)
    rows = scores.tolist()
    v, back = rows[0], []
    for row in rows[1:]:
        top = max(v)
        k, jump = v.index(top), top - penalty
        back.append([k if jump > x else -1 for x in v])
        v = [(jump if jump > x else x) + s for x, s in zip(v, row, strict=True)]
    at = v.index(max(v))
    path = np.empty(n, np.int64)
    path[-1] = at
    for t in range(n - 2, -1, -1):
        at = at if back[t][at] < 0 else back[t][at]
        path[t] = at
    return path


class Labeler:
    """Scores are kept for a bounded number of words, the first that came: frequent ones are among them."""

    def __init__(self, model: Model, limit: int = 250_000):
        self.model, self.limit = model, limit
        self.known: dict[str, int] = {}
        self.table = np.empty((limit, len(model.langs)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        out = self.table[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh: dict[str, int] = {}
            where = np.fromiter((fresh.setdefault(words[i], len(fresh)) for i in missing), np.int64, len(missing))
            names = list(fresh)
            found = np.concatenate([word_scores(self.model, names[i : i + 20_000]) for i in range(0, len(names), 20_000)])
            out[missing] = found[where]
            start = len(self.known)
            room = min(self.limit - start, len(names))
            self.table[start : start + room] = found[:room]
            self.known.update(zip(names[:room], range(start, start + room), strict=True))
        return out

    def batch(self, texts: list) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Words, scores and path of each text; scores are looked up for a group of texts at once."""
        group: list[list[str]] = []
        size = 0
        for text in [*texts, None]:
            if text is not None:
                group.append(words_of(text))
                size += len(group[-1])
            if size > 200_000 or text is None:
                found = self.scores([w for words in group for w in words]) if size else None
                at = 0
                for words in group:
                    s = found[at : at + len(words)] if words else np.empty((0, len(self.model.langs)), np.float32)
                    at += len(words)
                    yield words, s, viterbi(s, self.model.penalty) if words else np.empty(0, np.int64)
                group, size = [], 0


def labeler_of(model: Model) -> Labeler:
    """One for all tasks of a worker process."""
    held = sys.modules.setdefault("_lectern_labeler", types.ModuleType("_lectern_labeler"))
    if getattr(held, "key", None) != model.key:
        held.key, held.labeler = model.key, Labeler(model)
    return held.labeler


def decide(words: list[str], scores: np.ndarray, path: np.ndarray, model: Model) -> tuple[str, float]:
    if not words or not model.langs:
        return "und", 0.0
    letters = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(model.langs))
    return model.langs[int(letters.argmax())], float(letters.max() / letters.sum())


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with ``spans`` also array<struct<first,last,lang>> in words."""
    schema = "doc_id bigint, lang_pred string, score double" + ", spans array<struct<first:bigint,last:bigint,lang:string>>" * spans
    # Plain values, BUCKETS x languages, fixed: the package need not be on the executors.
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.scripts, model.penalty, model.key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        labeler = labeler_of(model)
        for batch in batches:
            langs, scores, runs = [], [], []
            for words, s, path in labeler.batch([x or "" for x in batch.column(1).to_pylist()]):
                lang, score = decide(words, s, path, model)
                langs.append(lang)
                scores.append(score)
                if spans:
                    cut = np.flatnonzero(np.diff(path)) + 1
                    first, last = [0, *cut], [*(cut - 1), len(path) - 1]
                    runs.append([{"first": int(a), "last": int(b), "lang": model.langs[path[a]]} for a, b in zip(first, last, strict=True)] if len(path) else [])
            out = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                out.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: 3 + spans])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def sample(df: DataFrame, may: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, most_chars: int = 20_000) -> list[tuple[str, str]]:
    """The bounded training sample: per language the ``per_lang`` rows whose id hashes lowest, of the
    texts of at most ``most_chars`` characters; a language that has longer texts only trains on their
    first ``most_chars``. The rows are chosen from ids, languages and lengths alone, and Spark keeps a
    language's first rows in each partition before the shuffle, so a language with a third of all rows
    sends no more than any other."""
    from pyspark.sql import Window

    able = df.filter(may & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    able = able.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), (F.length(text_col) > most_chars).alias("long"))
    order = Window.partitionBy("lang").orderBy("long", "h", "id")
    ranked = able.select("id", "lang", "h", "long").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang)
    kept = ranked.withColumn("only", F.min("long").over(Window.partitionBy("lang"))).filter("long = only").select("id", "lang", "h", "long")
    texts = able.select("id", "long", F.substring("text", 1, most_chars).alias("text"))
    rows = texts.join(F.broadcast(kept), ["id", "long"]).select("text", "lang", "h").collect()
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.h, r.text))]


def part(modulus: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(sample(docs, part(3) != 1))
    return predict(docs, model).select("doc_id", F.coalesce(part(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
