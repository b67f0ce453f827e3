"""Spelling variants by rolling-hash deletions.

Words one edit apart share a string that is left when one code point is deleted (a replacement: from both
at the same place; an insertion: from the longer one, and it is the shorter one). With the polynomial hash
H(w) = sum(w[j] * B^j) mod 2^64 the hash of w without position i is pre[i] + (H(w) - pre[i + 1]) / B, so
one running sum over a batch gives all deletion keys as NumPy integers (B is odd, so it has an inverse).
Deletions inside a run of equal letters give the same string, so a run is one row with its interval.

1. ``vocabulary``: words with their counts, a table with a row id.
2. ``keys``: (key, id, interval) for every run and every whole word: no strings, linear in a word's length.
3. Keys are partitioned by their leading bits and sorted; keys that stand alone are dropped in a stream.
4. The others get their words back and are compared as strings; a group of one string has at most
   (length + 1) words for each letter of the alphabet. A word's count of near words and its best one
   are aggregated from its groups, so no pair is ever written: two words are near in exactly one group.
5. ``rooted``: forms are followed by pointer doubling. A form is at least ``ratio`` times as frequent, so
   chains have at most log(max n) steps and no cycles.

Defined results: null or empty texts hold no word, a null document id counts as the empty string; ties of
n go to the smaller word in code-point order; repeated rows count each; words of any length take part;
empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import dropped, read, written

#: Odd, so that it can be divided by mod 2^64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
KEYS = "key bigint, id bigint, first int, last int"
MET = "word string, n bigint, near bigint, best_n bigint, best string"


@dataclass(frozen=True)
class Spelling:
    least_length: int = 5
    least_n: int = 3
    ratio: int = 2
    key_rows: int = 2_000_000  # of a partition


def lower_az(word: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.length(word) == F.octet_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def planted_words(docs: DataFrame, letters: str = "[A-Za-z\\u00C0-\\u00FF]+", every: int = 97) -> DataFrame:
    """One row (word) for each run of letters of ``text``, lower-cased; where ``every`` divides the crc32 of
    ``<doc_id>:<run>``, its letter number crc32 % length is taken out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(letters), F.lit(0))).alias("run"))
    runs = runs.select("doc", lower_az(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, how: Spelling) -> DataFrame:
    """(word, n), a row for each word that is long and frequent enough."""
    long_enough = words.filter(F.length("word") >= how.least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= how.least_n)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash's good (high) bits over all of the key."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """(key, word number, first, last): a row for each run of equal letters, and one with first = -1 for the
    whole word. Words are not empty."""
    size = np.array([len(w) for w in words], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - start[owner]
    power = np.full(int(size.max()), BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * power[place], dtype=np.uint64)])
    whole = total[start[1:]] - total[start[:-1]]
    fresh = np.ones(len(letters), bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(letters)) - 1
    w = owner[first]
    left = (total[first] - total[start[w]]) + (total[start[w + 1]] - total[first + 1]) * np.uint64(UNBASE)
    key = np.concatenate([mixed(left), mixed(whole)]).view(np.int64)
    minus = np.full(len(words), -1)
    return key, np.concatenate([w, np.arange(len(words))]), np.concatenate([place[first], minus]), np.concatenate([place[last], minus])


def keys(vocab: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size, lo = np.cumsum([len(w) for w in words]), 0
            while lo < len(words):  # about 100,000 letters at once
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + 100_000, "right")))
                key, number, first, last = deletion_keys(words[lo:hi])
                columns = [pa.array(key), pa.array(ids[lo:hi][number]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
                table = pa.RecordBatch.from_arrays(columns, names=["key", "id", "first", "last"])
                for at in range(0, table.num_rows, 500_000):
                    yield table.slice(at, 500_000)
                lo = hi

    return vocab.select("id", "word").mapInArrow(run, KEYS)


def by_radix(df: DataFrame, parts: int) -> DataFrame:
    """Partitioned by the key's leading bits, sorted by key."""
    bits = max(1, (parts - 1).bit_length())
    return df.repartition(parts, F.shiftrightunsigned(F.col("key"), 64 - bits - 4)).sortWithinPartitions("key")


def shared(df: DataFrame, parts: int) -> DataFrame:
    """The rows of KEYS whose key another row has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen, and whether it was given out
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            twin = np.concatenate([[held is not None and held[0] == key[0]], same]) | np.concatenate([same, [False]])
            if twin[0] and held is not None and held[0] == key[0] and not held[2]:
                yield held[1]
            yield batch.filter(pa.array(twin))
            held = (key[-1], batch.slice(len(key) - 1), bool(twin[-1]))

    return by_radix(df, parts).mapInArrow(run, KEYS)


def best(*found: tuple[int, str]) -> tuple[int, str]:
    return min(found, key=lambda x: (-x[0], x[1]))


def meet(group: list[tuple]) -> list[tuple]:
    """Rows (word, n, first, last) of one key -> rows of MET. Words with different strings left are apart."""
    kinds: dict[str, list[tuple]] = {}
    for word, n, first, last in group:
        kinds.setdefault(word if first < 0 else word[:first] + word[first + 1 :], []).append((word, n, first, last))
    out = []
    for members in kinds.values():
        if len(members) < 2:
            continue
        own = next(((w, n) for w, n, first, _ in members if first < 0), None)
        longer = [m for m in members if m[2] >= 0]
        if own and longer:
            n, word = best(*((n, w) for w, n, *_ in longer))
            out.append((*own, len(longer), n, word))
        if len(longer) == 1:
            if own:
                out.append((*longer[0][:2], 1, own[1], own[0]))
            continue
        # Replacements: a place holds the words that lack it; only places of several words matter.
        places = Counter(p for _, _, a, b in longer for p in range(a, b + 1))
        tops: dict[int, list[tuple[int, str]]] = {}
        for word, n, a, b in longer:
            for p in range(a, b + 1):
                if places[p] > 1:
                    tops[p] = sorted([*tops.get(p, []), (-n, word)])[:2]
        for word, n, a, b in longer:
            there = [p for p in range(a, b + 1) if places[p] > 1]
            near = sum(places[p] - 1 for p in there) + bool(own)
            if near:
                others = [min(t for t in tops[p] if t[1] != word) for p in there]
                top = best(*((-m, w) for m, w in others), *([(own[1], own[0])] if own else []))
                out.append((word, n, near, *top))
    return out


def met(df: DataFrame, parts: int) -> DataFrame:
    """(key, word, n, first, last) -> MET."""
    names = [c.split()[0] for c in MET.split(", ")]
    types = [pa.string() if "string" in c else pa.int64() for c in MET.split(", ")]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            out = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if len(group) > 1:
                        out += meet(group)
                    now, group = key, []
                group.append(tuple(row))
                if len(out) > 20_000:
                    yield rows_of(out)
                    out = []
            yield rows_of(out)
        if len(group) > 1:
            yield rows_of(meet(group))

    return by_radix(df, parts).select("key", "word", "n", "first", "last").mapInArrow(run, MET)


def rooted(forms: DataFrame) -> DataFrame:
    """(word, form), form not null -> (word, root). Each round doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        there = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(there, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = step.select("word", "root")
        now._lectern_path = step._lectern_path
        if not step.filter("moved").limit(1).count():
            return now


def variants(words: DataFrame, how: Spelling | None = None) -> DataFrame:
    """(word), one row an occurrence -> word, form, root, n, n_near, form_n."""
    how = how or Spelling()
    vocab = written(vocabulary(words, how).withColumn("id", F.monotonically_increasing_id()), "words")
    letters = vocab.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(words.sparkSession.sparkContext.defaultParallelism, -(-letters // how.key_rows))
    some = shared(keys(vocab), parts).join(vocab, "id").select("key", "word", "n", "first", "last")
    nothing = vocab.select("word", "n", F.lit(0).cast("bigint").alias("near"), F.lit(None).cast("bigint").alias("best_n"), F.lit(None).cast("string").alias("best"))
    top = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    near = met(some, parts).unionByName(nothing).groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min(top).alias("top"))
    frequent = -F.col("top.m") >= F.col("n") * how.ratio
    formed = near.select("word", "n", "n_near", F.when(frequent, F.col("top.w")).alias("form"), F.when(frequent, -F.col("top.m")).alias("form_n"))
    formed = written(formed, "forms")
    dropped(vocab)
    roots = rooted(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(planted_words(read(spark, sf_dir, "documents").select("doc_id", "text")))


#: crc32 from its definition: a table of 256 remainders, then a byte at a time.
OP12_SQL = """
WITH RECURSIVE bit(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents),
low AS (SELECT doc, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM run GROUP BY ALL),
hexed AS (SELECT w, n, hex(encode(doc || ':' || w)) AS x FROM low),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda p: ('0x' || x[p:p + 1])::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
word AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM word WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM place),
pair AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, v.word, v.n FROM less a JOIN v ON a.s = v.word
    UNION SELECT v.word, a.word, a.n FROM less a JOIN v ON a.s = v.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS top_n, arg_min(other, (-other_n, other)) AS top FROM pair GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= 2 * n THEN top END AS form,
    CASE WHEN top_n >= 2 * n THEN top_n END::BIGINT AS form_n FROM v LEFT JOIN near USING (word)),
follow(word, reached) AS (SELECT word, word FROM formed UNION ALL SELECT follow.word, f.form FROM follow JOIN formed f ON f.word = follow.reached WHERE f.form IS NOT NULL),
ended AS (SELECT follow.word, reached AS root FROM follow JOIN formed f ON f.word = follow.reached WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ended USING (word)"""
