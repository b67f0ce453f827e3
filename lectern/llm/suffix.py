"""Removal of repeated byte strings by prefix-free parsing, distributed.

Rolling-hash triggers cut the texts into phrases. A trigger is the 40-byte string with the smallest
hash among those inside a 200-byte window, the leftmost of equals, so equal windows have equal
triggers at equal places and every window has one. The run of windows with one trigger and the bytes
they cover are a phrase; its hash is its entry in the dictionary, the texts are its parse.

Phrases overlap, so every 200-byte string lies whole in one phrase: in the corpus's suffix order, seen to
a depth of 200, the suffixes of the dictionary phrases already stand in their places, and the parse only
tells how often a phrase occurs (no string reaches into the next phrase, so the parse needs no order of
its own).

* A phrase that occurs twice in the parse: all of its windows are repeated.
* A phrase whose trigger stands in no other phrase and once only: its windows are found nowhere else.
* The dictionary phrases that share a trigger are put in order by their suffixes from the trigger on
  and, read backwards, by what stands before it, with the longest common prefixes of neighbours. Two
  windows that hold the trigger at one place are equal if they are in one class of both orders, cut at the
  lengths that the window has on both sides; so bytes decide, each dictionary phrase is compared once,
  and two sorts do for all windows of it.

A phrase's identity in the parse is the 64-bit hash of its trigger together with a 64-bit hash of all
its bytes. A trigger whose different phrases are more than ``HOT`` has its windows told apart by 128-bit
digests instead, dealt out by the digest, so that no task holds them all.

Work and memory: a row per phrase (some 1/80 of the bytes); a trigger or phrase that a third of all
texts share is counted by partial aggregates and joined back by joins that Spark may split.

Defined results: null texts are empty; texts under 200 bytes lose nothing; identical rows repeat each
other; strings are judged on the input, overlaps count; matches never cross documents; empty tables
give no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import dropped, read, written

LENGTH, TRIGGER = 200, 40
WINDOWS = LENGTH - TRIGGER + 1
POS_BITS = 24
#: Bytes hashed at a time; longer texts are cut into pieces that overlap by LENGTH - 1.
PIECE = 1 << 21
#: Phrases that one call compares, and different phrases of one trigger from which digests decide.
CALL_ROWS, HOT = 20_000, 20_000
_digest = xxhash.xxh3_64_intdigest
_table = np.random.default_rng(977).integers(0, 1 << 64, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of all substrings of a buffer from prefix sums, modulo 2^64."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray):
        n = len(data)
        if Rolling._powers is None or len(Rolling._powers[0]) < n:
            size = max(n, PIECE + LENGTH)
            both = []
            for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
                out = np.full(size, f, np.uint64)
                out[0] = 1
                both.append(np.multiply.accumulate(out))
            Rolling._powers = both[0], both[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_table[data] * Rolling._powers[0][:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Rolling._powers[1][start]

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * Rolling._powers[1][:n]


def phrases(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts that are hashed together: text number, first window, windows, the trigger's place in the
    phrase, trigger, phrase."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    if n < LENGTH or not (lengths >= LENGTH).any():
        return (np.empty(0, np.int64),) * 6
    rolling = Rolling(data)
    grams = _mix(rolling.all(TRIGGER))
    place = (grams >> np.uint64(POS_BITS) << np.uint64(POS_BITS)) | np.arange(len(grams), dtype=np.uint64)
    # The smallest of each run of WINDOWS, from minima towards both ends of blocks of that size.
    padded = np.full(-(-len(place) // WINDOWS) * WINDOWS, np.iinfo(np.uint64).max)
    padded[: len(place)] = place
    blocks = padded.reshape(-1, WINDOWS)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    m = n - LENGTH + 1
    trigger = (np.minimum(back[:m], ahead[WINDOWS - 1 : WINDOWS - 1 + m]) & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    long = lengths >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, (starts + lengths - LENGTH + 1)[long], -1)
    valid = np.cumsum(valid)[:m] > 0
    fresh = valid.copy()
    fresh[1:] &= (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh)
    ends = valid.copy()
    ends[:-1] &= (trigger[1:] != trigger[:-1]) | ~valid[1:]
    last = np.flatnonzero(ends)
    at = trigger[first]
    whole = memoryview(data)
    phrase = np.fromiter((_digest(whole[i:j]) for i, j in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), np.uint64, len(first))
    number = np.searchsorted(starts, first, "right") - 1
    return number, first - starts[number], last - first + 1, at - first, grams[at].view(np.int64), phrase.view(np.int64)


def _pieces(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of bounded size: ids, offsets, bytes."""
    ids, offsets, texts, size = [], [], [], 0
    for i, text in rows:
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if size + len(part) > PIECE and texts:
                yield ids, offsets, texts
                ids, offsets, texts, size = [], [], [], 0
            ids.append(i)
            offsets.append(at)
            texts.append(part)
            size += len(part)
    if texts:
        yield ids, offsets, texts


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def parse(rows: DataFrame) -> DataFrame:
    """(did, h, text) -> did, h, lo, cnt, off, key, phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for who, offsets, texts in _pieces((i, _bytes(t)) for i, t in enumerate(batch.column(2))):
                number, lo, cnt, off, key, phrase = phrases(texts)
                row = np.array(who, np.int64)[number]
                lo = lo + np.array(offsets, np.int64)[number]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[row], hashes[row], lo, cnt.astype(np.int32), off.astype(np.int32), key, phrase)],
                    names=["did", "h", "lo", "cnt", "off", "key", "phrase"],
                )

    return rows.mapInArrow(run, "did bigint, h bigint, lo bigint, cnt int, off int, key bigint, phrase bigint")


def cut(rows: DataFrame) -> DataFrame:
    """(text, asked: list of (lo, cnt, off, key, phrase)) -> key, phrase, cnt, off, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "phrase", "cnt", "off", "data")
        for batch in batches:
            held, size = [], 0
            for i, text in enumerate(batch.column(0)):
                whole = _bytes(text)
                for x in batch.column(1)[i].as_py():
                    held.append((x["key"], x["phrase"], x["cnt"], x["off"], whole[x["lo"] : x["lo"] + x["cnt"] + LENGTH - 1]))
                if len(held) - size > 20_000 or i + 1 == batch.num_rows:
                    columns = zip(*held, strict=True) if held else [()] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))
                    held, size = [], 0

    return rows.mapInArrow(run, "key bigint, phrase bigint, cnt int, off int, data binary")


def _order(keys: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings within their keys, and how much each has in common with the one before
    it (nothing with another key's)."""
    rows = np.zeros((len(strings), 8 + width), np.uint8)
    rows[:, :8] = keys.astype(">i8").view(np.uint8).reshape(-1, 8)
    for i, s in enumerate(strings):
        rows[i, 8 : 8 + len(s)] = np.frombuffer(s, np.uint8)
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{8 + width}").reshape(-1), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), 8 + width)
    return order, np.concatenate([[-1], np.where(common < 8, -1, common - 8)])


def compare(keys: np.ndarray, cnt: np.ndarray, off: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Which windows of different phrases are equal: a row for each phrase, a column for each number of
    bytes before the trigger."""
    n = len(keys)
    ahead, ahead_common = _order(keys, [d[o : o + LENGTH] for d, o in zip(data, off.tolist(), strict=True)], LENGTH)
    back, back_common = _order(keys, [d[:o][::-1] for d, o in zip(data, off.tolist(), strict=True)], WINDOWS - 1)
    found = np.zeros((n, WINDOWS), bool)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(WINDOWS):
        right[ahead] = np.cumsum(ahead_common < LENGTH - before)
        left[back] = np.cumsum(back_common < before)
        has = np.flatnonzero((before <= off) & (before > off - cnt))
        _, at, number = np.unique(left[has] * (n + 1) + right[has], return_inverse=True, return_counts=True)
        found[has, before] = number[at] > 1
    return found


def shared_windows(phrases_: DataFrame) -> DataFrame:
    """(key, phrase, cnt, off, data), the dictionary phrases -> key, phrase, j, c: runs of c windows from
    the j-th on that stand in another phrase as well."""
    calls = max(1, -(-phrases_.count() // CALL_ROWS))
    hot = phrases_.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT).select("key")

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "phrase"])
        off = pdf.off.to_numpy(np.int64)
        found = compare(pdf.key.to_numpy(), pdf.cnt.to_numpy(np.int64), off, pdf.data.tolist())
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        return pd.DataFrame({"key": pdf.key.to_numpy()[row], "phrase": pdf.phrase.to_numpy()[row], "j": (off[row] - end + 1).astype(np.int32), "c": (end - first).astype(np.int32)})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, phrase, cnt, data = (batch.column(c)[i].as_py() for c in (0, 1, 2, 4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * cnt, pa.int64()), pa.array([phrase] * cnt, pa.int64()), pa.array(range(cnt), pa.int32()), pa.array([xxhash.xxh3_128_digest(data[j : j + LENGTH]) for j in range(cnt)], pa.binary())],
                    names=["key", "phrase", "j", "digest"],
                )

    few = phrases_.join(hot, "key", "left_anti").withColumn("call", F.pmod(F.xxhash64("key"), F.lit(calls)))
    out = few.groupBy("call").applyInPandas(close, "key bigint, phrase bigint, j int, c int")
    windows = phrases_.join(hot, "key", "left_semi").mapInArrow(digests, "key bigint, phrase bigint, j int, digest binary")
    twice = windows.groupBy("key", "digest").agg(F.min("phrase").alias("a"), F.max("phrase").alias("b")).filter("a <> b").select("key", "digest")
    many = windows.join(twice, ["key", "digest"]).select("key", "phrase", "j", F.lit(1).alias("c")).distinct()
    return out.unionByName(many)


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, did, h, text; found: did, h, runs array<struct<lo,cnt>> of repeated windows)."""
    # Rows of one id and one text are told apart by nothing: they have the same runs.
    did = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    texts = df.select(F.col(id_col).alias("doc_id"), did.alias("did"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    parsed = written(parse(texts.filter(F.octet_length("text") >= LENGTH).select("did", "h", "text")), "parse")
    triggers = parsed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("a"), F.max("phrase").alias("b"))
    shared = written(triggers.filter("n > 1").select("key", (F.col("a") != F.col("b")).alias("several")), "triggers")
    hits = written(parsed.join(shared, "key"), "hits")
    dropped(parsed, shared)

    several = hits.filter("several")
    # The dictionary of the phrases to compare: one place of each, and whether it occurs again.
    dictionary = written(
        several.groupBy("key", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "h", "lo", "cnt", "off")).alias("x")).select("key", "phrase", "n", "x.*"),
        "dictionary",
    )
    asked = written(dictionary.groupBy("did", "h").agg(F.collect_list(F.struct("lo", "cnt", "off", "key", "phrase")).alias("asked")), "asked")
    bytes_ = written(cut(texts.join(asked, ["did", "h"]).select("text", "asked")), "phrases")
    part = written(shared_windows(bytes_), "windows")
    dropped(asked, bytes_)
    whole = dictionary.filter("n > 1").select("key", "phrase", F.lit(0).alias("j"), F.col("cnt").alias("c"))
    once = dictionary.filter("n = 1").select("key", "phrase")
    marks = written(whole.unionByName(part.join(once, ["key", "phrase"], "left_semi")), "marks")
    runs = several.join(marks, ["key", "phrase"]).select("did", "h", (F.col("lo") + F.col("j")).alias("lo"), F.col("c").alias("cnt"))
    runs = runs.unionByName(hits.filter("NOT several").select("did", "h", "lo", "cnt"))
    found = written(runs.groupBy("did", "h").agg(F.collect_set(F.struct("lo", "cnt")).alias("runs")), "runs")
    dropped(hits, dictionary, part, marks)
    return texts, found


def mask(n: int, lo: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """Which of n bytes are covered by repeated windows."""
    step = np.bincount(lo, minlength=n + 1) - np.bincount(lo + cnt + LENGTH - 1, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    texts, found = repeated(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                data = _bytes(text)
                if runs.is_valid:
                    gone = mask(len(data), *(runs.values.field(i).to_numpy().astype(np.int64) for i in (0, 1)))
                else:
                    gone = np.zeros(len(data), bool)
                edges = np.diff(gone.astype(np.int8), prepend=0)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, spans, sha, kept = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    joined = texts.join(found, ["did", "h"], "left").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "runs")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op8_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    return remove(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


#: Every window of 200 bytes, as hexadecimal digits, by its digest.
OP8_SQL = """
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pos AS (SELECT rid, unnest(range(0, greatest(0, length(x) // 2 - 199))) AS p, x FROM doc),
win AS MATERIALIZED (SELECT rid, p, md5_number(substr(x, 2 * p + 1, 400)) AS h FROM pos),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT rid, p FROM win WHERE h IN (SELECT h FROM twice)),
step AS (SELECT rid, p, CASE WHEN p - lag(p) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY rid ORDER BY p)),
run AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS r FROM step),
span AS (SELECT rid, min(p) AS a, max(p) + 200 AS b FROM run GROUP BY rid, r),
per AS (SELECT rid, sum(b - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM span GROUP BY rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda i:
        substr(x, CASE WHEN i = 1 THEN 1 ELSE 2 * b[i - 1] + 1 END, CASE WHEN i = 1 THEN 2 * a[1] WHEN i = len(a) + 1 THEN length(x) - 2 * b[i - 1] ELSE 2 * (a[i] - b[i - 1]) END)), '') END)) AS kept_sha256
FROM doc LEFT JOIN per USING (rid)"""
