"""Near-duplicate detection with SetSketch registers.

A document is the set of its k-word shingles. A SetSketch register keeps, for one hash function, the
minimum of exponential variables over the set, on an exponential scale with base ``BASE`` and
truncated to 16 bits: registers of unions are maxima, and equal registers are likely for similar sets.
Bands of registers are bucket keys. Candidates of a bucket are judged by the likelihood of the
registers' three-way comparison given both set sizes (known exactly), and what may reach the
threshold is verified on full sets.

No stage makes all pairs of a group. Documents with equal sets become one class at once. Then, in
each of two passes, a document is compared with one leader only, the member of its buckets that
has the most company in its own buckets (the source of a group of copies, where it is among them;
another one in the second pass); links are contracted to components, and buckets whose members are
in one component are done. What is left in open buckets is narrowed exactly: shingles that occur in one
component only can link nothing new and come first in an order of all shingles, the others follow
by frequency; two sets at the threshold share a shingle of the first n - ceil(n * percent / 100) + 1
of each. So members that share no live shingle there cannot be linked; those that chains of such shingles
connect are a family, and the members of a small one outside its largest component are compared with the
others on full sets. Large families grow with the input, so theirs are narrowed again, to pairs: see
``_narrowed``. No link between different texts is lost to a cap. With 36 bands of 5 registers a pair
at 0.8 is missed with probability under 1e-6, at 0.85 under 1e-9.

Everything between stages is a table in the shared folder; components are found by contraction with
joins and minima, nothing is collected.

Defined results: null texts and texts without words have the empty set, are linked with nothing and
kept; a text of fewer words than k is one shingle; rows of one doc_id are one document (their links
are joined) with a row each; rows with a null id are not linked and are kept; empty tables give no
rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import dropped, read, written

BASE, SCALE = 1.02, 20.0
ROWS, BANDS = 5, 36
REGISTERS = ROWS * BANDS
_draw = np.random.default_rng(20240229)
_A = (_draw.integers(1 << 8, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
#: How far the likelihood estimate of a true link may fall short: over 5 standard deviations.
SLACK = 0.16
BLOCK = 256
#: Passes with one leader for each document.
PASSES = 2
#: Documents, and shingles of all of them, that one call compares at most.
FAMILY, SHINGLES = 1024, 4_000_000
#: Pairs of a large family that are compared one by one, for each set that a comparison in blocks would move.
SPARSE = 4


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    percent: int = 80  # 100 * intersection >= percent * union


class Shingler:
    """Sets of 64-bit shingle hashes; word hashes are kept for a bounded number of words."""

    def __init__(self, k: int, limit: int = 200_000):
        self.k, self.limit, self.known = k, limit, {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def set(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = self.words(words)
        n = max(1, len(h) - self.k + 1)
        out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        for j in range(min(self.k, len(h))):
            out = (out ^ h[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    held = np.empty((min(len(x), 512), REGISTERS), np.uint32)
    for at in range(0, len(x), 512):
        part = held[: len(x) - at]
        np.multiply(x[at : at + 512, None], _A, out=part)
        part += _B
        np.minimum(least, part.min(0), out=least)
    e = -np.log1p(-(least + 0.5) / 2.0**32) / SCALE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, 65535).astype(np.uint16)


def similarity(n_u: float, k_u: np.ndarray, n_v: np.ndarray, k_v: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of one set to several that makes the comparison of registers likeliest."""
    up, down = (k_u > k_v).sum(1)[:, None], (k_u < k_v).sum(1)[:, None]
    same = k_v.shape[1] - up - down
    u = (n_u / (n_u + n_v))[:, None]
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - (1 - u) * j), p(1 - u - u * j)
    like = up * np.log(a) + down * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def reaches(n_u: float | np.ndarray, k_u: np.ndarray, n_v: np.ndarray, k_v: np.ndarray, j: float) -> np.ndarray:
    """Whether ``similarity`` is at least j: the likelihood has one maximum, so its slope at j tells. The
    left side is one set, or one for each on the right."""
    up, down = (k_u > k_v).sum(1), (k_u < k_v).sum(1)
    same = k_v.shape[1] - up - down
    u = n_u / (n_u + n_v)
    able = j <= np.minimum(u / (1 - u), (1 - u) / u)
    c = (BASE - 1) / BASE
    x, y = np.maximum(u - (1 - u) * j, 1e-12), np.maximum(1 - u - u * j, 1e-12)
    a, b = -np.log1p(-x * c) / np.log(BASE), -np.log1p(-y * c) / np.log(BASE)
    da, db = -(1 - u) * c / np.log(BASE) / (1 - x * c), -u * c / np.log(BASE) / (1 - y * c)
    return able & (up * da / a + down * db / b - same * (da + db) / np.maximum(1 - a - b, 1e-12) >= 0)


def sketches(df: DataFrame, how: Near, id_col: str, text_col: str) -> DataFrame:
    """id, n, cls (128-bit digest of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how.shingle)
        for batch in batches:
            n, cls, sketch = [], [], []
            for text in batch.column(1):
                s = shingler.set(text.as_py())
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sketch, pa.binary())],
                names=["id", "n", "cls", "sketch"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, cls binary, sketch binary")


def bands(reps: DataFrame) -> DataFrame:
    """key, id: a row for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(salt, k.shape[:2]).copy()
            for j in range(ROWS):
                key = (key ^ k[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(29)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return reps.select("id", "sketch").mapInArrow(run, "key bigint, id bigint")


def full_sets(df: DataFrame, wanted: DataFrame, how: Near, id_col: str, text_col: str) -> DataFrame:
    """id, n, set of the wanted ids; a row for each different text of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how.shingle)
        for batch in batches:
            sets = [shingler.set(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "n", "set"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    picked = rows.join(wanted, "id", "left_semi")
    return picked.mapInArrow(run, "id bigint, n bigint, set binary").filter("n > 0")


def likely(pairs: DataFrame, sketched: DataFrame, how: Near) -> DataFrame:
    """The pairs (a, ca, b, cb), with b's size n, that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            k_a, k_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (6, 7))
            may = reaches(n_a, k_a, n_b, k_b, how.percent / 100 - SLACK) & (100 * np.minimum(n_a, n_b) >= how.percent * np.maximum(n_a, n_b))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5)], names=["a", "ca", "b", "cb", "n"]).filter(pa.array(may))

    side = lambda x: sketched.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "ca", "b", "cb", "n_a", "n_b", "k_a", "k_b")
    return both.mapInArrow(run, "a bigint, ca bigint, b bigint, cb bigint, n bigint").distinct()


def verify(pairs: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """(a, ca, b, cb, n) candidate pairs, a the leader -> (a, b), the components of those that are linked on
    full sets. A leader's set travels once for each block of its members."""
    load = written(pairs.groupBy("a").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("blocks")), "load")
    dealt = written(pairs.join(load, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))), "dealt")
    members = dealt.select("a", "block", F.col("b").alias("id"), F.col("cb").alias("comp"), F.lit(False).alias("lead"))
    leaders = dealt.select("a", "block", F.col("a").alias("id"), F.col("ca").alias("comp"), F.lit(True).alias("lead")).distinct()
    # One join for both, so that the sets are shuffled once.
    both = leaders.unionByName(members).join(sets, "id")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        rest = pdf[~pdf.lead]
        for lead in pdf[pdf.lead].itertuples():
            mine = np.frombuffer(lead.set, np.uint64)
            for row in rest.itertuples():
                if 100 * min(row.n, lead.n) >= how.percent * max(row.n, lead.n):
                    # Both are sorted and without repeats.
                    its = np.frombuffer(row.set, np.uint64)
                    both = int((mine[np.minimum(np.searchsorted(mine, its), len(mine) - 1)] == its).sum())
                    if 100 * both >= how.percent * (lead.n + row.n - both):
                        found.add((lead.comp, row.comp))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    links = both.groupBy("a", "block").applyInPandas(judge, "a bigint, b bigint").distinct()
    out = written(links, "links")
    dropped(load, dealt)
    return out


def contract(edges: DataFrame) -> DataFrame:
    """id, comp: the smallest id of the id's component, for every id with an edge. Each round every
    vertex moves to its smallest neighbour, twice over, and the graph is drawn between the new ones."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
    graph = written(both, "graph")
    labels = written(graph.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while not graph.isEmpty():
        up = written(graph.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "up")
        twice = written(up.join(up.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p").select("v", F.col("pp").alias("p")), "twice")
        left = graph.join(twice.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").select("pa", "b")
        moved = left.join(twice.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b").filter("pa <> pb")
        before = graph, labels
        graph = written(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "graph")
        move = labels.join(twice.withColumnRenamed("v", "comp"), "comp", "left")
        labels = written(move.select("id", F.coalesce("p", "comp").alias("comp")), "labels")
        dropped(up, twice, *before)
    return labels


def _open(members: DataFrame) -> DataFrame:
    """The rows (key, id, comp) of groups whose members are in more than one component."""
    live = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return written(members.join(live, "key"), "open")


def _stars(opened: DataFrame, salt: int) -> DataFrame:
    """(a, ca, b, cb): each member with one leader of its buckets, of another component. Leaders are those
    with the most company in the first pass, and hashed among their bucket's members later."""
    if salt:
        ranked = opened.withColumn("rank", F.xxhash64("id", F.lit(salt)))
    else:
        company = opened.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        mass = opened.select("key", "id").join(company, "key").groupBy("id").agg((-F.sum("m")).alias("rank"))
        ranked = opened.join(mass, "id")
    ranked = written(ranked.select("key", "id", "comp", "rank"), "ranked")
    leads = ranked.groupBy("key").agg(F.min(F.struct("rank", "id", "comp")).alias("l"))
    asks = ranked.join(leads, "key").filter("comp <> l.comp")
    chosen = asks.groupBy("id").agg(F.min("l").alias("l"), F.min("comp").alias("cb"))
    pairs = written(chosen.select(F.col("l.id").alias("a"), F.col("l.comp").alias("ca"), F.col("id").alias("b"), "cb"), "pairs")
    dropped(ranked)
    return pairs


def _prefixes(opened: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """key, id, comp: the members of open buckets by the live shingles of their sets' prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column(3)[i].as_py(), np.uint64).view(np.int64)
                same = [np.full(len(s), batch.column(j)[i].as_py()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (*same, s))], names=["id", "comp", "n", "key"])

    members = written(opened.select("id", "comp").distinct(), "members")
    rows = written(members.join(sets, "id").select("id", "comp", "n", "set").mapInArrow(run, "id bigint, comp bigint, n bigint, key bigint"), "shingles")
    live = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi").select("key", "c")
    # Sets of one id have different sizes or, by the digest of the classes, different members; those of
    # one size are ordered together, so their prefix is taken for each of them.
    mine = rows.join(live, "key").groupBy("id", "comp", "n").agg(F.sort_array(F.collect_set(F.struct("c", "key"))).alias("live"))
    several = sets.groupBy("id", "n").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    room = F.col("n") - F.ceil(F.col("n") * how.percent / 100) + 1
    take = F.when(F.col("texts") > 1, F.size("live")).otherwise(F.greatest(F.lit(0), room - (F.col("n") - F.size("live"))))
    kept = mine.join(several, ["id", "n"], "left").select("id", "comp", F.explode(F.slice("live", F.lit(1), take.cast("int"))).alias("x"))
    out = written(kept.select(F.col("x.key").alias("key"), "id", "comp").distinct(), "prefixes")
    dropped(members, rows)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets without repeats."""
    alls = np.concatenate([*left, *right])
    names, where = np.unique(alls, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    kind = np.float32 if len(alls) < 1 << 24 else np.float64  # counts stay exact
    order = np.argsort(where, kind="stable")
    where, row = where[order], row[order]
    out = np.zeros((len(left), len(right)), kind)
    for at in range(0, len(names), 4096):
        i, j = np.searchsorted(where, (at, at + 4096))
        part = np.zeros((len(left) + len(right), 4096), kind)
        part[row[i:j], where[i:j] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def _cohorts(opened: DataFrame) -> DataFrame:
    """id, cohort: the member with the most company among those an id shares keys with, or that one's own."""
    company = opened.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    mass = opened.join(company, "key").groupBy("id").agg(F.sum("m").alias("mass"))
    ranked = written(opened.join(mass, "id").select("key", "id", "mass"), "ranked")
    best = ranked.groupBy("key").agg(F.max(F.struct("mass", "id")).alias("l"))
    follows = written(ranked.join(best, "key").groupBy("id").agg(F.max("l")["id"].alias("cohort")), "follows")
    out = written(follows.join(follows.select(F.col("id").alias("cohort"), F.col("cohort").alias("to")), "cohort").select("id", F.col("to").alias("cohort")), "cohorts")
    dropped(ranked, follows)
    return out


def _flipped(rows: DataFrame) -> DataFrame:
    """The rows (family, cohort, id, comp, n, set) with, for the set, the keys in which it differs from its
    cohort's center, the shingles of more than half of the cohort."""
    kind = "family bigint, cohort bigint, id bigint, comp bigint, n bigint, h bigint, keys array<bigint>"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column(1)[i].as_py(), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), batch.column(0)[i].as_py())), pa.array(s)], names=["cohort", "key"])

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for s, center in zip(batch.column(6), batch.column(7), strict=True):
                mine = np.frombuffer(s.as_py(), np.uint64).view(np.int64)
                keys.append(np.setxor1d(mine, np.array(center.as_py() or [], np.int64), assume_unique=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(keys, pa.list_(pa.int64()))], names=["family", "cohort", "id", "comp", "n", "h", "keys"])

    sizes = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"))
    counts = rows.select("cohort", "set").mapInArrow(spread, "cohort bigint, key bigint").groupBy("cohort", "key").agg(F.count(F.lit(1)).alias("c"))
    centers = counts.join(sizes, "cohort").filter("2 * c > rows").groupBy("cohort").agg(F.collect_list("key").alias("center"))
    both = rows.join(centers, "cohort", "left").select("family", "cohort", "id", "comp", "n", F.xxhash64("set").alias("h"), "set", "center")
    return written(both.mapInArrow(flip, kind), "flipped")


def _narrowed(opened: DataFrame, members: DataFrame, most: DataFrame, how: Near) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the rows (family, id, comp, n, set): (a, b), components linked for certain; (family, a, ca, b, cb), the
    pairs to compare; and the families left out of these pairs, whose keys bring together more rows than ``most``
    (family, most) allows. Any two linked ids of different components share a key of ``opened``.

    Members of different cohorts are a pair if they share such a key. Members of one cohort are mostly copies of
    one text and share most keys, so there the keys are those in which a set differs from the cohort's center.
    With d such keys and q = (100 - percent) / (100 + percent), a set has the weight w = (d - q * n) / 2; the
    symmetric difference of linked sets is at most q * (n + n'), so they share at least w + w' keys. Where that
    is not positive, each is linked with the member of least weight, by the triangle inequality. Other pairs
    share a key of the first d - max(1, 2 * w) + 1 of the lighter one and of the first d - max(1, w + low) + 1 of
    the heavier one, where low is a bound on the lighter one's weight, and have enough keys after it."""
    p, up, down = how.percent, 100 + how.percent, 100 - how.percent
    cohorts = _cohorts(opened)
    flat = _flipped(members.join(cohorts, "id").select("family", "cohort", "id", "comp", "n", "set"))
    heavy = flat.withColumn("d", F.size("keys").cast("bigint")).withColumn("w", up * F.col("d") - down * F.col("n"))  # 2 * up times the weight
    least = heavy.groupBy("cohort").agg(F.min(F.struct("w", "comp")).alias("l"))
    heavy = heavy.join(least, "cohort")
    sure = heavy.filter("w + l.w <= 0 AND comp <> l.comp").select(F.col("l.comp").alias("a"), F.col("comp").alias("b"))

    who = ["family", "cohort", "id", "h", "comp", "n", "d", "w"]
    rows = heavy.select(*who, F.col("l.w").alias("lw"), F.explode("keys").alias("key"))
    live = rows.groupBy("cohort", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi").select("cohort", "key", "c")
    mine = rows.join(live, ["cohort", "key"]).groupBy(*who, "lw").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("live"))
    # Keys of one component come first: they can link nothing.
    dead = F.col("d") - F.size("live")
    low = F.greatest("lw", F.col("w") - 2 * down * F.floor(100 * F.col("n") / p))
    short = F.col("d") - F.greatest(F.lit(1), F.ceil(F.col("w") / up)) + 1
    long = F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("w") + low) / (2 * up))) + 1
    kept = mine.select(*who, dead.alias("dead"), short.alias("short"), F.posexplode(F.slice("live", F.lit(1), F.greatest(F.lit(0), long - dead).cast("int"))).alias("i", "x"))
    within = written(kept.select(*who, F.col("x.key").alias("key"), (F.col("i") + F.col("dead")).alias("pos"), (F.col("i") + F.col("dead") < F.col("short")).alias("asks")), "within")

    at = written(opened.join(cohorts, "id").join(members.select("family", "id").distinct(), "id"), "at")
    groups = at.groupBy("family", "key", "cohort").agg(F.count(F.lit(1)).alias("c")).groupBy("family", "key")
    tops = written(groups.agg(F.max(F.struct("c", "cohort")).alias("top"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("family", "key", "top", "c"), "tops")
    met = tops.select("family", ((F.col("c") - F.col("top.c")) * F.col("c")).alias("met"))
    met = met.unionByName(within.groupBy("family", "cohort", "key").agg((F.sum(F.col("asks").cast("bigint")) * F.count(F.lit(1))).alias("met")).select("family", "met"))
    dense = met.groupBy("family").agg(F.sum("met").alias("met")).join(most, "family").filter("met > most").select("family")
    dense = written(dense, "dense")

    side = lambda x, *more: [F.col(c).alias(f"{c}_{x}") for c in ("id", "comp", *more)]
    few = within.join(dense, "family", "left_anti")
    fine = ("n", "d", "w", "pos")
    inside = few.filter("asks").select("family", "cohort", "key", *side("a", *fine)).join(few.select("family", "cohort", "key", *side("b", *fine)), ["family", "cohort", "key"])
    need = F.greatest(F.lit(1), F.ceil((F.col("w_a") + F.col("w_b")) / (2 * up)))
    inside = inside.filter(
        (F.col("comp_a") != F.col("comp_b")) & (F.col("w_a") <= F.col("w_b")) & (F.least(F.col("d_a") - F.col("pos_a"), F.col("d_b") - F.col("pos_b")) >= need)
        & (100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
    )
    few = at.join(tops.join(dense, "family", "left_anti"), ["family", "key"]).select("family", "key", "id", "comp", "cohort", F.col("top.cohort").alias("top"))
    across = few.filter("cohort <> top").select("family", "key", *side("a", "cohort")).join(few.select("family", "key", *side("b", "cohort")), ["family", "key"])
    across = across.filter("comp_a <> comp_b AND cohort_a <> cohort_b")
    cols = ("family", "id_a", "comp_a", "id_b", "comp_b")
    pick = lambda a, b: F.when(F.col("id_a") < F.col("id_b"), F.col(a)).otherwise(F.col(b))
    both = inside.select(*cols).unionByName(across.select(*cols))
    pairs = both.select("family", pick("id_a", "id_b").alias("a"), pick("comp_a", "comp_b").alias("ca"), pick("id_b", "id_a").alias("b"), pick("comp_b", "comp_a").alias("cb")).distinct()
    sure, pairs = written(sure.distinct(), "sure"), written(pairs, "narrowed")
    dropped(cohorts, flat, within, at, tops)
    return sure, pairs, dense


def _rest(opened: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """(a, b), linked components, of what stars left. Documents that live shingles connect are a family;
    in a family, members outside the largest component are compared with all members of other components
    on full sets. Small families share calls; a family of more than FAMILY rows or SHINGLES shingles is narrowed
    to pairs. Where these would be more than a comparison of all, it is dealt into blocks, and every two blocks meet."""
    hubs = opened.groupBy("key").agg(F.min("id").alias("a"))
    families = contract(opened.join(hubs, "key").select("a", F.col("id").alias("b")).distinct())
    members = opened.select("id", "comp").distinct().join(families.withColumnRenamed("comp", "family"), "id").join(sets, "id")
    members = written(members.select("family", "id", "comp", "n", "set"), "members")
    comps = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    plan = written(
        comps.groupBy("family").agg(
            F.max(F.struct("c", "comp")).alias("top"), F.greatest(F.ceil(F.sum("c") / FAMILY), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"), F.sum("n").alias("all"),
            F.sum("c").alias("rows"), (F.sum("c") * (F.sum("c") - F.max("c"))).alias("most"),
        ).select("family", F.col("top.comp").alias("top"), "blocks", "all", "rows", "most"),
        "plan",
    )
    wide = plan.filter("blocks > 1").select("family", "blocks", "rows", "most")
    found, used, dense = [], [], None
    if not wide.isEmpty():
        theirs = families.withColumnRenamed("comp", "family").join(wide.select("family"), "family").select("id")
        some = written(members.join(wide.select("family"), "family"), "wide")
        sure, pairs, crowded = _narrowed(opened.join(theirs, "id").select("key", "id", "comp"), some, wide.select("family", "most"), how)
        many = pairs.groupBy("family").agg(F.count(F.lit(1)).alias("pairs")).join(wide, "family").filter(F.col("pairs") > SPARSE * F.col("rows") * F.col("blocks"))
        dense = written(crowded.unionByName(many.select("family")), "dense")
        sizes = some.groupBy("id").agg(F.sum("n").alias("n"))
        asked = pairs.join(dense, "family", "left_anti").join(sizes.withColumnRenamed("id", "b"), "b").select("a", "ca", "b", "cb", "n")
        found = [sure, verify(asked, some.select("id", "n", "set"), how)]
        used = [some, pairs, crowded, dense, *found]
    calls = max(1, -(-(plan.agg(F.sum("all")).first()[0] or 0) // SHINGLES))
    rows = members.join(plan, "family").withColumn("asks", F.col("comp") != F.col("top"))
    cols = ("family", "id", "comp", "n", "set", "asks")
    none = F.lit(None).cast("bigint")
    small = rows.filter("blocks = 1").select(*cols, F.lit(0).alias("at"), none.alias("g"), F.pmod(F.xxhash64("family"), F.lit(calls)).cast("int").alias("l"), F.lit(0).alias("r"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    large = rows.filter("blocks > 1") if dense is None else rows.join(dense, "family", "left_semi")
    large = large.select(*cols, mine.alias("at"), F.col("family").alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    large = large.select(*cols, "at", "g", F.least("at", "o").alias("l"), F.greatest("at", "o").alias("r"))

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        for _, some in pdf.groupby("family", sort=False):
            apart = some["at"].nunique() > 1  # two blocks: pairs inside a block meet elsewhere
            sets_ = [np.frombuffer(x, np.uint64) for x in some["set"]]
            n, comp, asks, at = some.n.to_numpy(), some.comp.to_numpy(), some.asks.to_numpy(bool), some["at"].to_numpy()
            i = np.flatnonzero(asks)
            both = overlaps([sets_[x] for x in i], sets_)
            near = (100 * both >= how.percent * (n[i][:, None] + n[None, :] - both)) & (comp[i][:, None] != comp[None, :])
            if apart:
                near &= at[i][:, None] != at[None, :]
            x, y = np.nonzero(near)
            found |= set(zip(comp[i[x]].tolist(), comp[y].tolist(), strict=True))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    links = small.unionByName(large).groupBy("g", "l", "r").applyInPandas(close, "a bigint, b bigint")
    for more in found:
        links = links.unionByName(more)
    out = written(links.distinct(), "links")
    dropped(families, members, plan, *used)
    return out


def _moved(rows: DataFrame, moves: DataFrame, tag: str) -> DataFrame:
    """``rows`` with ``comp`` replaced by its component in ``moves`` (id, comp), if it has one."""
    to = moves.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    rest = [c for c in rows.columns if c != "comp"]
    return written(rows.join(to, "comp", "left").select(*rest, F.coalesce("to", "comp").alias("comp")), tag)


def link(df: DataFrame, how: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row."""
    docs = written(sketches(df, how, id_col, text_col), "sketches")
    able = docs.filter("n > 0 AND id IS NOT NULL")
    # Ids with several texts: their classes meet in the id.
    classes = written(able.groupBy("cls").agg(F.min("id").alias("rep")), "classes")
    twice = able.groupBy("id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("id")
    tied = written(able.join(twice, "id").join(classes, "cls").select(F.col("id").alias("a"), F.col("rep").alias("b")), "tied")
    reps = able.join(classes.select("cls", F.col("rep").alias("id")), ["cls", "id"]).groupBy("id", "cls").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    sketched = written(reps, "reps")
    docs, full = written(docs.select("id", "n", "cls"), "digests"), docs
    dropped(full)
    all_bands = written(bands(sketched), "bands")
    shared = all_bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key")
    buckets = written(all_bands.join(shared, "key").distinct(), "buckets")
    dropped(all_bands)
    sets = written(full_sets(df, buckets.select("id").distinct(), how, id_col, text_col), "sets")

    # id, comp of the representatives; at first each is alone, but for the tied ones.
    labels = _moved(classes.select("rep", F.col("rep").alias("comp")).distinct(), contract(tied), "labels")
    at = labels.select(F.col("rep").alias("id"), "comp")
    opened = _open(buckets.join(at, "id").select("key", "id", "comp"))
    dropped(buckets)
    for step in range(PASSES + 1):
        if opened.isEmpty():
            break
        if step < PASSES:
            pairs = _stars(opened, step)
            candidates = written(likely(pairs, sketched, how), "likely")
            links = verify(candidates, sets, how)
            dropped(candidates)
        else:
            pairs = _open(_prefixes(opened, sets, how))
            links = _rest(pairs, sets, how)
        moves = contract(links)
        before = labels, opened
        labels = _moved(labels, moves, "labels")
        if step < PASSES:
            moved = _moved(opened, moves, "moved")
            opened = _open(moved)
            dropped(moved)
        dropped(*before, pairs, links, moves)
    dropped(sets, sketched)
    named = written(classes.join(labels, "rep").select("cls", "comp"), "named")
    out = docs.select("id", "n", F.when(F.expr("n > 0 AND id IS NOT NULL"), F.col("cls")).alias("cls")).join(named, "cls", "left")
    comp = F.coalesce("comp", "id")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept")
    )


def one_of_each(df: DataFrame, how: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stay: one document of each component, and of rows with
    one id the first by its text's hash."""
    linked = link(df, how, id_col, text_col)
    gone = written(linked.filter("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_h"))
    texts = rows.filter("_id IS NOT NULL").groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("_h")).filter("n > 1")
    several = written(texts.select("_id", "_h"), "several")
    # The ids to leave out are fewer than those that stay; a null id is never among them.
    single = rows.join(gone, "_id", "left_anti").join(several.select("_id"), "_id", "left_anti").select("row.*")
    # Rows of one id are merged as they are read, however many there are.
    first = rows.join(several.join(gone, "_id", "left_anti"), ["_id", "_h"], "left_semi").groupBy("_id").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(first)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents").select("doc_id", "text"), Near(shingle=3, percent=85))


#: All pairs with a common shingle and sizes that allow the similarity, then everything reachable.
OP2_SQL = """
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM doc),
member AS MATERIALIZED (SELECT rid, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS met FROM member a JOIN member b ON a.x = b.x AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * met >= 85 * (na + nb - met)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rid, rid AS there FROM sets WHERE rid IN (SELECT a FROM edge) UNION SELECT reach.rid, edge.b FROM reach JOIN edge ON edge.a = reach.there),
least_id AS (SELECT reach.rid, min(doc_id) AS c FROM reach JOIN sets ON sets.rid = there GROUP BY reach.rid)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM sets LEFT JOIN least_id USING (rid)"""
