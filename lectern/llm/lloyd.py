"""Exact integer k-means by delta Lloyd rounds.

Vectors are written once as blocks (a few thousand rows, integers in one binary cell) in a table bucketed
by block number. A round's state, also bucketed by block, holds every vector's owner and its squared
distance to it, and the round's signed transfers. The next round joins blocks and state bucket by bucket,
so vectors are shuffled once and never again:

* a vector whose owner did not move keeps its distance and meets the centroids that did move;
* a vector whose owner moved meets all centroids;
* a vector that changes its owner is taken from the old owner's sum and added to the new one's. Transfers
  are summed by Spark as (cluster, component, limb) rows, limbs of 31 bits, so sums are exact at any size
  and what reaches the driver is bounded by clusters times components.

The global sums and counts live beside the centroids: a round costs what moved, and when no centroid moves
the rounds that are left change nothing and are skipped. Where all numbers of a block keep a distance below
2^53 the arithmetic is a matrix product of doubles, exact for integers; other blocks use Python's integers
and compare with all centroids.

Defined results: vectors that are null, of another length or with a null, NaN or infinite component take no
part; repeated rows count each; rows with a null id take part but start no centroid while others can; equal
start hashes go by the vector; fewer vectors than centroids give as many centroids; a distance or inertia
beyond 2^63 is null; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import _folder, dropped, read, shared_dir

BLOCK = 4_096
BUCKET_ROWS = 262_144
LIMB = 31
#: Components up to here keep 2^53 above any squared distance in up to 2^7 dimensions.
NARROW = 1 << 21
BLOCKS = "block bigint, n int, ids binary, vectors binary, wide binary"
STATE = "block bigint, owners binary, distances binary, moves array<struct<c:int,d:int,limb:int,v:bigint>>"


@dataclass(frozen=True)
class Lloyd:
    k: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1024
    salt: str = "3"


def usable(vector: Column, dim: int) -> Column:
    return (F.size(vector) == dim) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def floors(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python's integers where that is too narrow."""
    x = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(x).max(initial=0) < 2**62:
        return x.astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) > 2**53 else math.floor(v * scale)
    return np.array([[exact(v) for v in row] for row in vectors.tolist()], object)


def pack(x: np.ndarray) -> tuple[bytes | None, bytes | None]:
    """Narrow blocks as 32-bit integers, others as decimal text."""
    if x.dtype != object and np.abs(x).max(initial=0) <= NARROW:
        return x.astype(np.int32).tobytes(), None
    return None, " ".join(str(int(v)) for v in x.ravel()).encode()


def unpack(vectors: bytes | None, wide: bytes | None, dim: int) -> np.ndarray:
    if wide is None:
        return np.frombuffer(vectors, np.int32).reshape(-1, dim).astype(np.float64)
    return np.array([int(v) for v in wide.split()], object).reshape(-1, dim)


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared, exact; rows by centroids. Rows are doubles where all fits, else Python's integers."""
    if x.dtype == object or max((abs(v) for c in centroids for v in c), default=0) > NARROW:
        x = x if x.dtype == object else x.astype(np.int64).astype(object)
        return np.stack([((x - np.array(c, object)) ** 2).sum(1) for c in centroids], 1)
    c = np.array(centroids, np.float64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def limbs(sums: dict[int, list[int]]) -> list[dict]:
    """Signed limbs of every cluster's sums; component ``dim`` is the count."""
    out = []
    for c, values in sums.items():
        for d, v in enumerate(values):
            sign, v, at = (-1 if v < 0 else 1), abs(v), 0
            while v:
                if part := v & ((1 << LIMB) - 1):
                    out.append({"c": c, "d": d, "limb": at, "v": sign * part})
                v, at = v >> LIMB, at + 1
    return out


def bucketed(df: DataFrame, buckets: int, tag: str) -> DataFrame:
    """Written to the shared folder, bucketed by block; the catalog's entry goes at once, the files stay
    until ``dropped`` or the session's end."""
    spark = df.sparkSession
    name = f"lectern_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    hadoop, system = _folder(spark, path)
    system.deleteOnExit(hadoop)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    out._lectern_path = path
    return out


def blocks(rows: DataFrame, how: Lloyd) -> DataFrame:
    """(vec_id, v) -> BLOCKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[np.ndarray] = []

        def flush(n: int) -> pa.RecordBatch:
            nonlocal ids, parts, number
            x = np.concatenate(parts)
            vectors, wide = pack(floors(x[:n], how.scale))
            some = pa.array(ids[:n], pa.int64())
            ids, parts = ids[n:], [x[n:]]
            number += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (batch := pa.record_batch([some], names=["id"])).schema) as w:
                w.write_batch(batch)
            columns = [[number - 1], [n], [sink.getvalue().to_pybytes()], [vectors], [wide]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            if batch.num_rows:
                ids += batch.column(0).to_pylist()
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                parts.append(flat.reshape(-1, how.dim))
            while len(ids) >= BLOCK:
                yield flush(BLOCK)
        if ids:
            yield flush(len(ids))

    return rows.select("vec_id", "v").mapInArrow(run, BLOCKS)


def assign(held: DataFrame, state: DataFrame | None, centroids: list[list[int]], moved: set[int]) -> DataFrame:
    """Blocks and the state of the round before -> STATE under these centroids, of which ``moved`` are new."""
    dim = len(centroids[0])
    changed = sorted(moved)

    def one(x: np.ndarray, owners: np.ndarray | None, kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if owners is None or kept is None:
            d = distances(x, centroids)
            new = d.argmin(1)  # the first of equals
            return new, d[np.arange(len(d)), new]
        new, dist = owners.copy(), kept.astype(np.float64)
        lost = np.isin(owners, changed)
        if lost.any():
            d = distances(x[lost], centroids)
            new[lost] = d.argmin(1)
            dist[lost] = d.min(1)
        if changed and not lost.all():
            stay = np.flatnonzero(~lost)
            d = distances(x[stay], [centroids[c] for c in changed])
            near = d.argmin(1)
            least, who = d[np.arange(len(d)), near], np.array(changed)[near]
            wins = (least < dist[stay]) | ((least == dist[stay]) & (who < new[stay]))
            new[stay[wins]], dist[stay[wins]] = who[wins], least[wins]
        return new, dist

    def transfers(x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> list[dict]:
        went = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
        x = x[went] if x.dtype == object else x[went].astype(np.int64)
        sums: dict[int, list[int]] = {}
        for sign, side in ((1, new[went]), *(((-1, old[went]),) if old is not None else ())):
            for c in np.unique(side).tolist():
                mine = x[side == c]
                total = [sign * int(v) for v in mine.sum(0)] + [sign * len(mine)]
                sums[c] = [a + b for a, b in zip(sums.get(c, [0] * (dim + 1)), total, strict=True)]
        return limbs(sums)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                x = unpack(row.vectors, row.wide, dim)
                old = kept = None
                if row.owners is not None:
                    old = np.frombuffer(row.owners, np.uint16).astype(np.int64)
                    kept = np.frombuffer(row.distances, np.int64) if row.distances is not None else None
                new, dist = one(x, old, kept)
                fits = max(dist.max(), 0) < 2**53
                yield pd.DataFrame({"block": [row.block], "owners": [new.astype(np.uint16).tobytes()], "distances": [dist.astype(np.int64).tobytes() if fits else None], "moves": [transfers(x, old, new)]})

    if state is None:
        pairs = held.select("block", "vectors", "wide", F.lit(None).cast("binary").alias("owners"), F.lit(None).cast("binary").alias("distances"))
    else:
        pairs = held.select("block", "vectors", "wide").join(state.select("block", "owners", "distances").hint("shuffle_hash"), "block")
    return pairs.mapInPandas(run, STATE)


def first_centroids(rows: DataFrame, how: Lloyd) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{how.salt}:"), F.col("vec_id").cast("string")), 256)
    some = rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(how.k).collect()
    return [[int(v) for v in floors(np.array([r.v]), how.scale)[0]] for r in some]


def cluster(rows: DataFrame, how: Lloyd | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id bigint, v array of numbers) -> (vec_id, cluster, distance, wide distance as text) and the
    final centroids."""
    how = how or Lloyd()
    spark = rows.sparkSession
    rows = rows.filter(usable(F.col("v"), how.dim)).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    centroids = first_centroids(rows, how)
    if not centroids:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, wide string"), []
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_ROWS))
    held = bucketed(blocks(rows, how).repartition(buckets, "block"), buckets, "vectors")
    sums = [[0] * (how.dim + 1) for _ in centroids]
    state, moved = None, set(range(len(centroids)))
    for turn in range(how.rounds + 1):
        before, state = state, bucketed(assign(held, state, centroids, moved), buckets, "owners")
        if before is not None:
            dropped(before)
        if turn == how.rounds:
            break
        move = F.explode("moves").alias("m")
        for r in state.select(move).select("m.*").groupBy("c", "d", "limb").agg(F.sum("v").alias("v")).collect():  # clusters * components
            sums[r.c][r.d] += r.v << (LIMB * r.limb)
        fresh = [[v // s[-1] for v in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids, strict=True)]
        moved = {i for i, (a, b) in enumerate(zip(fresh, centroids, strict=True)) if a != b}
        centroids = fresh
        if not moved:
            break
    final = centroids

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                ids = pa.ipc.open_stream(row.ids).read_all().column(0).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                owners = np.frombuffer(row.owners, np.uint16).astype(np.int32)
                out = pd.DataFrame({"vec_id": ids, "cluster": owners, "distance": pd.array([pd.NA] * len(owners), pd.Int64Dtype()), "wide": None})
                if row.distances is not None:
                    out["distance"] = pd.array(np.frombuffer(row.distances, np.int64), pd.Int64Dtype())
                else:
                    far = distances(unpack(row.vectors, row.wide, how.dim), final).min(1)
                    out["wide"] = [str(int(v)) for v in far]
                    out["distance"] = pd.array([int(v) if v < 2**63 else pd.NA for v in far], pd.Int64Dtype())
                yield out

    # Vectors are needed again only where distances do not fit the state.
    narrow = F.col("distances").isNotNull()
    pairs = held.join(state.select("block", "owners", "distances").hint("shuffle_hash"), "block")
    pairs = pairs.select("ids", "owners", "distances", F.when(~narrow, F.col("vectors")).alias("vectors"), F.when(~narrow, F.col("wide")).alias("wide"))
    return pairs.mapInPandas(spread, "vec_id bigint, cluster int, distance bigint, wide string"), centroids


def summed(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Rows of ``cluster`` with the inertias and the centroid's digest."""
    spark = rows.sparkSession
    # Sums of 31-bit limbs are exact; one row a cluster and limb reaches the driver.
    limb = lambda i: F.shiftrightunsigned("distance", LIMB * i).bitwiseAND(F.lit((1 << LIMB) - 1))
    per = rows.groupBy("cluster").agg(*(F.sum(limb(i)).alias(f"l{i}") for i in range(3)), F.max(F.col("distance").isNull()).alias("beyond"))
    total: dict[int, int | None] = {}
    for r in per.collect():
        total[r["cluster"]] = None if r.beyond else sum((r[f"l{i}"] or 0) << (LIMB * i) for i in range(3))
    whole = None if None in total.values() else sum(total.values())
    fit = lambda v: v if v is not None and v < 2**63 else None
    known = [(c, fit(total.get(c)), fit(whole), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.drop("wide").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return summed(*cluster(rows))


def op13_sql(how: Lloyd | None = None) -> str:
    """The rounds written one after the other."""
    how = how or Lloyd()
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    assigned = lambda r: (
        f"a{r} AS MATERIALIZED (SELECT rid, vec_id, v.e, c, ({dot('v.e', 'v.e')} - 2 * {dot('v.e', 'k.e')} + {dot('k.e', 'k.e')})::BIGINT AS d FROM v, c{r} k "
        f"QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"
    )
    moved = lambda r: (
        f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, k.e) AS e FROM c{r} k LEFT JOIN (SELECT c, list(floor_of ORDER BY i) AS e FROM (SELECT c, i, "
        f"((s - ((s % n) + n) % n) // n)::DOUBLE AS floor_of FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM "
        f"(SELECT c, unnest(e)::BIGINT AS x, unnest(range(len(e))) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c) m USING (c))"
    )
    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(how.rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({how.scale} * x::DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) = {how.dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, e) - 1)::INTEGER AS c, e
    FROM (SELECT sha256('{how.salt}:' || vec_id::VARCHAR) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {how.k})),
{steps},
{assigned(how.rounds)}
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(k.e, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{how.rounds} JOIN c{how.rounds} k USING (c)"""
