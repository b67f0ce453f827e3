"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are dealt into bounded blocks by a hash of the id, and a cover tree is built once for
each block of either side and written as a table. Level l of a tree has radius R / BASE ** l: its
centers are farther apart than that (separation), each center stays one on all finer levels
(nesting), and every point of a node is within the radius of the node's center at its level (covering).
A node of at most LEAF points, or one that the next level would break into more than FAN centers or a
quarter of its points, is a leaf; each node keeps its measured covering radius.

Every query block meets every data block (a stated query set against all rows, in blocks). A pair of
nodes is pruned when no product between them can reach the worst kth score of the query node's queries;
the bound of q.x over balls (a, r) and (b, s) is a.b + |a| s + |b| r + r s. Leaves are compared exactly.
A first pass of each query block over one data block gives every query a kth score that all other
pairs start from, so pruning reaches across blocks. The best of every pair are merged by a ranking
per query.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part, nor do
null ids; a query meets the vectors of its own length only; rows with the query's id are not its
candidates; repeated rows are candidates each; ties go to the smaller id; fewer candidates than k are
all returned; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import read, written

LEAF, FAN, BASE = 64, 256, 1.5
DATA_BLOCK, QUERY_BLOCK = 16_384, 2_048
TREE = "dim int, block bigint, size bigint, ids binary, vectors binary, nodes binary"
#: A node in a tree's table: center, level, rows [start, stop) of the permuted block, children [child, last).
NODE = np.dtype([("center", "i8"), ("level", "i8"), ("start", "i8"), ("stop", "i8"), ("child", "i8"), ("last", "i8"), ("radius", "f8")])


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): a permutation of the rows in which each node's rows are a range, and the nodes, by
    level; centers are rows of ``x``."""
    far = lambda rows, c: np.sqrt(((x[rows] - x[c]) ** 2).sum(1))
    everything = np.arange(len(x))
    top = float(far(everything, 0).max())
    tree = [{"center": 0, "level": 0, "rows": everything, "children": []}]
    current, level = [0], 0
    while current and top:
        level += 1
        radius = top / BASE**level
        found: list[int] = []  # centers of this level
        fresh = []
        for at in current:
            rows, most = tree[at]["rows"], min(max(8, len(tree[at]["rows"]) // 4), FAN)
            if len(rows) <= LEAF:
                continue
            near, owner = far(rows, tree[at]["center"]), np.zeros(len(rows), np.int64)
            if not near.any():
                continue  # copies of one vector
            picks, lent = [tree[at]["center"]], []
            while near.max() > radius and len(picks) <= most:
                i = int(near.argmax())
                others = far(np.array(found), rows[i]) if found else np.empty(0)
                if len(others) and others.min() <= radius:
                    lent.append((i, found[int(others.argmin())]))  # a neighbour's center covers it
                    near[i], owner[i] = 0, -1
                    continue
                d = far(rows, rows[i])
                closer = (d < near) & (owner >= 0)
                near[closer], owner[closer] = d[closer], len(picks)
                picks.append(int(rows[i]))
            if len(picks) > most:
                continue
            for k, c in enumerate(picks):
                fresh.append([at, c, [rows[owner == k]]])
            for i, c in lent:
                next(n for n in fresh if n[1] == c)[2].append(rows[[i]])
            found += picks
        current = []
        for parent, c, parts in fresh:
            tree.append({"center": c, "level": level, "rows": np.concatenate(parts), "children": []})
            tree[parent]["children"].append(len(tree) - 1)
            current.append(len(tree) - 1)
    # A node's rows are those of its children: a lent point counts for the one that covers it. Children
    # come after their parent in the list, so one pass from its end, one in depth-first order, place all.
    order: list[np.ndarray] = []
    nodes = np.zeros(len(tree), NODE)
    number, size, todo, ends = {0: 0}, 0, [0], []
    next_number = 1
    while todo:
        at = todo.pop()
        if at < 0:
            ends.append((number[~at], size))
            continue
        node, n = tree[at], number[at]
        nodes[n]["center"], nodes[n]["level"], nodes[n]["start"] = node["center"], node["level"], size
        nodes[n]["child"], nodes[n]["last"] = next_number, next_number + len(node["children"])
        for c in node["children"]:
            number[c] = next_number
            next_number += 1
        todo.append(~at)
        if node["children"]:
            todo += node["children"][::-1]
        else:
            order.append(node["rows"])
            size += len(node["rows"])
    for n, end in ends:
        nodes[n]["stop"] = end
    flat = np.concatenate(order)
    for node in nodes:
        # Measured over what lies below, so that pruning is exact whoever covers a point.
        node["radius"] = far(flat[node["start"] : node["stop"]], node["center"]).max() * (1 + 1e-9)
    return flat, nodes


class Side:
    """A block with its tree: rows in the tree's order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray):
        self.ids, self.x, self.nodes = ids, x, nodes
        self.f = x.astype(np.float64)
        self.centers = self.f[nodes["center"]]
        self.norms = np.sqrt((self.centers**2).sum(1))
        self.spans = list(zip(nodes["start"].tolist(), nodes["stop"].tolist(), strict=True))
        self.children = [range(a, b) for a, b in zip(nodes["child"].tolist(), nodes["last"].tolist(), strict=True)]
        self.radius = nodes["radius"]

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray) -> Side:
        order, nodes = cover_tree(x.astype(np.float64))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes["center"] = place[nodes["center"]]
        return Side(ids[order], x[order], nodes)


def search(q: Side, x: Side, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, one row of k for each query in the order of its side; id -1 where there are fewer.
    ``floor``: a kth score that each query is known to reach; what is below it may be left out."""
    exact = float(np.abs(q.f).max(initial=0)) * float(np.abs(x.f).max(initial=0)) * q.x.shape[1] < 2**53
    qi, xi = (q.f, x.f) if exact else (q.x, x.x)
    least = -np.inf if exact else np.iinfo(np.int64).min
    scores = np.full((len(q.ids), k), least, qi.dtype)
    ids = np.full((len(q.ids), k), -1, np.int64)
    floor = np.full(len(q.ids), -np.inf) if floor is None else floor
    worst = floor.copy()

    def bounds(a: int, some: range) -> np.ndarray:
        """Of a query node against data nodes that follow each other."""
        s = slice(some.start, some.stop)
        top = x.centers[s] @ q.centers[a] + q.norms[a] * x.radius[s] + x.norms[s] * q.radius[a] + q.radius[a] * x.radius[s]
        return top + 1e-6 * np.abs(top) + 1e-6  # the slack covers rounding

    def leaves(a: int, b: int) -> None:
        (i, j), (u, v) = q.spans[a], x.spans[b]
        s = qi[i:j] @ xi[u:v].T
        mine = q.ids[i:j, None] == x.ids[None, u:v]
        if mine.any():
            s[mine] = least
        # Strictly below the worst: an equal score may still win by its id.
        rows = np.flatnonzero((s >= worst[i:j, None]).any(1))
        if not len(rows):
            return
        got = np.where(mine[rows], -1, np.broadcast_to(x.ids[u:v], (len(rows), v - u)))
        s = np.concatenate([scores[i + rows], s[rows]], 1)
        got = np.concatenate([ids[i + rows], got], 1)
        order = np.lexsort((got, -s if exact else ~s, got == -1), axis=1)[:, :k]
        scores[i + rows] = np.take_along_axis(s, order, 1)
        ids[i + rows] = np.take_along_axis(got, order, 1)
        last = np.where(ids[i + rows][:, -1] == -1, -np.inf, scores[i + rows][:, -1].astype(np.float64))
        worst[i + rows] = np.maximum(floor[i + rows], last)

    def visit(a: int, b: int) -> None:
        if q.children[a] and (not x.children[b] or q.radius[a] > x.radius[b]):
            for c in q.children[a]:
                if bounds(c, range(b, b + 1))[0] >= worst[slice(*q.spans[c])].min():
                    visit(c, b)
        elif x.children[b]:
            top = bounds(a, x.children[b])
            for i in np.argsort(-top):
                if top[i] < worst[slice(*q.spans[a])].min():
                    break
                visit(a, x.children[b][i])
        else:
            leaves(a, b)

    if len(q.ids) and len(x.ids):
        visit(0, 0)
    return scores, ids


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )


def trees(rows: DataFrame, block_rows: int) -> DataFrame:
    """(vec_id, v) -> TREE: a row for each block."""
    blocks = max(1, -(-rows.count() // block_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        side = Side.of(pdf.vec_id.to_numpy(np.int64), np.stack(pdf.v.to_list()).astype(np.int64))
        return pd.DataFrame({"dim": [int(pdf.dim.iloc[0])], "block": [int(pdf.block.iloc[0])], "size": [len(pdf)], "ids": [side.ids.tobytes()], "vectors": [side.x.tobytes()], "nodes": [side.nodes.tobytes()]})

    dealt = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).filter("dim > 0")
    return dealt.groupBy("dim", "block").applyInPandas(build, TREE)


def top_k(queries: DataFrame, data: DataFrame, k: int = 10) -> DataFrame:
    """Both: (vec_id bigint, v array<bigint>). -> query_id, rank, vec_id, score."""
    left = written(trees(queries, QUERY_BLOCK), "qtrees")
    right = written(trees(data, DATA_BLOCK), "trees")
    names = ("dim", "size", "ids", "vectors", "nodes")
    asked = left.select("dim", F.col("block").alias("q"), *(F.col(c).alias(f"q_{c}") for c in names[1:]))
    held = right.select("dim", F.col("block").alias("d"), *names[1:])

    def run(pdf: pd.DataFrame, with_floor: bool) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            side = lambda p: Side(
                np.frombuffer(getattr(row, f"{p}ids"), np.int64), np.frombuffer(getattr(row, f"{p}vectors"), np.int64).reshape(-1, row.dim), np.frombuffer(getattr(row, f"{p}nodes"), NODE)
            )
            q, x = side("q_"), side("")
            floor = np.frombuffer(row.floor, np.float64) if with_floor and row.floor is not None else None
            scores, ids = search(q, x, k, floor)
            if not with_floor:
                kth = np.where(ids[:, -1] == -1, -np.inf, scores[:, -1].astype(np.float64))
                out.append(pd.DataFrame({"dim": [row.dim], "q": [row.q], "floor": [kth.tobytes()]}))
            else:
                got = ids != -1
                out.append(pd.DataFrame({"query_id": np.repeat(q.ids, got.sum(1)), "vec_id": ids[got], "score": scores[got].astype(np.int64)}))
        return pd.concat(out)

    def each(with_floor: bool):
        def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for i in range(len(pdf)):
                    yield run(pdf.iloc[i : i + 1], with_floor)

        return stream

    # The data block that a query block starts with: those of its length, dealt around.
    there = held.groupBy("dim").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # numbers of blocks only
    home = asked.join(there, "dim").withColumn("d", F.get("ds", F.pmod("q", F.size("ds")).cast("int"))).drop("ds")
    floors = written(home.join(held, ["dim", "d"]).mapInPandas(each(False), "dim int, q bigint, floor binary"), "floors")
    pairs = asked.join(floors, ["dim", "q"], "left").join(there, "dim").withColumn("d", F.explode("ds")).drop("ds")
    best = pairs.join(held, ["dim", "d"]).mapInPandas(each(True), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    data = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("bigint")).alias("v"))
    return top_k(data.filter("vec_id % 100 = 0"), data)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS cand, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand)::INTEGER AS rank, cand AS vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand) <= 10"""
