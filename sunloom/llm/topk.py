"""Exact top-k inner-product search with dual cover trees.

Vectors are dealt into blocks of neighbours (by the nearest of a few pivots, large
cells by a hash as well), queries likewise, and a cover tree is built once over
each block.  The trees' roots are the upper level: each block of queries first
meets the block of vectors with the best bound, and of the others only those that
its worst k-th score so far does not rule out.  Inside a pair of blocks both trees
are descended together; a pair of nodes is pruned when even the best inner
product that their covering radii allow is below the worst k-th score of the
query node's queries.  The k best of all pairs are merged per query.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

K, SCALE = 5, 256.0
QUERY_BLOCK, VECTOR_BLOCK = 4096, 8192
#: Vectors of a bounded sample whose neighbours make up the blocks' cells.
PIVOTS = 64
_LEAF, _SHRINK = 96, 0.7
_LONG = (1 << 63) - 1
#: Bits of a packed score that hold the place of its vector in a block.
_PLACE = 20


class Node:
    __slots__ = ("center", "children", "norm", "points", "radius")

    def __init__(self, points: np.ndarray, x: np.ndarray, depth: int = 0):
        self.points, self.children = points, []
        self.center = x[points[0]].copy()
        far = np.sqrt(((x[points] - self.center) ** 2).sum(1))
        self.radius, self.norm = float(far.max()), float(np.sqrt((self.center**2).sum()))
        if len(points) <= _LEAF or self.radius == 0 or depth > 60:
            return
        # Children cover the points within a smaller radius, their centres are farther apart than it.  Points that would
        # be alone stay together in leaves.
        rest, limit, lone, groups = points, self.radius * _SHRINK, [], []
        while len(rest):
            d = np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(1))
            inside = d <= limit
            if inside.sum() < max(2, _LEAF // 8):
                lone.append(rest[inside])
            else:
                groups.append(rest[inside])
            rest = rest[~inside]
            if len(lone) > 64:  # scattered points: no centre covers many
                lone.append(rest)
                break
        if len(groups) <= 1 and not lone:
            return
        self.children = [Node(g, x, depth + 1) for g in groups if len(g) < len(points)]
        if lone:
            left = np.concatenate(lone)
            if len(left) == len(points):
                self.children = []
                return
            self.children += [Node(left[k : k + 8 * _LEAF], x, 61) for k in range(0, len(left), 8 * _LEAF)]


class Block:
    """Vectors of whole numbers (as doubles) in the order of their ids, and their tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by], x[by]
        self.root = Node(np.arange(len(ids)), self.x)


def dual_search(a: Block, b: Block, k: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places in b), one row per query of a, best first, places -1 where there are fewer than k.

    Ties go to the smaller place.  Vectors with the query's id don't count.  least: every query has k scores of at least
    this elsewhere, so smaller ones need not be found.  Sums too large for exact floating point are added up as Python's
    whole numbers, by the same descent.
    """
    top = np.abs(a.x).max(initial=0.0) * np.abs(b.x).max(initial=0.0) * a.x.shape[1]
    wide = top >= 1 << 42
    exact = object if wide else np.float32 if top < 1 << 24 else np.float64
    whole = (lambda x: np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)) if wide else lambda x: x.astype(exact)
    qx, vx = whole(a.x), whole(b.x)
    # One number orders by score, then by place.
    low = -(1 << 2200) if wide else np.int64(-(1 << 62))
    best = np.full((len(qx), k), low, object if wide else np.int64)
    mask = (1 << _PLACE) - 1
    assert len(vx) <= mask
    floor = None if least is None else int(least)

    def bound(m: Node, n: Node) -> float:
        return float(m.center @ n.center) + m.norm * n.radius + n.norm * m.radius + m.radius * n.radius

    heap, tick = [(-bound(a.root, b.root), 0, a.root, b.root)], 0
    while heap:
        up, _, m, n = heapq.heappop(heap)
        worst = best[m.points, k - 1].min()
        worst = worst >> _PLACE if worst > low else None
        worst = worst if floor is None else floor if worst is None else max(worst, floor)
        # (The slack is for rounding; it raises a bound of either sign, so a pair that can only tie is looked at too.)
        if worst is not None and -up + 1e-9 * abs(up) + 1e-6 < worst:
            continue
        if m.children or n.children:
            for x in (m.children if m.children and (m.radius >= n.radius or not n.children) else [m]):
                for y in (n.children if n.children and (n.radius > m.radius or not m.children) else [n]):
                    tick += 1
                    heapq.heappush(heap, (-bound(x, y), tick, x, y))
            continue
        score = qx[m.points] @ vx[n.points].T
        key = ((score if wide else score.astype(np.int64)) << _PLACE) | (mask - n.points)[None, :].astype(best.dtype)
        key[a.ids[m.points][:, None] == b.ids[n.points][None, :]] = low
        if key.shape[1] > k and not wide:
            key = -np.partition(-key, k - 1, axis=1)[:, :k]
        both = np.sort(np.concatenate((best[m.points], key), axis=1), axis=1)[:, ::-1]
        best[m.points] = both[:, :k]
    none = best == low
    return best >> _PLACE, np.where(none, -1, mask - (best & mask)).astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(len(flat), len(flat[0]) if len(flat) else 0)


def _cells(rows: DataFrame, n: int) -> DataFrame:
    """rows with their cell: the nearest of PIVOTS sampled vectors of their length; all in one while they fit in a block."""
    if n <= VECTOR_BLOCK:
        return rows.withColumn("cell", F.lit(0))
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOTS).collect():
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    tables = {d: np.array(x) for d, x in pivots.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            dims = b.column(2).to_numpy()
            for d, p in tables.items():
                at = np.flatnonzero(dims == d)
                for k in range(0, len(at) if d else 0, 4096):
                    some = at[k : k + 4096]
                    x = _matrix(pa.chunked_array([b.column(1).take(pa.array(some))]))
                    cell[some] = ((p**2).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return rows.mapInArrow(nearest, "id long, v array<double>, dim int, cell int")


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """(dim, <prefix>cell, <prefix>sub, <prefix>data, <prefix>center, <prefix>radius, <prefix>norm, <prefix>n): a row per block, written with its tree."""

    def build(t: pa.Table) -> pa.Table:
        block = Block(t["id"].to_numpy(), _matrix(t["v"]))
        r = block.root
        return pa.table({
            "dim": t["dim"][:1], "cell": t["cell"][:1], "sub": t["sub"][:1], "data": pa.array([pickle.dumps(block, 5)], pa.binary()),
            "center": pa.array([r.center.tolist()], pa.list_(pa.float64())), "radius": pa.array([r.radius]), "norm": pa.array([r.norm]), "n": pa.array([len(block.ids)], pa.int64()),
        })

    per = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("subs"))
    dealt = rows.join(per, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id", "v"), F.col("subs")).cast("int")).select("id", "v", "dim", "cell", "sub")
    made = dealt.groupBy("dim", "cell", "sub").applyInArrow(build, "dim int, cell int, sub int, data binary, center array<double>, radius double, norm double, n long")
    return saved(made.withColumnsRenamed({c: prefix + c for c in ("cell", "sub", "data", "center", "radius", "norm", "n")}))


def _bound() -> Column:
    """The best inner product that two blocks can have."""
    dot = F.aggregate(F.zip_with("q_center", "v_center", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot + F.col("q_norm") * F.col("v_radius") + F.col("v_norm") * F.col("q_radius") + F.col("q_radius") * F.col("v_radius")


_PAIR = ["dim", "q_cell", "q_sub", "v_cell", "v_sub"]


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k largest integer inner products of floor(scale * x) for each query.

    Queries are the vectors whose id is divisible by `every`, candidates all vectors with another id; ties go to the
    smaller id.  Vectors that are null or hold a null or non-finite component, and null ids, take no part, and vectors
    of different lengths aren't compared.  Rows equal in id and vector are one; if an id has several vectors, each is a
    candidate and each, as a query, has its own ranks.  Scores beyond a long are cut to its range.  An empty table gives
    an empty result; other columns are ignored.
    """
    ok = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(ok)
    whole = lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  (larger doubles are whole)
    rows = rows.select("id", F.transform("v", lambda x: whole(x * scale)).alias("v")).distinct().select("id", "v", F.size("v").alias("dim"))
    placed = saved(_cells(rows, vectors.count()))
    v_blocks, q_blocks = _blocks(placed, VECTOR_BLOCK, "v_"), _blocks(placed.where(F.col("id") % every == 0), QUERY_BLOCK, "q_")
    # The stated queries against all rows, block by block: here only the blocks' roots meet.
    pairs = saved(q_blocks.drop("q_data").join(v_blocks.drop("v_data"), "dim").select(*_PAIR, _bound().alias("bound")))
    first = pairs.groupBy(*_PAIR[:3]).agg(F.max(F.struct("bound", "v_cell", "v_sub")).alias("b")).select(*_PAIR[:3], "b.v_cell", "b.v_sub", F.lit(None).cast("double").alias("least"))

    def search(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "score": []}
        for q, v, least in zip(t["q_data"].to_pylist(), t["v_data"].to_pylist(), t["least"].to_pylist(), strict=True):
            a, b = pickle.loads(q), pickle.loads(v)
            scores, places = dual_search(a, b, k, least)
            for row, column in zip(*np.nonzero(places >= 0), strict=True):
                out["query_id"].append(int(a.ids[row]))
                out["query"].append(a.x[row].tobytes())
                out["vec_id"].append(int(b.ids[places[row, column]]))
                out["score"].append(max(-_LONG, min(_LONG, int(scores[row, column]))))
        n = len(out["score"])
        same = {c: pa.array([t[c][0].as_py()] * n, pa.int32()) for c in _PAIR[:3]}
        return pa.table(same | {"query_id": pa.array(out["query_id"], pa.int64()), "query": pa.array(out["query"], pa.binary()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    def searched(chosen: DataFrame) -> DataFrame:
        met = chosen.join(q_blocks.select(*_PAIR[:3], "q_data"), _PAIR[:3]).join(v_blocks.select("dim", *_PAIR[3:], "v_data"), ["dim", *_PAIR[3:]])
        return met.groupBy(*_PAIR).applyInArrow(search, "dim int, q_cell int, q_sub int, query_id long, query binary, vec_id long, score long")

    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    found = saved(searched(first))
    # A block of queries has its worst k-th score as soon as all its queries have k; till then nothing is ruled out.
    kth = found.groupBy(*_PAIR[:3], "query_id", "query").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    least = kth.groupBy(*_PAIR[:3]).agg(F.count("*").alias("have"), F.min("n").alias("n"), F.min("low").cast("double").alias("low"))
    rest = pairs.join(first.drop("least"), _PAIR, "left_anti").join(least, _PAIR[:3], "left").join(q_blocks.select(*_PAIR[:3], "q_n"), _PAIR[:3])
    told = F.when((F.col("n") >= k) & (F.col("have") == F.col("q_n")), F.col("low"))
    rest = rest.withColumn("least", told).where(F.col("least").isNull() | (F.col("bound") + 1e-9 * F.abs("bound") + 1e-6 >= F.col("least"))).select(*_PAIR, "least")
    every_one = found.unionByName(searched(rest))
    return every_one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
