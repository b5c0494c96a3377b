"""Exact top-k inner products by best-first search over a distributed M-tree.

Routing nodes have a pivot, a covering radius, the largest norm below them and the
distance to their parent's pivot. There are two routing levels, each of about the
root of the number of leaves; leaves hold about ``capacity`` vectors and so grow in
number with the table, up to ``MAX_LEAVES`` (1e9 vectors at 16,384 a leaf), which
bounds what the driver and each task hold of the tree. A leaf's entries lie in order
of their distance to its pivot, in pages of ``PAGE``.

For vectors q, x and a pivot p, |q - x| is at least |d(q, p) - d(p, x)|, so the inner
product is at most (|q|^2 + |x|^2 - that gap squared) / 2. The bound is taken from
stored distances alone: for a child node from its distance to the parent before its
own distance is computed, for a page from the distances of its entries, and for
single entries; whatever lies below a query's k-th best score so far is left out.

Search takes two rounds. Every query first goes to the leaves of highest bound,
which gives its k-th best score so far; then to just the leaves whose bound reaches
that score. Within a leaf each query takes the pages from a heap, best bound first,
until the best one left cannot add anything. Leaves of more than ``SPLIT`` entries
(copies of one vector, say) are dealt over several tasks, and so are query sets of
more than ``CHUNK`` rows, so no task holds more than one share of each.

Edge cases: null vectors and vectors with null or non-finite components, and rows
without an id, take no part; shorter vectors count as padded with zeros; fewer than k
candidates give fewer rows; equal scores go to the smaller id; rows that share a
vec_id are one candidate, whose score is the largest among them; an empty table gives
no rows; other columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import one_blas_thread, stage

PAGE = 128
SPLIT = 1 << 15
CHUNK = 1 << 16
MAX_LEAVES = 1 << 16
FIRST = 2  # leaves that a query reads first


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): each component as floor(scale * x); unusable vectors are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return ok.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    ends = np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends, sizes)):
        out[i, :size] = flat[end - size : end]
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(1))


def _slack(x):
    return 1e-6 * (1 + np.abs(x))


def _bound(q_norm, x_norm, gap):
    """Largest inner product of vectors of these norms that are at least ``gap`` apart; a little more, for rounding."""
    b = (q_norm**2 + x_norm**2 - np.maximum(gap, 0) ** 2) / 2
    return b + _slack(b)


class Tree:
    """The routing nodes. ``leaf_of[i]`` are the leaves below upper node ``i``, next to one another."""

    def __init__(self, dim: int, upper: np.ndarray, pivots: np.ndarray, parent: np.ndarray):
        order = np.argsort(parent, kind="stable")
        self.dim, self.upper, self.pivots, self.parent = dim, upper, pivots[order], parent[order]
        self.to_parent = np.sqrt(((self.pivots - upper[self.parent]).astype(float) ** 2).sum(1))
        edge = np.searchsorted(self.parent, np.arange(len(upper) + 1))
        self.leaf_of = [np.arange(a, b) for a, b in zip(edge, edge[1:])]
        self.radius, self.norm, self.rows = (np.zeros(len(pivots)) for _ in range(3))
        self.upper_radius, self.upper_norm = np.zeros(len(upper)), np.full(len(upper), -np.inf)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to its pivot, distance to the upper pivot): down the nearest pivot of each level."""
        far = _distances(x, self.upper)
        top = far.argmin(1)
        leaf, dist = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for i in np.unique(top):
            own = np.flatnonzero(top == i)
            d = _distances(x[own], self.pivots[self.leaf_of[i]])
            near = d.argmin(1)
            leaf[own], dist[own] = self.leaf_of[i][near], d[np.arange(len(own)), near]
        return leaf, dist, far[np.arange(len(x)), top]

    def reach(self, q: np.ndarray, floor: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows of ``q``, bounds) wherever a leaf may hold a score of at least the row's ``floor``."""
        qn, far, out = _norms(q), _distances(q, self.upper), []
        top = _bound(qn[:, None], self.upper_norm[None, :], far - self.upper_radius[None, :])
        for i in np.flatnonzero((top >= floor[:, None]).any(0)):
            leaves = self.leaf_of[i][self.rows[self.leaf_of[i]] > 0]
            live = np.flatnonzero(top[:, i] >= floor)
            # From the stored distance to the parent alone, then from the leaf's own pivot.
            gap = np.abs(far[live, i][:, None] - self.to_parent[leaves][None, :]) - self.radius[leaves][None, :]
            may = _bound(qn[live][:, None], self.norm[leaves][None, :], gap) >= floor[live][:, None]
            keep = may.any(0)
            leaves, may = leaves[keep], may[:, keep]
            if not len(leaves):
                continue
            d = _distances(q[live], self.pivots[leaves])
            by_gap = _bound(qn[live][:, None], self.norm[leaves][None, :], d - self.radius[leaves][None, :])
            by_pivot = q[live].astype(float) @ self.pivots[leaves].T.astype(float) + qn[live][:, None] * self.radius[leaves][None, :]
            bound = np.minimum(by_gap, by_pivot + _slack(by_pivot))
            for j, leaf in enumerate(leaves.tolist()):
                ok = may[:, j] & (bound[:, j] >= floor[live])
                if ok.any():
                    out.append((leaf, live[ok], bound[ok, j]))
        return out


def build(vectors: DataFrame, capacity: int = 1024) -> tuple[Tree, DataFrame]:
    """The routing nodes and the entries (vec_id, leaf, dist, norm, bytes) of every row of (vec_id, v).

    Pivots are the rows of smallest hash: a sample of at most ``MAX_LEAVES`` rows.
    """
    n, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    want = max(1, min(MAX_LEAVES, n // capacity))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    few = vectors.where(place < int((1 << 40) * min(1.0, (want * 1.2 + 50) / max(n, 1))))
    sample = few.orderBy(place, "vec_id").limit(want).collect() or vectors.orderBy("vec_id").limit(1).collect()
    pivots = np.zeros((max(1, len(sample)), dim), dtype=np.int64)
    for i, r in enumerate(sample):
        pivots[i, : len(r["v"])] = r["v"]
    pivots = np.unique(pivots, axis=0)
    upper = pivots[np.random.default_rng(5).permutation(len(pivots))[: max(1, int(len(pivots) ** 0.5))]]
    tree = Tree(dim, upper, pivots, _distances(pivots, upper).argmin(1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            leaf, dist, up = tree.place(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in (leaf, dist, up, _norms(x))), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "leaf", "dist", "up", "norm", "bytes"])

    entries = stage(vectors.mapInArrow(assign, "vec_id long, leaf long, dist double, up double, norm double, bytes binary"), "entries")
    for r in entries.groupBy("leaf").agg(F.max("dist").alias("d"), F.max("up").alias("u"), F.max("norm").alias("m"), F.count("*").alias("n")).collect():  # a row per leaf
        leaf, top = r["leaf"], tree.parent[r["leaf"]]
        tree.radius[leaf], tree.norm[leaf], tree.rows[leaf] = r["d"], r["m"], r["n"]
        tree.upper_radius[top], tree.upper_norm[top] = max(tree.upper_radius[top], r["u"]), max(tree.upper_norm[top], r["m"])
    return tree, entries


ROUTED = "leaf long, share long, part long, ids binary, q binary, floor binary"


def _route(queries: DataFrame, tree: Tree, chunks: int, first: bool) -> DataFrame:
    """Blocks of queries (vec_id, v, floor) for the leaves that they must read, one row for each part of a large leaf."""
    dim = tree.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            floor = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
            found = tree.reach(q, floor)
            if first:  # only each query's leaves of highest bound
                rows = np.concatenate([np.zeros(0, dtype=np.int64), *(r for _, r, _ in found)])
                leaf = np.concatenate([np.zeros(0, dtype=np.int64), *(np.full(len(r), x) for x, r, _ in found)])
                order = np.lexsort((-np.concatenate([np.zeros(0), *(b for _, _, b in found)]), rows))
                rows, leaf = rows[order], leaf[order]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, leaf = rows[nth < FIRST], leaf[nth < FIRST]
                found = [(x, rows[leaf == x], None) for x in np.unique(leaf).tolist()]
            out: list[list] = [[] for _ in range(6)]
            for x, rows, _ in found:
                share = ids[rows] % chunks
                for s in np.unique(share).tolist():
                    r = rows[share == s]
                    for part in range(-(-int(tree.rows[x]) // SPLIT)):
                        for c, v in zip(out, (x, s, part, ids[r].tobytes(), q[r].tobytes(), floor[r].tobytes())):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.binary()] * 3)], [c.split()[0] for c in ROUTED.split(", ")])

    return queries.mapInArrow(run, ROUTED)


class Leaf:
    """A leaf's entries in order of their distance to the pivot, in pages."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, norm: np.ndarray):
        order = np.lexsort((ids, dist))
        self.ids, self.x, self.dist, self.norm = ids[order], x[order], dist[order], norm[order]
        self.first = np.arange(0, len(ids), PAGE)
        self.near, self.far = self.dist[self.first], self.dist[np.append(self.first[1:], len(ids)) - 1]
        self.top = np.maximum.reduceat(self.norm, self.first)
        self.exact = float(np.abs(x).max(initial=0)) * x.shape[1]
        self.floats = self.x.astype(float)

    def search(self, own: int, q: np.ndarray, q_norm: float, to_pivot: float, floor: float, k: int) -> tuple[dict[int, int], int]:
        """The best ``k`` ids with their scores, as far as they reach ``floor``; and how many products that took."""
        gap = np.maximum(self.near - to_pivot, to_pivot - self.far)
        heap = [(-b, i) for i, b in enumerate(_bound(q_norm, self.top, gap).tolist())]
        heapq.heapify(heap)
        best: dict[int, int] = {}
        done, exact, q_float = 0, self.exact * float(np.abs(q).max(initial=0)) < 2**53, q.astype(float)
        while heap and -heap[0][0] >= floor:
            a = heapq.heappop(heap)[1] * PAGE
            page = slice(a, a + PAGE)
            live = a + np.flatnonzero(_bound(q_norm, self.norm[page], np.abs(self.dist[page] - to_pivot)) >= floor)
            live = live[self.ids[live] != own]
            if not len(live):
                continue
            done += len(live)
            score = (self.floats[live] @ q_float).astype(np.int64) if exact else self.x[live] @ q
            good = score >= floor
            if not good.any():
                continue
            for i, s in zip(self.ids[live[good]].tolist(), score[good].tolist()):
                if s > best.get(i, s - 1):
                    best[i] = s
            if len(best) > k:
                best = dict(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k])
            if len(best) == k:
                floor = max(floor, min(best.values()))
        return best, done


def _read(tree: Tree, entries: DataFrame, routed: DataFrame, chunks: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, products): the best k of each leaf for each query that reads it."""
    dim, pivots = tree.dim, tree.pivots

    def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        one_blas_thread()
        out: tuple[list, list, list, list] = ([], [], [], [])
        if rows.num_rows and blocks.num_rows:
            x = np.frombuffer(b"".join(rows["bytes"].to_pylist()), dtype=np.int64).reshape(rows.num_rows, dim)
            leaf = Leaf(rows["vec_id"].to_numpy(), x, rows["dist"].to_numpy(), rows["norm"].to_numpy())
            pivot = pivots[rows["leaf"][0].as_py()][None, :]
            for ids, q, floor in zip(*(blocks[c].to_pylist() for c in ("ids", "q", "floor"))):
                ids, floor = np.frombuffer(ids, dtype=np.int64), np.frombuffer(floor)
                q = np.frombuffer(q, dtype=np.int64).reshape(len(ids), dim)
                for own, v, n, d, f in zip(ids.tolist(), q, _norms(q).tolist(), _distances(q, pivot)[:, 0].tolist(), floor.tolist()):
                    best, done = leaf.search(own, v, n, d, f, k)
                    for c, add in zip(out, ([own] * len(best), best, best.values(), [done] + [0] * (len(best) - 1) if best else ())):
                        c.extend(add)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score", "products"])

    key = ["leaf", "share", "part"]
    part = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.ceil(F.count("*").over(Window.partitionBy("leaf")) / SPLIT)) if (tree.rows > SPLIT).any() else F.lit(0)
    dealt = entries.withColumn("part", part.cast("long")).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))) if chunks > 1 else F.lit(0).cast("long"))
    return dealt.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long, products long")


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, capacity: int = 1024) -> DataFrame:
    """(query_id, vec_id, score, products) of both rounds; ``products`` sums up to the inner products computed."""
    v = quantised(vectors, scale)
    tree, entries = build(v, capacity)
    queries = v.where(is_query)
    chunks = -(-queries.count() // CHUNK) or 1
    start = stage(_read(tree, entries, _route(queries.withColumn("floor", F.lit(None).cast("double")), tree, chunks, True), chunks, k), "first_leaves")
    best = start.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = best.withColumn("n", nth).where(F.col("n") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    known = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "floor")
    return start.withColumn("round", F.lit(1)).unionByName(_read(tree, entries, _route(known, tree, chunks, False), chunks, k).withColumn("round", F.lit(2)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, capacity: int = 1024) -> DataFrame:
    """For every row where ``is_query`` holds, the k rows of largest integer inner product."""
    found = search(vectors, is_query, k, scale, capacity).where("round = 2").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
