"""Approximate nearest neighbours: stable projections in a kd-tree, with a chi-square stop.

Vectors are scaled to length one, so the nearest by cosine are the nearest by distance, and
projected by ``dims`` Gaussian (2-stable) vectors. For a pair at distance s, the squared
projected distance divided by s squared is chi-square distributed with ``dims`` degrees of
freedom. A query takes projected neighbours in order of distance (leaf by leaf, nearest box
first), each verified on the original vectors, until the next projected distance r and the
k-th best distance d so far pass the test chi2cdf(r^2 / d^2) >= ``certainty``: what is left
would have been met before with that probability.

Layout. A coarse kd-tree is fitted on the projections of a sample (of at most about
``sample_rows`` rows, a parameter; only its projections reach the driver). Every row is dealt to
a cell of it, and the rows are written sorted by cell, in parts of about ``tree_rows``, so one
very common vector is spread over parts. Queries come from the same table, in blocks of at most
``block`` queries of neighbouring cells, broadcast one by one. A block is first searched in its
own cells; with the k-th distances found there, only those other cells are read that stand
within the chi-square radius of some query. Within a part, a kd-tree over its rows orders the
search; all queries that are at one leaf are verified by one matrix product. Rows that carry
one vector are compared once. On data without any structure (random directions) the radius
meets nearly all cells, and the search is then as much work as comparing each query with most
rows, though by matrix products alone.

Scores are cosines in double precision on the original vectors; ties go to smaller ids.

Defined cases: null, empty and zero vectors and ones with null or non-finite components take
no part, nor do rows without id; vectors of different lengths are not compared: each length is
searched by itself; a query finds all candidates if there are fewer than k; repeated rows (one
id and vector) are one row; of different rows with one id, all are candidates for others'
queries and none for their own; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from . import common as C



def chi2_cdf(x: float, n: int) -> float:
    """P(chi-square with n degrees of freedom <= x), by the series of the incomplete gamma."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    a, h = n / 2, x / 2
    if h > 700:
        return 1.0
    term = total = 1 / a
    k = a
    for _ in range(5000):
        k += 1
        term *= h / k
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * exp(-h + a * log(h) - lgamma(a)))


def chi2_quantile(p: float, n: int) -> float:
    lo, hi = 0.0, 4.0 * n + 200
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, n) < p else (lo, mid)
    return hi


class KdTree:
    """Points of a low dimension, split at medians of the widest side; boxes at the leaves."""

    LEAF = 1024

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, children
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        if len(points):
            stack = [(0, len(points), -1, 0)]
            while stack:
                lo, hi, parent, side = stack.pop()
                own = points[self.order[lo:hi]]
                me = len(self.nodes)
                self.nodes.append([lo, hi, -1, -1])
                self.low.append(own.min(axis=0)), self.high.append(own.max(axis=0))
                if parent >= 0:
                    self.nodes[parent][2 + side] = me
                wide = self.high[me] - self.low[me]
                if hi - lo > self.LEAF and wide.max() > 0:
                    mid = (hi - lo) // 2
                    at = np.argpartition(own[:, int(np.argmax(wide))], mid)
                    self.order[lo:hi] = self.order[lo:hi][at]
                    stack += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.low = np.array(self.low).reshape(len(self.nodes), -1)
        self.high = np.array(self.high).reshape(len(self.nodes), -1)

    def leaves(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, lowest, highest corner) of each leaf."""
        return [(self.order[lo:hi], self.low[i], self.high[i]) for i, (lo, hi, left, _) in enumerate(self.nodes) if left < 0]


class Cells:
    """The coarse tree over a sample: half-space splits, and the boxes that they cut out."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.at, self.child = [], [], []
        self.low, self.high = [], []
        dims = points.shape[1]
        self._grow(points, cells, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low).reshape(-1, dims), np.array(self.high).reshape(-1, dims)

    def _grow(self, points, cells, low, high) -> int:
        """A node's number, or -1 - cell for a cell."""
        wide = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(len(low))
        axis = int(np.argmax(wide))
        if cells <= 1 or wide[axis] <= 0:
            self.low.append(low), self.high.append(high)
            return -len(self.low)
        at = float(np.median(points[:, axis]))
        right = points[:, axis] > at
        if not right.any():  # over half of the sample stands at the top
            at = float(np.max(points[points[:, axis] < at, axis]))
            right = points[:, axis] > at
        me = len(self.axis)
        self.axis.append(axis), self.at.append(at), self.child.append(None)
        up, down = high.copy(), low.copy()
        up[axis] = down[axis] = at
        self.child[me] = (self._grow(points[~right], (cells + 1) // 2, low, up), self._grow(points[right], cells // 2, down, high))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, stack = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while stack and self.axis:
            node, rows = stack.pop()
            right = points[rows, self.axis[node]] > self.at[node]
            for child, own in zip(self.child[node], (rows[~right], rows[right])):
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    stack.append((child, own))
        return out


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.empty((len(q), len(low)))
    for j in range(len(low)):
        gap = np.maximum(0, np.maximum(low[j] - q, q - high[j]))
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def reach(worst: np.ndarray, limit: float) -> np.ndarray:
    """Squared projected distance beyond which the chi-square test stops, for k-th best cosines.

    Unit vectors are 2 - 2 cosine apart, squared; without k candidates there is no stop."""
    far = limit * (2.0 - 2.0 * np.minimum(1.0, worst)) * (1 + 1e-9) + 1e-12
    return np.where(worst > -1.0, far, np.inf)


def _matrix(column, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in doubles) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows, vectors = [], []
    for i, v in enumerate(column):
        if not v.is_valid:
            continue
        x = v.values
        if x.null_count or len(x) == 0 or dim is not None and len(x) != dim:
            continue
        x = x.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all() and x.any():
            rows.append(i)
            vectors.append(x)
    return np.array(rows, np.int64), np.array(vectors, float).reshape(len(rows), dim or (len(vectors[0]) if vectors else 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Part:
    """Rows of one part: distinct vectors with the ids that carry them, in a kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, plane: np.ndarray, k: int):
        unit = _unit(vectors) + 0.0  # no negative zeros: equal vectors are equal bytes
        keys = np.ascontiguousarray(unit).view(np.dtype((np.void, unit.shape[1] * 8))).ravel()
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        self.unit = unit[first]
        pairs = np.unique(np.stack([of.ravel(), ids], axis=1), axis=0)
        self.row, self.id = pairs[:, 0], pairs[:, 1]
        self.from_ = np.searchsorted(self.row, np.arange(len(self.unit) + 1))
        self.projected = self.unit @ plane
        self.leaves, self.k = KdTree(self.projected).leaves(), k

    def search(self, query_id: np.ndarray, unit: np.ndarray, projected: np.ndarray, least: np.ndarray, limit: float):
        """(query places, ids, scores) of the k best of each query; scores under ``least`` are dropped."""
        k, n = self.k, len(query_id)
        best, rows = np.full((n, k), -2.0), np.zeros((n, k), np.int64)
        distance = box_distances(projected, np.array([x[1] for x in self.leaves]), np.array([x[2] for x in self.leaves]))
        order = np.argsort(distance, axis=1, kind="stable")
        leaf_of, place = np.zeros(len(self.unit), np.int64), np.zeros(len(self.unit), np.int64)
        for j, (own, _, _) in enumerate(self.leaves):
            leaf_of[own], place[own] = j, np.arange(len(own))
        # vectors that only the query's own id carries are no candidates
        single = np.flatnonzero(np.diff(self.from_) == 1)
        by_id = np.argsort(query_id, kind="stable")
        carried = self.id[self.from_[single]]
        lo, hi = np.searchsorted(query_id[by_id], carried), np.searchsorted(query_id[by_id], carried, side="right")
        banned: dict[int, list] = {}
        for r, a, b in zip(single[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for q in by_id[a:b].tolist():
                banned.setdefault(int(leaf_of[r]), []).append((q, int(place[r])))
        where = np.full(n, -1)
        active = np.arange(n)
        for turn in range(len(self.leaves)):
            at = order[active, turn]
            worst = np.maximum(best[active, k - 1], least[active])
            go = distance[active, at] <= reach(worst, limit)
            active, at = active[go], at[go]
            if not len(active):
                break
            by_leaf = np.argsort(at, kind="stable")
            for run in np.split(by_leaf, np.flatnonzero(np.diff(at[by_leaf])) + 1):
                q, j = active[run], int(at[run[0]])
                own = self.leaves[j][0]
                score = unit[q] @ self.unit[own].T
                if j in banned:
                    where[q] = np.arange(len(q))
                    for x, y in banned[j]:
                        if where[x] >= 0:
                            score[where[x], y] = -2.0
                    where[q] = -1
                better = score.max(axis=1) > np.maximum(best[q, k - 1], least[q] - 1e-12)
                if better.any():
                    q, score = q[better], score[better]
                    take = np.argpartition(-score, k - 1, axis=1)[:, :k] if score.shape[1] > k else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                    both = np.concatenate([best[q], np.take_along_axis(score, take, axis=1)], axis=1)
                    which = np.concatenate([rows[q], own[take]], axis=1)
                    top = np.argsort(-both, axis=1, kind="stable")[:, :k]
                    best[q], rows[q] = np.take_along_axis(both, top, axis=1), np.take_along_axis(which, top, axis=1)
        return self._ids(query_id, unit, best, rows)

    def _ids(self, query_id, unit, best, rows):
        """The k best rows as at most k ids a query, with exact scores, ties to smaller ids."""
        q, j = np.nonzero(best > -2.0)
        r = rows[q, j]
        score = np.clip(np.einsum("ij,ij->i", self.unit[r], unit[q]), -1.0, 1.0)
        held = np.minimum(np.diff(self.from_)[r], self.k + 1)  # one of them may be the query's own
        q, score = np.repeat(q, held), np.repeat(score, held)
        step = np.arange(len(q)) - np.repeat(np.cumsum(held) - held, held)
        ids = self.id[np.repeat(self.from_[r], held) + step]
        keep = ids != query_id[q]
        q, ids, score = q[keep], ids[keep], score[keep]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        once = np.unique(np.stack([q, ids], axis=1), axis=0, return_index=True)[1]  # the best row of each id
        once.sort()
        q, ids, score = q[once], ids[once], score[once]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < self.k], ids[rank < self.k], score[rank < self.k]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    dims: int = 12,
    certainty: float = 0.95,
    block: int = 20_000,
    tree_rows: int = 50_000,
    sample_rows: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` to each of ``queries``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    asked = queries.select(F.col(f"`{id}`").alias("query_id"), F.col(f"`{vector}`").cast("array<double>").alias("q")).filter("query_id is not null and size(q) > 0")
    found = None
    for dim, count in sorted((r["n"], r["count"]) for r in rows.groupBy(F.size("v").alias("n")).count().collect()):
        alike = rows.filter(F.size("v") == dim), asked.filter(F.size("q") == dim)
        for part in _of_one_length(spark, *alike, dim, count, k, dims, certainty, min(block, max(1, (1 << 23) // dim)), tree_rows, sample_rows, seed):
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _found_schema(rows))
    # one shuffle, by query; partial ranks keep k rows of a query per task before the last rank
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found_schema(rows: DataFrame) -> T.StructType:
    kind = rows.schema["vec_id"].dataType
    return T.StructType([T.StructField("query_id", kind), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])


def _of_one_length(spark, rows, asked, dim, count, k, dims, certainty, block, tree_rows, sample_rows, seed):
    """What each block of queries finds among the rows; all vectors have ``dim`` components."""
    plane = np.random.default_rng(seed).normal(size=(dim, dims))
    limit = chi2_quantile(certainty, dims)

    def projections(batches):
        for b in batches:
            _, x = _matrix(b.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array(list(_unit(x) @ plane) if len(x) else [], pa.list_(pa.float64()))], names=["p"])

    cut = min(2**63 - 1, int(-(2**63) + min(1.0, sample_rows / count) * 2**64))
    sample = rows.filter(F.xxhash64("vec_id", F.lit(seed)) <= F.lit(cut)).select("v").limit(2 * sample_rows).mapInArrow(projections, "p array<double>").toArrow()
    points = np.array(sample.column("p").to_pylist(), float).reshape(-1, dims)
    # rows of one cell are a fraction of a part, so that blocks of queries can skip most of them
    cells = Cells(points, min(4096, max(1, len(points) // 16), 1 + 8 * count // tree_rows))
    shared_cells = spark.sparkContext.broadcast(cells)

    def dealt(name):
        def run(batches):
            for b in batches:
                take, x = _matrix(b.column(1), dim)
                if len(take):
                    at = shared_cells.value.of(_unit(x) @ plane)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array(at)], names=[name, "v", "cell"])

        return run

    def schema(df, name):
        return T.StructType([T.StructField(name, df.schema[0].dataType), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

    parts = max(spark.sparkContext.defaultParallelism, -(-count // tree_rows))
    laid = rows.mapInArrow(dealt("vec_id"), schema(rows, "vec_id"))
    laid = C.write_table(laid.repartitionByRange(parts, "cell", F.xxhash64("vec_id", "v")).sortWithinPartitions("cell"))
    questions = C.write_table(asked.mapInArrow(dealt("query_id"), schema(asked, "query_id")).distinct())
    per_cell = sorted((r["cell"], r["count"]) for r in questions.groupBy("cell").count().collect())
    for low, high, pieces in _runs(per_cell, block):
        for piece in range(pieces):
            own = questions.filter(F.col("cell").between(low, high) & (F.pmod(F.xxhash64("query_id", "v"), F.lit(pieces)) == piece)).toArrow()
            _, x = _matrix(own.column("v"), dim)
            if not len(x):
                continue
            query_ids, unit = np.array(own.column("query_id").to_pylist()), _unit(x)
            near = laid.filter(F.col("cell").between(low, high))
            home = C.write_table(_scan(spark, near, query_ids, unit, np.full(len(unit), -2.0), plane, limit, k, tree_rows, dim))
            yield home
            # the k-th best of the own cells bounds the radius in all others
            kth = home.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("s")).filter(F.size("s") > 0).collect()
            kth = {r["query_id"]: r["s"][0] for r in kth}
            least = np.array([kth.get(q, -2.0) for q in query_ids.tolist()])
            within = np.zeros(len(cells.low), bool)
            radius = reach(least, limit)
            projected = unit @ plane
            for lo in range(0, len(unit), 4096):
                s = slice(lo, lo + 4096)
                within |= (box_distances(projected[s], cells.low, cells.high) <= radius[s, None]).any(axis=0)
            within[low : high + 1] = False
            if within.any():
                wanted = F.lit(False)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], within.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    wanted = wanted | F.col("cell").between(a, b - 1)
                yield _scan(spark, laid.filter(wanted), query_ids, unit, least, plane, limit, k, tree_rows, dim)


def _runs(per_cell: list[tuple[int, int]], block: int):
    """(first cell, last cell, pieces): runs of cells of at most ``block`` queries; a cell of more is cut."""
    low, high, held = None, None, 0
    for cell, n in per_cell:
        if low is not None and held + n > block:
            yield low, high, -(-held // block)
            low, held = None, 0
        low, high, held = cell if low is None else low, cell, held + n
    if low is not None:
        yield low, high, -(-held // block)


def _scan(spark, rows, query_ids, unit, least, plane, limit, k, tree_rows, dim) -> DataFrame:
    """(query_id, vec_id, score): each part's k best rows of each query of a block."""
    shared = spark.sparkContext.broadcast((query_ids, unit, least))
    schema = _found_schema(rows)

    def run(batches):
        ids_of, unit, least = shared.value
        numbers, projected = np.unique(ids_of, return_inverse=True)[1].ravel(), unit @ plane
        place = {q: n for q, n in zip(ids_of.tolist(), numbers.tolist())}
        held_ids, held, n = [], [], 0

        def answer():
            ids = [i for x in held_ids for i in x.to_pylist()]
            # ids as numbers: a query's own is its number; all others follow in their order
            names = sorted(set(ids))
            code = {x: j for j, x in enumerate(names)}
            known = np.array([code.get(q, -1 - place[q]) for q in ids_of.tolist()], np.int64)
            part = Part(np.array([code[x] for x in ids], np.int64), np.concatenate(held), plane, k)
            q, found, score = part.search(known, unit, projected, least, limit)
            yield pa.RecordBatch.from_arrays([pa.array(ids_of[q].tolist(), ids_type), pa.array([names[j] for j in found.tolist()], ids_type), pa.array(score)], names=schema.names)

        for batch in batches:
            ids_type = batch.column(0).type
            for lo in range(0, batch.num_rows, tree_rows):
                piece = batch.slice(lo, tree_rows)
                held_ids.append(piece.column(0))
                held.append(_matrix(piece.column(1), dim)[1])
                n += piece.num_rows
                if n >= tree_rows:
                    yield from answer()
                    held_ids, held, n = [], [], 0
        if n:
            yield from answer()

    return rows.select("vec_id", "v").mapInArrow(run, schema)
