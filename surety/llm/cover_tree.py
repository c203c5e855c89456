"""Exact top-k inner products by dual-tree cover-tree search.

The top of the candidates' cover is shared: centres chosen farthest first from a bounded
sample, each candidate in the cell of its nearest centre.  A query's k-th score in the
sample is a floor for its k-th score, so it visits only the cells whose centre and
covering radius allow as much; it is then sent there, and the candidates, of which there
are many more, move once.  Within a cell (or a part of a large one) queries and
candidates are both indexed by cover trees.  A pair of nodes is pruned when the largest
inner product that their centres and covering radii allow is below the worst k-th score
among the node's queries.

Components are integers as floating-point numbers.  Vectors whose norm is below WIDE
have exact products in any order of summation; a pair with a longer vector is scored in
unbounded integers, without trees.

Defined cases: a null vector, or one with a null or non-finite component, takes no
part as query or candidate; a null vec_id neither; a candidate with the query's own
vec_id is its own row; vectors of different lengths never meet; ties go to the
smaller vec_id; rows that repeat a vec_id are candidates each, and each of their
different vectors asks for itself; a score beyond a long is the nearest long
before ranks are given; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surety.llm import shared
from surety.llm import textbytes as tb

#: Vectors sampled for centres and floors; centres at most; candidates that one task indexes at once, at most and at least; queries likewise.
SAMPLE, CENTRES, CELL_ROWS, LEAST_ROWS, QUERY_BLOCK = 4_096, 256, 65_536, 2_048, 4_096
#: Points in a leaf, and the factor by which covering radii shrink from level to level.
LEAF, SHRINK = 48, 1.3
#: Norm from which on products may not be exact in floating point, and the share by which bounds are widened for rounding.
WIDE, SLACK = float(1 << 26), 1e-12
#: Cells without a centre: of long vectors, and of lengths that the sample does not have.
WIDE_CELL, OTHER_CELL = -1, -2
NO_ID = np.iinfo(np.int64).max


class CoverTree:
    """Nested covers: the points of a node lie within its radius of its centre, a point of its own."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.norms = (points * points).sum(axis=1)
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._build()
        self.points = points[self.order]
        self.center_at = points[self.center]
        self.center_norm = np.sqrt((self.center_at**2).sum(axis=1))
        self.radius_at = np.array(self.radius)
        self.children_at = [np.array(c, np.int64) for c in self.children]
        self.has_children = np.array([bool(c) for c in self.children])
        self.starts_at = np.array([lo for lo, _ in self.span])
        self.sizes_at = np.array([hi - lo for lo, hi in self.span])

    def _distances(self, center: int, rows: np.ndarray) -> np.ndarray:
        d = self.norms[rows] + self.norms[center] - 2 * (self.points[rows] @ self.points[center])
        return np.sqrt(np.maximum(d, 0)) * (1 + SLACK)

    def _add(self, center: int, lo: int, hi: int, far: float) -> int:
        self.center.append(center)
        self.radius.append(far)
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.center) - 1

    def _build(self) -> None:
        rows = self.order
        far = float(self._distances(0, rows).max())
        todo = [(self._add(0, 0, len(rows), far), far)]
        while todo:
            node, reach = todo.pop()
            lo, hi = self.span[node]
            if hi - lo <= LEAF or self.radius[node] == 0:
                continue
            reach = min(reach, self.radius[node]) / SHRINK
            left, done, center = self.order[lo:hi].copy(), lo, self.center[node]
            while len(left):
                d = self._distances(center, left)
                near = d <= reach
                near |= left == center
                mine = left[near]
                self.order[done : done + len(mine)] = mine
                child = self._add(center, done, done + len(mine), float(d[near].max()))
                self.children[node].append(child)
                todo.append((child, reach))
                done += len(mine)
                left = left[~near]
                if len(left):
                    center = int(left[0])


def _merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> None:
    """Put the best ``k`` of both sides into ``scores`` and ``ids``, ties to the smaller id."""
    width = scores.shape[1] + more.shape[1]
    both = np.concatenate((scores, more), axis=1)
    least = np.partition(both, width - k, axis=1)[:, width - k]
    row, at = np.nonzero((both >= least[:, None]) & (both > -np.inf))
    value = both[row, at]
    name = np.where(at < k, ids[row, np.minimum(at, k - 1)], more_ids[np.maximum(at - k, 0)])
    order = np.lexsort((name, -value, row))
    row, value, name = row[order], value[order], name[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    scores[:], ids[:] = -np.inf, NO_ID
    scores[row[keep], rank[keep]], ids[row[keep], rank[keep]] = value[keep], name[keep]


def dual_search(queries: CoverTree, query_ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], points: CoverTree, ids: np.ndarray, k: int):
    """Improve ``best`` (scores and ids of each query, in the tree's order) by the candidates in ``points``."""
    scores, found = best
    own, ids = query_ids[queries.order], ids[points.order]

    def bound(q, c):
        """Largest inner product of any two points below the nodes."""
        rq, rc = queries.radius_at[q], points.radius_at[c]
        top = queries.center_at[q] @ points.center_at[c].T + queries.center_norm[q] * rc + points.center_norm[c] * rq + rq * rc
        return top + SLACK * (queries.center_norm[q] + rq) * (points.center_norm[c] + rc) + 1e-6

    def meet(a: int, b: int, at: np.ndarray) -> None:
        """Scores of the queries in a span and the points ``at``."""
        for low in range(a, b, 1024):
            rows = slice(low, min(low + 1024, b))
            more = queries.points[rows] @ points.points[at].T
            more[own[rows, None] == ids[at]] = -np.inf
            some = np.flatnonzero(more.max(axis=1) >= scores[rows, -1])
            if len(some):
                best_scores, best_ids = scores[rows][some], found[rows][some]
                _merge(best_scores, best_ids, more[some], ids[at], k)
                scores[low + some], found[low + some] = best_scores, best_ids

    todo = [(0, 0, np.inf)]
    while todo:
        q, c, top = todo.pop()
        a, b = queries.span[q]
        if top < scores[a:b, -1].min():
            continue
        if not points.children[c]:
            for low in range(*points.span[c], 1024):  # a leaf of equal points may be large
                meet(a, b, np.arange(low, min(low + 1024, points.span[c][1])))
            continue
        if queries.children[q] and queries.radius[q] > points.radius[c]:
            todo += [(int(i), c, float(bound(int(i), c))) for i in queries.children_at[q]]
            continue
        below = points.children_at[c]
        tops = bound(q, below)
        order = np.argsort(-tops, kind="stable")
        below, tops = below[order], tops[order]
        inner = points.has_children[below]
        todo += [(q, int(i), float(t)) for i, t in zip(below[inner][::-1], tops[inner][::-1])]
        # Leaves of one node mostly hold a point each: they meet the queries together, best first.
        below, tops = below[~inner], tops[~inner]
        while len(below) and tops[0] >= scores[a:b, -1].min():
            sizes = points.sizes_at[below]
            n = max(1, int(np.searchsorted(np.cumsum(sizes), 512)))
            meet(a, b, tb.gather(points.starts_at[below[:n]], sizes[:n]))
            below, tops = below[n:], tops[n:]
            fits = tops >= scores[a:b, -1].min()
            below, tops = below[fits], tops[fits]
    return scores, found


def integer_vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, components as floor(256 x)) of a batch of (vec_id, embedding): one item a length, without vectors that take no part."""
    rows = batch.column(1).cast(pa.large_list(pa.float64()))
    upto = rows.offsets.to_numpy()
    flat = rows.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    length = np.diff(upto)
    use = (bad[upto[1:]] == bad[upto[:-1]]) & rows.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    for dims in np.unique(length[use]).tolist():
        at = np.flatnonzero(use & (length == dims))
        yield dims, at, np.floor(256 * flat[(upto[at][:, None] + np.arange(dims)).ravel()].reshape(len(at), dims))


def _columns(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _binary(values: np.ndarray) -> pa.Array:
    """Rows as little-endian doubles."""
    raw, width = values.astype("<f8").tobytes(), 8 * values.shape[1]
    return pa.array([raw[k * width : (k + 1) * width] for k in range(len(values))], pa.binary())


def centres(points: np.ndarray, most: int) -> np.ndarray:
    """Rows chosen farthest first."""
    chosen = [0]
    far = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def top_cover(vectors: DataFrame, cells: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: centres, and the sample's ids and vectors; the sample has SAMPLE rows at most, drawn by hash."""
    found = _columns(vectors).where("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE).toArrow()
    held: dict[int, list] = {}
    for batch in found.to_batches():
        ids = batch.column(0).to_numpy()
        for dims, at, values in integer_vectors(batch):
            plain = np.linalg.norm(values, axis=1) < WIDE
            held.setdefault(dims, []).append((ids[at[plain]], values[plain]))
    out = {}
    for dims, parts in held.items():
        ids, values = map(np.concatenate, zip(*parts))
        if len(ids) and dims:
            out[dims] = centres(values, cells), ids, values
    return out


def _nearest(values: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each row, and its distance from the cell's centre."""
    square = (values * values).sum(axis=1)[:, None] + (middle * middle).sum(axis=1) - 2 * values @ middle.T
    cell = square.argmin(axis=1)
    return cell, np.sqrt(np.maximum(square[np.arange(len(cell)), cell], 0)) * (1 + SLACK)


def in_cells(vectors: DataFrame, cover) -> DataFrame:
    """(dims, cell, vec_id, point, far) of the candidates that take part."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for dims, at, values in integer_vectors(batch):
                wide = np.linalg.norm(values, axis=1) >= WIDE
                cell, far = np.full(len(at), OTHER_CELL), np.full(len(at), np.inf)
                if dims in cover.value:
                    cell, far = _nearest(values, cover.value[dims][0])
                cell[wide], far[wide] = WIDE_CELL, np.inf
                yield pa.record_batch({"dims": pa.array(np.full(len(at), dims)), "cell": pa.array(cell), "vec_id": pa.array(ids[at]), "point": _binary(values), "far": pa.array(far)})

    return _columns(vectors).mapInArrow(assign, "dims long, cell long, vec_id long, point binary, far double")


def floors(ids: np.ndarray, values: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score in the sample, -inf without one."""
    if len(sample) <= k:
        return np.full(len(ids), -np.inf)
    scores = values @ sample.T
    scores[ids[:, None] == sample_ids] = -np.inf
    return np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]


def visits(queries: DataFrame, cover, radius, k: int) -> DataFrame:
    """(dims, cell, ask, vec_id, point, floor, home): a row for each cell that a query of (ask, vec_id, embedding) has to visit.

    ``radius``: (dims, cell) to covering radius of every cell of a length that the sample has.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = batch.column(2).to_numpy()
            ids = batch.column(0).fill_null(0).to_numpy()
            for dims, at, values in integer_vectors(batch):
                norm = np.linalg.norm(values, axis=1)
                low, home = np.full(len(at), -np.inf), np.zeros(len(at), np.int64)
                row, cell = np.repeat(np.arange(len(at)), 2), np.tile([WIDE_CELL, OTHER_CELL], len(at))
                if dims in cover.value:
                    middle, sample_ids, sample = cover.value[dims]
                    plain = norm < WIDE
                    low[plain] = floors(ids[at[plain]], values[plain], sample_ids, sample, k)
                    home = _nearest(values, middle)[0]
                    far = np.array([radius.value.get((dims, c), -1.0) for c in range(len(middle))])
                    most = values @ middle.T + norm[:, None] * far * (1 + SLACK) + SLACK * norm[:, None] * np.linalg.norm(middle, axis=1) + 1e-6
                    where, which = np.nonzero((far >= 0) & ((most >= low[:, None]) | ~plain[:, None]))
                    row, cell = np.concatenate((row, where)), np.concatenate((cell, which))
                yield pa.record_batch({"dims": pa.array(np.full(len(row), dims)), "cell": pa.array(cell), "ask": pa.array(asks[at[row]]), "vec_id": pa.array(ids[at[row]]), "point": _binary(values).take(pa.array(row)), "floor": pa.array(low[row]), "home": pa.array(home[row])})

    columns = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "ask")
    return columns.mapInArrow(route, "dims long, cell long, ask long, vec_id long, point binary, floor double, home long")


def exact_best(ids: np.ndarray, values: np.ndarray, other: np.ndarray, points: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of the best pairs in unbounded integers, one query at a time."""
    whole = [[int(x) for x in row] for row in points]
    for q, (own, row) in enumerate(zip(ids.tolist(), values)):
        asked = [int(x) for x in row]
        scored = ((max(-NO_ID - 1, min(NO_ID, sum(x * y for x, y in zip(asked, point)))), name) for name, point in zip(other.tolist(), whole) if name != own)
        for score, name in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]:
            yield q, name, score


def search_cell(ids: np.ndarray, values: np.ndarray, floor: np.ndarray, other: np.ndarray, points: np.ndarray, k: int, tree: CoverTree | None) -> tuple[list, CoverTree | None]:
    """(query, id, score) of each query's best pairs with a cell's points, and the points' tree."""
    plain_q, plain_p = np.linalg.norm(values, axis=1) < WIDE, np.linalg.norm(points, axis=1) < WIDE
    out = []
    for some_q, some_p in ((plain_q, ~plain_p), (~plain_q, np.ones(len(points), bool))):
        if some_q.any() and some_p.any():
            place = np.flatnonzero(some_q)
            out += [(int(place[q]), name, score) for q, name, score in exact_best(ids[some_q], values[some_q], other[some_p], points[some_p], k)]
    if plain_q.any() and plain_p.any():
        tree = tree or CoverTree(points[plain_p])
        asking, place = CoverTree(values[plain_q]), np.flatnonzero(plain_q)
        # A half below the floor, which no score is: what stays there was not found here.
        best = np.repeat(floor[plain_q][asking.order][:, None] - 0.5, k, axis=1), np.full((len(place), k), NO_ID)
        scores, found = dual_search(asking, ids[plain_q], best, tree, other[plain_p], k)
        at, rank = np.nonzero((scores > -np.inf) & (scores == np.floor(scores)))
        out += zip(place[asking.order[at]].tolist(), found[at, rank].tolist(), np.rint(scores[at, rank]).astype(np.int64).tolist())
    return out, tree


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of each query row but exact repeats."""
    spark = candidates.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell_rows = min(CELL_ROWS, max(LEAST_ROWS, candidates.count() // (4 * partitions)))
    cover = spark.sparkContext.broadcast(top_cover(candidates, min(CENTRES, max(1, candidates.count() // cell_rows))))
    held = in_cells(candidates, cover)
    cells = shared.materialise(held.groupBy("dims", "cell").agg(F.max("far").alias("far"), F.ceil(F.count("*") / F.lit(cell_rows)).alias("parts")), "cells")
    known = cells.where("cell >= 0").collect()  # CENTRES rows at most for each length in the sample
    radius = spark.sparkContext.broadcast({(r["dims"], r["cell"]): r["far"] for r in known})
    asked = shared.materialise(queries.select("vec_id", "embedding").distinct().withColumn("ask", F.monotonically_increasing_id()), "queries")
    part = F.pmod(F.xxhash64("vec_id", "point", F.monotonically_increasing_id()), F.col("parts"))
    points = held.join(cells.select("dims", "cell", "parts"), ["dims", "cell"]).select("dims", "cell", part.alias("part"), F.lit(None).cast("long").alias("ask"), "vec_id", "point", F.lit(0.0).alias("floor"), F.lit(-1).cast("long").alias("home"))
    sent = visits(asked, cover, radius, k).join(cells.select("dims", "cell", "parts"), ["dims", "cell"])
    sent = sent.select("dims", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "ask", "vec_id", "point", "floor", "home")
    keys = ["dims", "cell", "part"]
    together = points.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "home", "ask")  # candidates, then queries of one home after another

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tree = None
        held: list[tuple] = []  # the cell's candidates
        waiting: list[tuple] = []  # its queries
        points = None

        def told():
            nonlocal tree, points, waiting
            if not waiting or not held:
                waiting = []
                return None
            if points is None:
                points = np.concatenate([x[0] for x in held]), np.frombuffer(b"".join(p for x in held for p in x[1]), "<f8").reshape(-1, key[0])
            asks, ids, floor = (np.concatenate([x[k] for x in waiting]) for k in (0, 1, 3))
            values = np.frombuffer(b"".join(p for x in waiting for p in x[2]), "<f8").reshape(-1, key[0])
            found, tree = search_cell(ids, values, floor, *points, k, tree)
            waiting = []
            if not found:
                return None
            at, names, scores = zip(*found)
            at = np.array(at)
            return pa.record_batch({"ask": pa.array(asks[at]), "query_id": pa.array(ids[at]), "vec_id": pa.array(names, pa.int64()), "score": pa.array(scores, pa.int64())})

        for batch in batches:
            dims, cell, part = (batch.column(i).to_numpy() for i in range(3))
            asking = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((dims[1:] != dims[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (asking[1:] != asking[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(dims)]):
                if lo == hi:
                    continue
                if key != (now := (int(dims[lo]), int(cell[lo]), int(part[lo]))):
                    if (done := told()) is not None:
                        yield done
                    key, tree, points, held = now, None, None, []
                ids, values = batch.column(4)[lo:hi].to_numpy(), batch.column(5)[lo:hi].to_pylist()
                if not asking[lo]:
                    held.append((ids, values))
                    continue
                waiting.append((batch.column(3)[lo:hi].to_numpy(), ids, values, batch.column(6)[lo:hi].to_numpy()))
                if sum(len(x[0]) for x in waiting) >= QUERY_BLOCK and (done := told()) is not None:
                    yield done
        if (done := told()) is not None:
            yield done

    found = together.mapInArrow(search, "ask long, query_id long, vec_id long, score long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
