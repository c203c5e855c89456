"""N-gram Jaccard join over count vectors in an R-tree.

A document is its set of distinct word shingles, hashed.  Hashes fall into groups,
and a document's group counts are a point.  For two sets the sum of coordinate
minima bounds the overlap from above, and for a box of points the minima with the
box's upper corner bound it for all of them: nodes, then points, whose bound is
below what the Jaccard threshold needs are pruned, and survivors are verified on
their sets.

The tree is distributed.  Its top level is a partition of coordinate space: at the
finest grouping (one hash, one coordinate) a pair that reaches the threshold must
share one of the first ``n - ceil(t n) + 1`` coordinates of both in any common
order, so documents that share none are never together.  The order puts hashes
that many documents hold last, the most frequent at the very end, which changes the
work but no result.  The points that share a coordinate are loaded into an R-tree by
tiles and joined with themselves; pairs whose bound reaches the threshold connect points
into regions, and so does a coordinate of very many points, which is not opened.  The
sets of each region then meet in an R-tree of their own, where survivors are verified.
A large region is joined in two rounds: each of its blocks with one of them, then what
is not in the largest component so far with every block.  A pair already connected is
not looked at again and a leaf whose points are all connected to the query is skipped,
so a group of copies emits a spanning forest, never its pairs.  Sets that are equal are
one class and enter once.

Words and shingles are hashed to 64 bits: two different words of a corpus of 10**9 words
share a hash with chance 0.03, and count as one then; sets are compared by these hashes.

Defined cases: null or blank text has an empty set, links with nothing and is a
component of its own; a null doc_id keeps its row with a null component_id and
links with nothing; rows that repeat a doc_id are nodes of their own under that id;
fewer words than the width make one shingle of the whole sequence; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm import shared
from surety.llm import textbytes as tb
from surety.llm.connected import connected_components

#: Hashes counted together in a task, and the least count there that is reported.
CHUNK, REPORTED = 2_000_000, 4
#: Document count from which a hash goes last, and how many hashes go last at most.
COMMON, MOST_COMMON = 64, 1_000_000
#: Shingles that one tree holds at most, about.
TREE_SHINGLES = 2_000_000
#: Coordinates of a point where sets are verified, and points in a leaf or children in a node.
GROUPS, FANOUT = 256, 16
#: Elsewhere a point has at least so many coordinates, and about so many shingles in each.
LEAST_GROUPS, PER_GROUP = 64, 8
#: Points that one tree over a shared coordinate holds; more are one region unopened.
TREE_POINTS = 4_096


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, document after document, and each document's bounds among them."""
    low = tb.lower_ascii(data)
    starts, ends, upto = tb.words(low, bounds)
    h = tb.span_hash(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    words = np.diff(upto)
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    out = np.zeros(len(words) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    factors = tb.mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    at = tb.gather(upto[:-1], count)
    full = np.repeat(words >= width, count)
    x = np.zeros(len(at), np.uint64)
    where = at[full]
    for k in range(width):
        x[full] += h[where + k] * factors[k]
    for d in np.flatnonzero((words > 0) & (words < width)):
        part = h[upto[d] : upto[d + 1]]
        x[out[d]] = (part * factors[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return tb.mix(x), out


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text of a column."""
    for _, _, data, bounds in tb.text_slices(column):
        x, upto = shingles(data, bounds, width)
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            yield np.unique(x[a:b])


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Least overlap of sets of ``n`` and ``m`` whose Jaccard similarity is ``percent`` or more."""
    return -(-percent * (n + m) // (100 + percent))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes, as two signed integers."""
    both = np.array([tb.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), tb.mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return tuple(both.view(np.int64).tolist())


def count_vector(s: np.ndarray) -> np.ndarray:
    """Shingles in each group, a power of two of groups that follows the set's size."""
    groups = LEAST_GROUPS
    while groups * PER_GROUP < len(s):
        groups *= 2
    while True:
        counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    """The same counts in fewer groups."""
    return point.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def common_hashes(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that at least COMMON documents hold and their counts, as far as the tasks' counts show it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= REPORTED
            return pa.record_batch({"hash": pa.array(h[keep].view(np.int64)), "n": pa.array(n[keep].astype(np.int64))})

        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    found = docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "hash").limit(MOST_COMMON).toArrow()
    hashes, counts = rows.column("hash").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def signatures(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int, width: int, extra: str | None = None) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, its point, and its first coordinates, those of very many documents apart.

    A task gives point and coordinates of equal sets once; each class has them somewhere.
    A column ``extra`` of ``docs``, a long, stays.
    """
    last = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rare_last, counts), met = last.value, set()
        for batch in batches:
            sizes, high, low, first, hot, points = [], [], [], [], [], []
            named = batch.column(0).is_valid().to_pylist()
            for s, has_id in zip(shingle_sets(batch.column(1), width), named):
                n = len(s)
                sizes.append(n)
                h, l = fingerprint(s) if n else (None, None)
                high.append(h)
                low.append(l)
                if not n or not has_id or (h, l) in met:
                    first.append(s[:0])
                    hot.append(s[:0])
                    points.append(None)
                    continue
                met.add((h, l))
                points.append(count_vector(s).tobytes())
                share = n - -(-percent * n // 100) + 1
                count = np.zeros(n, np.int64)
                if len(rare_last):
                    at = np.minimum(np.searchsorted(rare_last, s), len(rare_last) - 1)
                    count = np.where(rare_last[at] == s, counts[at], 0)
                    order = np.argsort(count, kind="stable")
                    s, count = s[order], count[order]
                crowded = count[:share] > TREE_POINTS
                first.append(s[:share][~crowded])
                hot.append(s[:share][crowded])
            columns = {"doc_id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64()), "point": pa.array(points, pa.binary())}
            for name, lists in (("first", first), ("hot", hot)):
                upto = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                values = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
                columns[name] = pa.ListArray.from_arrays(pa.array(upto), pa.array(values.view(np.int64)))
            yield pa.record_batch(columns | ({extra: batch.column(2)} if extra else {}))

    columns = [F.col("doc_id").cast("long"), "text", *([F.col(extra).cast("long")] if extra else [])]
    return docs.select(*columns).mapInArrow(sign, "doc_id long, n_shingles long, high long, low long, point binary, first array<long>, hot array<long>" + (f", `{extra}` long" if extra else ""))


def shared_coordinates(first: DataFrame) -> DataFrame:
    """(run, nodes): the distinct groups of ``node`` that have a ``coordinate`` in common.

    A group beyond TREE_POINTS is given as pairs (run null) of its first node and each other one.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()

        def told(names, lists):
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            upto = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            return pa.record_batch({"run": pa.array(names, pa.int64()), "nodes": pa.ListArray.from_arrays(pa.array(upto), pa.array(values))})

        def whole(k, r):
            """Of whole runs only."""
            keep = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))  # a node once a coordinate
            k, r = k[keep], r[keep]
            at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(at, len(k)))
            names, lists = [], []
            for a, n in zip(at[size > 1].tolist(), size[size > 1].tolist()):
                part = r[a : a + n]
                name = int((tb.mix(part.view(np.uint64)).sum(dtype=np.uint64)).view(np.int64))
                if name not in met:
                    met.add(name)
                    names.append(name)
                    lists.append(part)
            if len(met) > 2_000_000:
                met.clear()
            return told(names, lists)

        def star(hub, r):
            r = np.unique(r[r != hub])
            return told([None] * len(r), [np.array([hub, x]) for x in r.tolist()])

        held_k, held_r, hub = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            k = np.concatenate((held_k, batch.column(0).to_numpy()))
            r = np.concatenate((held_r, batch.column(1).to_numpy()))
            if not len(k):
                continue
            if hub is not None:  # of the coordinate that held_k ends with, all but the first node went on
                more = int(np.searchsorted(k, k[0], "right"))
                yield star(hub, r[:more])
                if more == len(k):
                    held_k, held_r = k[:1].copy(), r[:1].copy()
                    continue
                k, r, hub = k[more:], r[more:], None
            done = int(np.searchsorted(k, k[-1], "left"))
            if done:
                yield whole(k[:done], r[:done])
            held_k, held_r = k[done:].copy(), r[done:].copy()
            if len(held_k) > TREE_POINTS:
                hub = int(held_r[0])
                yield star(hub, held_r)
                held_k, held_r = held_k[:1].copy(), held_r[:1].copy()
        if len(held_k) and hub is None:
            yield whole(held_k, held_r)

    runs = first.repartition("coordinate").sortWithinPartitions("coordinate", "node").mapInArrow(gather, "run long, nodes array<long>")
    return runs.groupBy(F.coalesce("run", F.xxhash64("nodes")).alias("key"), F.col("run").isNull().alias("star")).agg(F.first("nodes").alias("nodes")).select(F.col("key").alias("run"), "star", "nodes")


def may_link(nodes: np.ndarray, sizes: np.ndarray, points: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Forest (node, node) of the pairs whose bound on the overlap reaches the threshold."""
    own = np.array([len(p) for p in points])
    out = []
    for groups in np.unique(own).tolist():
        # Sets that can link differ in size by a quarter at most, so in groups by a factor of two (or four, where counts overflowed).
        at = np.flatnonzero((own >= groups) & (own <= 4 * groups))
        if len(at) < 2:
            continue
        folded = np.stack([fold(points[i], groups) for i in at])
        order = tiles(folded, sizes[at])
        at, folded = at[order], folded[order]
        tree = CountTree(folded, sizes[at])
        group, leaf, one_group = np.arange(len(at)), np.arange(0, len(at), FANOUT), None
        for i in np.flatnonzero(own[at] == groups).tolist():
            if one_group is None:
                low = np.minimum.reduceat(group, leaf)
                one_group = np.where(low == np.maximum.reduceat(group, leaf), low, -1)
            for j in tree.search(tree.levels[0][0][i], int(sizes[at[i]]), percent, group, int(group[i]), one_group).tolist():
                if group[i] != group[j]:
                    out.append((int(nodes[at[i]]), int(nodes[at[j]])))
                    group[group == group[j]] = group[i]
                    one_group = None
    return out


def region_edges(runs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between nodes of a run whose bound reaches the threshold."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(nodes, sizes, points):
            links = may_link(np.array(nodes), np.array(sizes), [np.frombuffer(p, np.uint8) for p in points], percent) if len(nodes) > 1 else []
            return pa.record_batch({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

        run, nodes, sizes, points = None, [], [], []
        for batch in batches:
            for r, node, n, point in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r != run and nodes:
                    yield told(nodes, sizes, points)
                    nodes, sizes, points = [], [], []
                run = r
                nodes.append(node)
                sizes.append(n)
                points.append(point)
        if nodes:
            yield told(nodes, sizes, points)

    members = runs.select("run", F.explode("nodes").alias("node")).join(classes.select("node", "n", "point"), "node").select("run", "node", "n", "point")
    return members.repartition("run").sortWithinPartitions("run", "node").mapInArrow(join, "a long, b long")


def tiles(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of points by tiles: halves of the widest coordinate (the set's size is one), again and again, down to a leaf's points."""
    space = np.column_stack((points, sizes)).astype(np.float32)
    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= FANOUT:
            continue
        part = space[order[lo:hi]]
        along = part[:, int(part.var(axis=0).argmax())]
        middle = lo + -(-(hi - lo) // (2 * FANOUT)) * FANOUT  # whole leaves on the left
        order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
        todo += [(lo, middle), (middle, hi)]
    return order


class CountTree:
    """R-tree over the count vectors of sets, in the order of :func:`tiles`."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            box, least, most = self.levels[-1]
            at = np.arange(0, len(box), FANOUT)
            self.levels.append((np.maximum.reduceat(box, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def search(self, point: np.ndarray, size: int, percent: int, group: np.ndarray, own: int, one_group: np.ndarray) -> np.ndarray:
        """Points not in group ``own`` whose bound reaches the threshold, best first.

        ``one_group``: the group of each leaf node's points, -1 if they differ.
        """
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            box, least, most = self.levels[depth]
            fits = (100 * most[at] >= percent * size) & (percent * least[at] <= 100 * size)
            if depth <= 1:
                fits &= (one_group if depth else group)[at] != own
            at = at[fits]
            bound = np.minimum(box[at], point).sum(axis=1, dtype=np.int64)
            floor = np.maximum(least[at], -(-percent * size // 100))
            good = bound >= needed(size, floor, percent)
            at, bound = at[good], bound[good]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at[np.argsort(-bound, kind="stable")]


def forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest (node, root) of the links among sorted hash sets.

    ``known``: components found before; then only the links that join them, whatever ends.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.stack([np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)
    order = tiles(points, sizes)
    nodes, sizes, points, sets = nodes[order], sizes[order], points[order], [sets[i] for i in order]
    tree, joined = CountTree(points, sizes), []
    group, leaf, one_group = np.arange(n) if known is None else np.unique(known[order], return_inverse=True)[1], np.arange(0, n, FANOUT), None
    for i in range(n):
        if one_group is None:
            low = np.minimum.reduceat(group, leaf)
            one_group = np.where(low == np.maximum.reduceat(group, leaf), low, -1)
        found = tree.search(points[i], int(sizes[i]), percent, group, int(group[i]), one_group)
        for j in found.tolist():
            if group[j] == group[i]:
                continue
            small, big = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(big, small), len(big) - 1)
            if int((big[at] == small).sum()) >= needed(int(sizes[i]), int(sizes[j]), percent):
                joined.append((int(nodes[i]), int(nodes[j])))
                group[group == group[j]] = group[i]
                one_group = None
    if known is not None:
        return joined
    out = []
    for g in np.unique(group) if joined else []:
        members = nodes[group == g]
        root = members.min()
        out += [(int(m), int(root)) for m in members if m != root]
    return out


def _upto(n: str):
    return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))


def _cell(band, block, other_band, other_block):
    """The tree in which a block meets another one."""
    return F.xxhash64("region", band, block, other_band, other_block)


def first_cells(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, rep, cells) from (node, rep, region, n): the trees that a set enters; and the sets of large regions.

    A region of many shingles is cut into bands of set sizes within a quarter of each
    other, so links stay within a band or join neighbours, and a band into blocks by hash;
    each block meets the band's first one, and first ones meet those of the next band.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(1.25)) + F.lit(1e-9)).cast("int")
    total = nodes.groupBy("region").agg(F.sum("n").alias("total"))
    large = total.where(F.col("total") > TREE_SHINGLES).select("region")
    if not large.limit(1).count():
        return nodes.select("node", "rep", F.array(F.col("region")).alias("cells")), None
    whole = nodes.join(large, "region", "left_anti").select("node", "rep", F.array(F.col("region")).alias("cells"))
    part = nodes.join(large, "region").withColumn("band", band)
    blocks = part.groupBy("region", "band").agg(F.ceil(2 * F.sum("n") / F.lit(TREE_SHINGLES)).cast("int").alias("blocks"))
    part = part.join(blocks, ["region", "band"])
    part = shared.materialise(part.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "blocks")
    one = F.col("band")
    of_first = F.concat(F.transform(_upto("blocks"), lambda k: _cell(one, F.lit(0), one, k)), F.array(_cell(one, F.lit(0), one + 1, F.lit(0)), _cell(one - 1, F.lit(0), one, F.lit(0))))
    cells = F.when(F.col("block") == 0, of_first).otherwise(F.array(_cell(one, F.lit(0), one, F.col("block"))))
    return whole.unionByName(part.select("node", "rep", cells.alias("cells"))), part


def second_cells(part: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, rep, cells, known): what is outside of its region's largest component so far meets every block of its band and the next ones."""
    found = part.join(roots, "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root")
    largest = found.groupBy("region", "known").count().groupBy("region").agg(F.max_by("known", F.struct("count", "known")).alias("largest"))
    found = found.join(largest, "region").withColumn("outside", F.col("known") != F.col("largest"))
    blocks = found.groupBy("region", "band").agg(F.first("blocks").alias("all"), F.ceil(2 * F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)) / F.lit(TREE_SHINGLES)).cast("int").alias("out"))
    for name, step in (("same", 0), ("above", 1), ("below", -1)):
        found = found.join(blocks.select("region", (F.col("band") - step).alias("band"), F.col("all").alias(f"all_{name}"), F.col("out").alias(f"out_{name}")), ["region", "band"], "left")
    found = found.withColumn("out_block", F.pmod(F.xxhash64("node", F.lit(1)), F.greatest("out_same", F.lit(1))).cast("int"))
    one = F.col("band")

    def trees(side: str, step: int):
        """Where a set outside meets the blocks of a band beside its own, or any set the outside blocks of one."""
        if side == "all":
            return lambda k: _cell(one, F.col("out_block"), one + step, k)
        return lambda k: _cell(one + step, k, one, F.col("block"))

    as_outside, as_any = (F.concat(*[F.transform(_upto(f"{side}_{name}"), trees(side, step)) for name, step in (("same", 0), ("above", 1), ("below", -1))]) for side in ("all", "out"))
    cells = F.array_distinct(F.concat(F.when(F.col("outside"), as_outside).otherwise(F.array().cast("array<long>")), as_any))
    return found.select("node", "rep", cells.alias("cells"), "known").where(F.size("cells") > 0)


def join_regions(docs: DataFrame, cells: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (node, root): a spanning forest of each tree's documents, or what joins components in a column ``known``.

    One shuffle join at every size: each text moves once to the sets asked for.
    """
    if "known" not in cells.columns:
        cells = cells.withColumn("known", F.lit(None).cast("long"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            found = [s.tobytes() if len(s) and fingerprint(s)[0] == node else None for node, s in zip(nodes, shingle_sets(batch.column(3), width))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["node", "cells", "known", "hashes"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(nodes, held, known):
            keep = {k: (h, c) for k, h, c in zip(nodes, held, known)}  # a repeated row counts once
            of = None if next(iter(keep.values()))[1] is None else np.array([c for _, c in keep.values()], np.int64)
            links = forest(np.array(list(keep), np.int64), [np.frombuffer(h, np.uint64) for h, _ in keep.values()], percent, of) if len(keep) > 1 else []
            return pa.record_batch({"node": pa.array([x[0] for x in links], pa.int64()), "root": pa.array([x[1] for x in links], pa.int64())})

        cell, nodes, held, known = None, [], [], []
        for batch in batches:
            for c, r, h, k in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != cell and nodes:
                    yield told(nodes, held, known)
                    nodes, held, known = [], [], []
                cell = c
                nodes.append(r)
                held.append(h)
                known.append(k)
        if nodes:
            yield told(nodes, held, known)

    texts = docs.select("doc_id", "text").join(cells.hint("merge"), F.col("doc_id") == F.col("rep")).select("node", "cells", "known", "text")
    each = texts.mapInArrow(sets, "node long, cells array<long>, known long, hashes binary").where("hashes is not null").select(F.explode("cells").alias("cell"), "node", "hashes", "known")
    return each.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(join, "node long, root long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs(doc_id, text)``."""
    return components(docs.select("doc_id", "text"), percent, width).select("doc_id", "n_shingles", "component_id")


def components(docs: DataFrame, percent: int = 80, width: int = 5, extra: str | None = None) -> DataFrame:
    """``near_duplicates`` with ``component``, which tells components under one component_id apart.

    A class of equal sets is one node, named by half its fingerprint; ``rep`` is its
    smallest doc_id.  A component has the name of one of its nodes, null for an empty
    set.  A column ``extra`` of ``docs``, a long, stays.
    """
    shared.bound_batches(docs.sparkSession)
    kept = [extra] if extra else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept)
    signs = shared.materialise(signatures(docs, common_hashes(docs, width), percent, width, extra), "signatures")
    linked = signs.where("doc_id is not null and n_shingles > 0").withColumnRenamed("high", "node")
    classes = linked.groupBy("node", "low").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.max("point").alias("point"))
    classes = shared.materialise(classes, "classes")
    runs = shared.materialise(shared_coordinates(linked.select(F.explode("first").alias("coordinate"), "node")), "runs")
    stars = runs.where("star").select(F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"))
    hubs = linked.select(F.col("node").alias("a"), F.explode("hot").alias("b"))  # a hub is no class, and goes with the join below
    edges = shared.materialise(region_edges(runs.where("not star"), classes, percent).unionByName(stars).unionByName(hubs).distinct(), "shared")
    region = connected_components(edges)
    region = region.unionByName(region.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "region")
    nodes = shared.materialise(region.join(classes, "node").select("node", "rep", "region", "n"), "nodes")
    shared.drop_scratch(runs, edges)
    cells, part = first_cells(nodes)
    links = shared.materialise(join_regions(docs, cells, percent, width), "links")
    roots = links
    if part is not None:
        so_far = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
        so_far = so_far.unionByName(so_far.select(F.col("root").alias("node"), "root").distinct())
        more = shared.materialise(join_regions(docs, second_cells(part, so_far), percent, width), "links")
        roots = connected_components(links.unionByName(more).select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named = roots.join(classes.drop("point"), "node")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("least")), "root").select("node", "root", "least")
    of = signs.select("doc_id", "n_shingles", F.col("high").alias("node"), "low", *kept).join(classes.drop("n", "point").join(named, "node", "left"), ["node", "low"], "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id"))
    out = shared.materialise(of.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce("root", "node").alias("component"), *kept), "components")
    shared.drop_scratch(signs, classes, nodes, links)
    return out
