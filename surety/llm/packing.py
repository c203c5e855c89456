"""Packing by cutting-stock column generation.

A document's ids are cut into full sequences and one remainder.  The lengths are
counted in classes of ``grain`` tokens; that histogram has a fixed number of bars
whatever the corpus.  A linear program over patterns (what a sequence holds) is
solved by column generation: knapsack dynamic programming over the bars prices
new columns.  Patterns rounded down, and a best-fit packing of the rounding's
rest, give whole sequences; the pieces of each class, ranked without gathering
a class in one task, are then dealt to the patterns' places by rank.  The last
pieces of a few documents (a number that does not grow with the corpus) stay out
of the program and are cut to fill what the patterns leave open.

A sequence is as long as its pieces; whoever writes it pads it to the capacity, unless its
length is a power of two, which needs no padding.

Defined cases: null text counts as empty and packs its end id alone; null and
repeated doc_ids are kept as rows of their own; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surety.llm import byte_bpe, shared
from surety.llm import textbytes as tb

#: Pieces that share one ranking group, at most about and at least about; cuts of a bar's ranks where its patterns are looked up.
GROUP_ROWS, LEAST_ROWS, RANK_CUTS = 50_000, 64, 64
#: Documents, about and at most a share of all, whose last pieces fill open sequences.
FILLERS, FILLER_SHARE = 1_500, 0.2
#: The smallest opening that is filled.
SMALLEST_FILL = 32


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None, capacity: int = 2048, share: float = 0.0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece of at most ``capacity`` ids, and its ``lot``, a random number.

    A random ``share`` of the documents keeps the ids of its last piece in ``ids``.
    """
    shared.bound_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path).read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, chance = byte_bpe.loaded(source.value), np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for lo, hi, data, bounds in tb.text_slices(batch.column(1)):
                ids, upto = coder.encode(data, bounds)
                if end_id is not None:
                    ids = np.insert(ids, upto[1:], end_id)
                    upto = upto + np.arange(len(upto))
                raw = memoryview(ids.astype("<u4")).cast("B")
                total = np.diff(upto)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, total[doc] - start)
                first = upto[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                last = (start + length == total[doc]) & (length < capacity) & (chance.random(len(doc)) < share)
                kept = [bytes(raw[4 * a : 4 * b]) if k else None for a, b, k in zip(first.tolist(), (first + length).tolist(), last.tolist())]
                yield pa.record_batch(
                    {"doc_id": batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total[doc]), "ids": pa.array(kept, pa.binary()), "lot": pa.array(chance.integers(0, 1 << 40, len(doc)))}
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, lot long")


def price_column(values: np.ndarray, weights: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within ``room``: unbounded knapsack."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for cap in range(1, room + 1):
        n = int(np.searchsorted(weights, cap, "right"))
        best[cap] = best[cap - 1]
        if n:
            gain = values[:n] + best[cap - weights[:n]]
            k = n - 1 - int(gain[::-1].argmax())  # of equal gains the longest: short pieces are kept for later
            if gain[k] > best[cap] + 1e-12:
                best[cap], take[cap] = gain[k], k
    column, cap = np.zeros(len(values)), room
    while cap > 0:
        if take[cap] < 0:
            cap -= 1
        else:
            column[take[cap]] += 1
            cap -= weights[take[cap]]
    return best[room], column


def first_patterns(demand: np.ndarray, weights: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feasible basis, its inverse and amounts: fill up the largest length left until some length is used up, and so on.

    Each pattern holds the length that it uses up and none used up before, so the
    columns are triangular in that order and the amounts are exact.
    """
    m = len(demand)
    left, columns, x, open_ = demand.astype(np.float64), np.zeros((m, m)), np.zeros(m), np.ones(m, bool)
    order = []
    for k in range(m):
        live = np.flatnonzero(open_)
        top = live[-1]
        column = np.zeros(m)
        column[top] = 1
        _, rest = price_column(weights[live].astype(np.float64), weights[live], room - int(weights[top]))
        column[live] += rest
        used = np.flatnonzero(column)
        ratio = left[used] / column[used]
        x[k] = ratio.min()
        left = np.maximum(left - x[k] * column, 0)
        done = int(used[ratio.argmin()])
        left[done] = 0
        open_[done] = False
        order.append(done)
        columns[:, k] = column
    lower, inverse = columns[order], np.eye(m)
    for k in range(m):
        inverse[k] /= lower[k, k]
        below = k + 1 + np.flatnonzero(lower[k + 1 :, k])
        inverse[below] -= lower[below, k, None] * inverse[k]
    turned = np.empty((m, m))
    turned[:, order] = inverse
    return columns, turned, x


def solve_patterns(demand: np.ndarray, weights: np.ndarray, room: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Columns and amounts of the linear program min sum(x), A x = demand, x >= 0.

    Ends when the dual bound is within ``gap`` of the primal value, or when no column
    improves it: at the optimum, or (rounding aside) after 50 degenerate steps a class.
    """
    columns, inverse, x = first_patterns(demand, weights, room)
    bound, stalled, least = float((weights * demand).sum()) / room, 0, float(x.sum())
    while x.sum() > bound * (1 + gap) and stalled < 50 * len(demand):
        duals = np.maximum(inverse.sum(axis=0), 0)
        value, column = price_column(duals, weights, room)
        bound = max(bound, float((duals * demand).sum()) / max(value, 1e-9))
        if value <= 1 + 1e-9:
            break
        # Columns are sparse, so a plain sum is enough.
        held = np.flatnonzero(column)
        step = (inverse[:, held] * column[held]).sum(axis=1)
        rows = np.flatnonzero(step > 1e-9)
        ratio = x[rows] / step[rows]
        out = rows[int(ratio.argmin())]
        x -= ratio.min() * step
        x[out] = ratio.min()
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = column
        np.maximum(x, 0, out=x)
        stalled = 0 if x.sum() < least * (1 - 1e-12) else stalled + 1
        least = min(least, float(x.sum()))
    return columns, x


def best_fit(counts: np.ndarray, weights: np.ndarray, room: int) -> list[np.ndarray]:
    """Best-fit decreasing of ``counts[i]`` items of ``weights[i]`` into bins of ``room``."""
    by_room: dict[int, list[np.ndarray]] = {}
    for k in np.argsort(-weights):
        for _ in range(int(counts[k])):
            fit = min((r for r in by_room if r >= weights[k]), default=None)
            if fit is None:
                used, fit = np.zeros(len(weights), np.int64), room
            else:
                used = by_room[fit].pop()
                if not by_room[fit]:
                    del by_room[fit]
            used[k] += 1
            by_room.setdefault(fit - int(weights[k]), []).append(used)
    return [used for bins in by_room.values() for used in bins]


def plan_patterns(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern as class: items, sequences) that together hold every counted item once."""
    weights = np.array(sorted(counts), np.int64)
    demand = np.array([counts[w] for w in weights], np.float64)
    if not len(weights):
        return []
    columns, x = solve_patterns(demand, weights, room)
    out, left = [], demand.astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        column = columns[:, k].astype(np.int64)
        live = np.flatnonzero(column)
        times = int(min(np.floor(x[k] + 1e-9), (left[live] // column[live]).min()))
        if times > 0:
            left -= times * column
            out.append(({int(weights[i]): int(column[i]) for i in live}, times))
    for used in best_fit(left, weights, room):
        out.append(({int(weights[i]): int(used[i]) for i in np.flatnonzero(used)}, 1))
    return out


def fill(openings: list[tuple[int, int]], fillers: list, first: int, capacity: int) -> list[tuple]:
    """Cut the fillers to the openings (sequence, tokens), then to sequences of their own from ``first``."""
    out, opening, room, place = [], iter(openings), 0, 0
    sequence, fresh = -1, first
    for row in sorted(fillers, key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"])):
        at = 0
        while at < row["length"]:
            if not room:
                sequence, room = next(opening, (fresh, capacity))
                fresh += sequence == fresh
                place = 1 << 40
            n = min(room, row["length"] - at)
            crc = zlib.crc32(row["ids"][4 * at : 4 * (at + n)])
            out.append((row["doc_id"], row["start"] + at, n, crc, row["doc_tokens"], sequence, place))
            at, room, place = at + n, room - n, place + 1
    return out


def deal(pieces: DataFrame, capacity: int = 2048, grain: int = 4) -> DataFrame:
    """Add sequence_id and offset to materialised pieces (columns of :func:`cut_pieces`)."""
    spark = pieces.sparkSession
    room = -(-capacity // grain)
    fillers = pieces.where("ids is not null").collect()  # about FILLERS at most, by the share drawn
    pieces = pieces.where("ids is null").drop("ids").withColumn("bar", F.ceil(F.col("length") / F.lit(grain)).cast("int"))
    counts = {r["bar"]: r["count"] for r in pieces.groupBy("bar").count().collect()}
    total, partitions = sum(counts.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_rows = min(GROUP_ROWS, max(LEAST_ROWS, total // (4 * partitions)))
    salts, cuts = {b: -(-n // group_rows) for b, n in counts.items()}, {b: -(-n // RANK_CUTS) for b, n in counts.items()}
    rows, upto, first, openings, wanted = [], dict.fromkeys(counts, 0), 0, [], sum(r["length"] for r in fillers)
    for pattern, times in plan_patterns(counts, room):
        slot = 0
        for bar in sorted(pattern, reverse=True):
            each, lo = pattern[bar], upto[bar]
            hi = upto[bar] = lo + each * times
            rows += [(bar, cut, lo, hi, each, first, slot) for cut in range(lo // cuts[bar], (hi - 1) // cuts[bar] + 1)]
            slot += each
        free = capacity - grain * sum(bar * n for bar, n in pattern.items())
        if free >= SMALLEST_FILL:
            openings += [(first + i, free) for i in range(min(times, wanted // free + 1))]
        first += times
    dealt_fillers = fill(sorted(openings, key=lambda o: -o[1]), fillers, first, capacity)
    # At most one row for each bar of each pattern and each cut of each bar: sizes that no corpus exceeds.
    places = spark.createDataFrame(rows, "bar int, cut long, lo long, hi long, each long, first long, slot long")
    bars = spark.createDataFrame([(b, salts[b], cuts[b]) for b in counts], "bar int, salts long, step long")
    salted = pieces.join(F.broadcast(bars), "bar").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "lot"), F.col("salts")))
    before = salted.groupBy("bar", "salt").count()
    before = before.select("bar", "salt", (F.sum("count").over(Window.partitionBy("bar").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("bar", "salt").orderBy("doc_id", "start", "ids_crc32", "lot")) - 1)
    ranked = ranked.join(before, ["bar", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).withColumn("cut", F.floor(F.col("rank") / F.col("step")))
    dealt = ranked.join(F.broadcast(places), ["bar", "cut"]).where("rank >= lo and rank < hi")
    dealt = dealt.withColumn("sequence_id", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long"))
    dealt = dealt.withColumn("place", (F.col("slot") + F.pmod(F.col("rank") - F.col("lo"), F.col("each"))).cast("long"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
    dealt = dealt.select(*[c.split()[0] for c in schema.split(", ")]).unionByName(spark.createDataFrame(dealt_fillers, schema))
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None, capacity: int = 2048, grain: int = 4) -> DataFrame:
    """Pack ``docs(doc_id, text)``: one row for each piece.

    ``grain`` is the histogram's class width; a piece wastes less than it at most.
    """
    rows = docs.count()
    share = min(FILLER_SHARE, FILLERS / max(rows, 1))
    return deal(shared.materialise(cut_pieces(docs, tokenizer_path, end_id, capacity, share), "pieces"), capacity, grain)
