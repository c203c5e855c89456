"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts come from array operations over the texts' bytes.  Trees
grow level by level on histograms of binned statistics with the logistic loss, and
are flattened into arrays, so that all rows walk all trees at once in numpy.

The model is fitted on a bounded sample of labelled rows (``TRAINING_ROWS`` at most,
about, chosen by hash).  Scoring reads whole texts.

Defined cases: null text counts as empty and is scored like one; null labels are
not learned from; without labels of both kinds the score is the labels' mean (0.5
without any); null doc_ids and repeated rows are kept; other columns
pass through, but one with the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm import ngram_join, shared
from surety.llm import textbytes as tb

TRAINING_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_HESSIAN, RIDGE = 64, 80, 4, 0.15, 2.0, 1.0
_MARKS = b"!?.,;:#$%&*|@<>{}[]()\"'-_=+/\\~^"


def _per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of statistics for each document."""
    docs = len(bounds) - 1
    kinds, lead = tb.byte_classes(data), tb.char_starts(data)
    chars = _per_document(lead, bounds)
    per_char = np.maximum(chars, 1)
    starts, ends, upto = tb.words(data, bounds)
    words = np.diff(upto).astype(np.float64)
    per_word = np.maximum(words, 1)
    upper = (data >= 65) & (data <= 90)
    letter, digit = kinds == tb.LETTER, kinds == tb.NUMBER
    mark = (kinds == tb.OTHER) & lead
    counted = np.concatenate(([0], np.cumsum(mark, dtype=np.int64)))
    raised = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
    lettered = np.concatenate(([0], np.cumsum(letter, dtype=np.int64)))
    marks_in, upper_in, letters_in, size = counted[ends] - counted[starts], raised[ends] - raised[starts], lettered[ends] - lettered[starts], ends - starts

    def of_words(flags):
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[upto[1:]] - total[upto[:-1]]) / per_word

    line_starts, line_ends = tb.runs(data != 10, bounds)
    line_upto = np.searchsorted(line_starts, bounds)
    lines = np.diff(line_upto).astype(np.float64)
    word_hash = tb.span_hash(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    line_hash = tb.span_hash(data, line_starts, line_ends) if len(line_starts) else np.zeros(0, np.uint64)
    grams, gram_upto = ngram_join.shingles(data, bounds)
    kinds_of_words, common, new_lines, new_grams = np.zeros(docs), np.zeros(docs), np.zeros(docs), np.zeros(docs)
    for d in range(docs):
        if words[d]:
            _, n = np.unique(word_hash[upto[d] : upto[d + 1]], return_counts=True)
            kinds_of_words[d], common[d] = len(n), n.max()
            new_lines[d] = len(np.unique(line_hash[line_upto[d] : line_upto[d + 1]]))
            new_grams[d] = len(np.unique(grams[gram_upto[d] : gram_upto[d + 1]]))
    columns = [
        np.log1p(chars), np.log1p(words), np.log1p(lines),
        _per_document(size, upto) / per_word,
        _per_document(letter & lead, bounds) / per_char, _per_document(digit & lead, bounds) / per_char, _per_document(upper, bounds) / per_char,
        _per_document(mark, bounds) / per_char, _per_document(kinds == tb.SPACE, bounds) / per_char, _per_document((data >= 0xC0), bounds) / per_char,
        of_words(marks_in > 0), of_words(marks_in > 1), of_words((upper_in > 1) & (upper_in == letters_in)), of_words(letters_in == 0), of_words(size <= 3), of_words(size >= 12),
        kinds_of_words / np.sqrt(per_word), kinds_of_words / per_word, common / per_word,
        new_lines / np.maximum(lines, 1), words / np.maximum(lines, 1), new_grams / np.maximum(np.diff(gram_upto), 1),
    ]
    for m in _MARKS:
        columns.append(_per_document(data == m, bounds) / per_char)
    return np.stack(columns, axis=1)


class BoostedTrees:
    """Flat arrays: tree t's node i splits ``feature`` at ``cut`` into nodes 2i+1 and 2i+2; leaves hold ``value``."""

    def __init__(self, prior: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.prior, self.feature, self.cut, self.value = prior, feature, cut, value

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = len(self.feature)
        total = np.full(len(x), self.prior)
        if trees:
            tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
            node = np.zeros((len(x), trees), np.int64)
            depth = (self.feature.shape[1] + 1).bit_length() - 1
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
            total += self.value[tree, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        share = float(y.mean()) if len(y) else 0.5
        inner = (1 << DEPTH) - 1
        if not len(y) or not 0 < share < 1:
            return cls(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
        rows, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], axis=1)
        flat = binned + np.arange(width) * BINS
        prior = float(np.log(share / (1 - share)))
        total, features, splits, values = np.full(rows, prior), [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            slope, curve = p - y, p * (1 - p)
            feature, cut, bin_cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS), np.zeros(rows, np.int64)
            for depth in range(DEPTH):
                first, count = (1 << depth) - 1, 1 << depth
                key = ((node - first)[:, None] * (width * BINS) + flat).ravel()
                g, h = (np.bincount(key, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS).cumsum(axis=2) for v in (slope, curve))
                all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = -np.inf
                best = gain.reshape(count, -1).argmax(axis=1)
                for k in range(count):
                    f, b = divmod(int(best[k]), BINS)
                    if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                        feature[first + k], cut[first + k], bin_cut[first + k] = f, cuts[f][b], b
                node = 2 * node + 1 + (binned[np.arange(rows), feature[node]] > bin_cut[node])
            leaf = node - inner
            g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
            value = -RATE * g / (h + RIDGE)
            total += value[leaf]
            features.append(feature)
            splits.append(cut)
            values.append(value)
        return cls(prior, np.stack(features), np.stack(splits), np.stack(values))


def training_table(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a sample of ``labels(doc_id, quality)``, about ``rows`` at most."""
    labels = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    share = min(1.0, rows / max(labels.count(), 1))
    drawn = labels.where(F.pmod(F.xxhash64("labelled"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).limit(2 * rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in tb.text_slices(batch.column(1)):
                x = statistics(data, bounds)
                flat = pa.array(x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], names=["quality", "x"])

    known = docs.join(F.broadcast(drawn), docs["doc_id"] == drawn["labelled"]).select("quality", "text")  # 2 * rows small rows at most
    found = known.mapInArrow(measure, "quality int, x array<double>").limit(4 * rows).toArrow()
    if not found.num_rows:
        return np.zeros((0, 1)), np.zeros(0)
    y = found.column("quality").to_numpy().astype(np.float64)
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T[::-1], y))
    return x[order], y[order]


def score(docs: DataFrame, model: BoostedTrees, name: str = "score") -> DataFrame:
    """Add the score of each row's whole ``text`` to ``docs``; every other column stays."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    parts = docs.sparkSession.sparkContext.broadcast((model.prior, model.feature, model.cut, model.value))
    shared.bound_batches(docs.sparkSession)
    docs = docs.drop(name)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = BoostedTrees(*parts.value)
        for batch in batches:
            found = [trees.score(statistics(data, bounds)) for _, _, data, bounds in tb.text_slices(batch.column(names.index("text")))]
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
