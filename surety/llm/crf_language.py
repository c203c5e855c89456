"""Language identification by a linear-chain conditional random field over words.

A word's features are its byte n-grams with word-boundary marks (those at a mark
are its affixes) and, for words of the training lexicon, the word itself.  Feature
weights and label transitions are learned together by gradient ascent on the
likelihood of word sequences, some of them spliced from several languages so that
the transitions learn code-switching.  Forward-backward gives each word's label
probabilities in the whole text; their mean over the words is the document's.

The model is fitted on a bounded sample: ``PER_LANGUAGE`` labelled documents of each of
the ``MOST_LANGUAGES`` most frequent languages, of longer ones about ``SAMPLE_CHARS``
characters from all over the text.  Prediction reads whole texts.

Defined cases: null text, or text without a letter, is ``und`` with score 0; rows
without lang are never learned from; if nothing can be learned from, every row is
``und``; null doc_ids and repeated rows are kept; other columns pass through, but
one with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm import shared
from surety.llm import textbytes as tb

PER_LANGUAGE, MOST_LANGUAGES, SAMPLE_CHARS = 300, 200, 1_500
#: A long text's sample is drawn in pieces of about so many characters, which end beside words.
PIECE_CHARS = 150
_PIECE = rf"(?sU).{{1,{PIECE_CHARS}}}(?!\w)|.{{1,{PIECE_CHARS}}}"
#: Rows of the n-gram weight table, longest n-gram, least count of a lexicon word.
TABLE, LONGEST, LEXICON_COUNT = 1 << 16, 4, 2
SEQUENCE_WORDS, EPOCHS, RATE, DECAY = 48, 60, 0.15, 1e-4
UNKNOWN = "und"


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, byte for byte."""
    out = tb.lower_ascii(data)
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    big = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[big] += 0x20
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and how many precede each document."""
    starts, ends = tb.runs(tb.byte_classes(data) == tb.LETTER, bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def features(words: list[bytes], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words end to end, and each word's bounds among them.

    Row ``TABLE + i`` is the i-th lexicon word, row ``TABLE + len(lexicon)`` any other.
    """
    text = np.frombuffer(b"".join(b"\x01%b\x02" % w for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    start = np.cumsum(size) - size
    last = np.repeat(start + size, size)
    at, found, owner = np.arange(len(text)), [], []
    word = np.repeat(np.arange(len(words)), size)
    h = np.zeros(len(text), np.uint64)
    for n in range(1, LONGEST + 1):
        fits = at + n <= last
        h = (h[: len(text)] * np.uint64(1_000_003)) + np.uint64(1)
        h[fits] += text[at[fits] + n - 1]
        found.append((tb.mix(h[fits] + np.uint64(n << 56)) % np.uint64(TABLE)).astype(np.int64))
        owner.append(word[fits])
    keys = tb.span_hash(text.astype(np.uint8), start, start + size)
    spot = np.searchsorted(lexicon, keys)
    known = np.zeros(len(words), bool)
    if len(lexicon):
        known = lexicon[np.minimum(spot, len(lexicon) - 1)] == keys
    found.append(TABLE + np.where(known, spot, len(lexicon)))
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def word_keys(words: list[bytes]) -> np.ndarray:
    text = np.frombuffer(b"".join(b"\x01%b\x02" % w for w in words), np.uint8)
    size = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(size) - size
    return tb.span_hash(text, start, start + size)


def forward_backward(emit: np.ndarray, step: np.ndarray, upto: np.ndarray, past: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every word from ``exp`` scores; sequences end to end with bounds ``upto``.

    ``past`` gets the probabilities given the words up to each one alone.
    """
    size = np.diff(upto)
    order = np.argsort(-size, kind="stable")
    first, size = upto[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")
    out = np.empty_like(emit)
    state = None
    for t in range(longest):
        at = first[: live[t]] + t
        state = emit[at] if t == 0 else (state[: live[t]] @ step) * emit[at]
        state /= state.sum(axis=1, keepdims=True)
        out[at] = state
    if past is not None:
        past[:] = out
    back = np.ones((0, emit.shape[1]))
    turned = np.ascontiguousarray(step.T)
    for t in range(longest - 1, -1, -1):
        at = first[: live[t]] + t
        if live[t] > len(back):
            back = np.concatenate((back, np.ones((live[t] - len(back), emit.shape[1]))))
        both = out[at] * back
        out[at] = both / both.sum(axis=1, keepdims=True)
        back = (back * emit[at]) @ turned
        back /= back.sum(axis=1, keepdims=True)
    return out


class LanguageCrf:
    def __init__(self, labels: list[str], lexicon: np.ndarray, weights: np.ndarray, steps: np.ndarray):
        self.labels, self.lexicon, self.weights, self.steps = labels, lexicon, weights, steps

    def scores(self, words: list[bytes]) -> np.ndarray:
        rows, upto = features(words, self.lexicon)
        return np.add.reduceat(self.weights[rows], upto[:-1], axis=0)

    @classmethod
    def fit(cls, texts: list[tuple[str, str]]) -> "LanguageCrf":
        """From (language, text) rows."""
        labels = sorted({x for x, _ in texts})
        rng = np.random.default_rng(8)
        held = []
        for lang, text in texts:
            data = lower(np.frombuffer(text.encode(), np.uint8))
            starts, ends, _ = word_spans(data, np.array([0, len(data)]))
            raw = data.tobytes()
            held.append((labels.index(lang), [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]))
        held = [x for x in held if x[1]]
        vocabulary: dict[bytes, int] = {}
        sequences, gold = [], []
        for label, words in held:
            for at in range(0, len(words), SEQUENCE_WORDS):
                part = words[at : at + SEQUENCE_WORDS]
                sequences.append([vocabulary.setdefault(w, len(vocabulary)) for w in part])
                gold.append([label] * len(part))
        for _ in range(len(sequences) // 4):  # spliced sequences: what code-switched text looks like
            ids, tags = [], []
            while len(ids) < SEQUENCE_WORDS:
                k, n = int(rng.integers(len(sequences))), int(rng.integers(6, 24))
                ids += sequences[k][:n]
                tags += gold[k][:n]
            sequences.append(ids[:SEQUENCE_WORDS])
            gold.append(tags[:SEQUENCE_WORDS])
        words = list(vocabulary)
        if not words:
            return cls([], np.zeros(0, np.uint64), np.zeros((TABLE + 1, 1)), np.zeros((1, 1)))
        ids, tags = np.concatenate(sequences), np.concatenate(gold)
        lexicon = np.unique(word_keys(words)[np.bincount(ids, minlength=len(words)) >= LEXICON_COUNT])
        rows, upto = features(words, lexicon)
        owner = np.repeat(np.arange(len(words)), np.diff(upto))
        size, m = TABLE + len(lexicon) + 1, len(labels)
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in sequences])))
        inner = np.ones(len(ids), bool)
        inner[bounds[:-1]] = False
        after = np.flatnonzero(inner)
        true_steps = np.zeros((m, m))
        np.add.at(true_steps, (tags[after - 1], tags[after]), 1)
        weights, steps = np.zeros((size, m)), np.zeros((m, m))
        square_w, square_s = np.full((size, m), 1e-6), np.full((m, m), 1e-6)
        for _ in range(EPOCHS):
            word_scores = np.add.reduceat(weights[rows], upto[:-1], axis=0)
            emit = np.exp(word_scores - word_scores.max(axis=1, keepdims=True))[ids] + 1e-30
            step = np.exp(steps - steps.max())
            past = np.empty_like(emit)
            share = forward_backward(emit, step, bounds, past)
            # Adjacent labels' joint probability, summed: past x step x (share / what the step leads to).
            before = past[after - 1]
            joint = step * np.einsum("ti,tj->ij", before, share[after] / np.maximum(before @ step, 1e-300))
            miss = -share
            miss[np.arange(len(ids)), tags] += 1
            by_word = np.stack([np.bincount(ids, miss[:, k], len(words)) for k in range(m)], axis=1)
            slope = np.stack([np.bincount(rows, by_word[owner, k], size) for k in range(m)], axis=1) / len(ids) - DECAY * weights
            slope_s = (true_steps - joint) / len(ids) - DECAY * steps
            square_w += slope**2
            square_s += slope_s**2
            weights += RATE * slope / np.sqrt(square_w)
            steps += RATE * slope_s / np.sqrt(square_s)
        return cls(labels, lexicon, weights.astype(np.float32), steps)


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """A sample of labelled ``docs(doc_id, text, lang)``, chosen by hash, of bounded size.

    Of a text longer than SAMPLE_CHARS, pieces from all over it are drawn by hash.
    """
    docs = docs.where("text is not null and lang is not null")
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    known = F.broadcast(counts.select("lang", F.least(F.lit(1.0), F.lit(1.2 * per_language) / F.col("count")).alias("share")))  # MOST_LANGUAGES rows at most
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < F.col("share") * 1_000_003
    pieces = F.transform(F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0)), lambda p, i: F.struct(F.xxhash64("doc_id", i).alias("by"), i.alias("at"), p.alias("piece")))
    least = F.slice(F.array_sort(pieces), 1, SAMPLE_CHARS // PIECE_CHARS)
    inside = F.array_sort(F.transform(least, lambda p: F.struct(p["at"].alias("at"), p["piece"].alias("piece"))))
    sample = F.when(F.char_length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(F.array_join(F.transform(inside, lambda p: p["piece"]), " "))
    rows = docs.join(known, "lang").where(drawn).select("lang", sample.alias("text")).limit(2 * per_language * MOST_LANGUAGES).collect()
    return sorted((r["lang"], r["text"]) for r in rows)


class _Reader:
    """Words of texts and their label probabilities, in a worker."""

    def __init__(self, parts):
        self.crf = LanguageCrf(*parts)
        self.labels = len(self.crf.labels)
        self.step = np.exp(self.crf.steps - self.crf.steps.max())
        self.table = tb.SpanTable(np.float32)

    def _encode(self, words: list[bytes]):
        s = self.crf.scores(words)
        return np.full(len(words), self.labels), np.exp(s - s.max(axis=1, keepdims=True)).ravel()

    def read(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and probabilities of all words, and each text's bounds among them."""
        low = lower(data)
        starts, ends, upto = word_spans(low, bounds)
        if not self.labels or not len(starts):
            return starts, ends, np.zeros((len(starts), self.labels)), upto
        row = self.table.rows_of(low, starts, ends, self._encode)
        emit = self.table.values[: self.table.used].reshape(-1, self.labels)[row].astype(np.float64) + 1e-30
        return starts, ends, forward_backward(emit, self.step, upto), upto


def identify(docs: DataFrame, model: LanguageCrf, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the columns ``label`` and ``score`` to ``docs`` with a ``text`` column; every other column stays."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    parts = docs.sparkSession.sparkContext.broadcast((model.labels, model.lexicon, model.weights, model.steps))
    shared.bound_batches(docs.sparkSession)
    docs = docs.drop(label, score)
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(label, StringType()), StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(parts.value)
        m, names_of = reader.labels, np.array([*reader.crf.labels, UNKNOWN], object)
        for batch in batches:
            labels, scores = [], []
            for lo, hi, data, bounds in tb.text_slices(batch.column(names.index("text"))):
                starts, _, share, upto = reader.read(data, bounds)
                best, top = np.full(hi - lo, m), np.zeros(hi - lo)
                if m and len(starts):
                    some = np.flatnonzero(np.diff(upto))
                    mean = np.add.reduceat(share, upto[:-1][some], axis=0) / np.diff(upto)[some, None]
                    best[some], top[some] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
                labels.append(names_of[best])
                scores.append(top)
            if labels:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(labels), pa.string()), pa.array(np.concatenate(scores))], names=[*names, label, score])

    return docs.mapInArrow(run, schema)


def label_words(docs: DataFrame, model: LanguageCrf) -> DataFrame:
    """(doc_id, words): each word's place in the text (code points, end exclusive), likeliest language and its probability.

    ``words`` is empty for a null text, for one without a letter, and if nothing was learned.
    """
    parts = docs.sparkSession.sparkContext.broadcast((model.labels, model.lexicon, model.weights, model.steps))
    shared.bound_batches(docs.sparkSession)
    word = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(parts.value)
        names_of = np.array([*reader.crf.labels, UNKNOWN], object)
        for batch in batches:
            for lo, hi, data, bounds in tb.text_slices(batch.column(1)):
                starts, ends, share, upto = reader.read(data, bounds)
                if not reader.labels:
                    starts, ends, share, upto = starts[:0], ends[:0], share[:0], np.zeros_like(upto)
                place = np.concatenate(([0], np.cumsum(tb.char_starts(data))))
                first = place[np.repeat(bounds[:-1], np.diff(upto))]
                best = share.argmax(axis=1) if len(share) else np.zeros(0, np.int64)
                columns = [pa.array(place[starts] - first), pa.array(place[ends] - first), pa.array(names_of[best], pa.string()), pa.array(share[np.arange(len(best)), best])]
                words = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(word)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), words], names=["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, words array<struct<start:long,end:long,lang:string,probability:double>>")
