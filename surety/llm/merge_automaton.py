"""BPE as a tokenization automaton: encode by transitions, decode by arc labels.

The merges are compiled one after another.  The gadget of merge ``(u, v)``, run on
a deterministic automaton whose arcs carry tokens, gives the state behind every
``u`` arc a copy without its ``v`` arc, and every state with a ``u`` arc a new
``uv`` arc to where ``v`` led.  As the first automaton is one state with an arc
for each symbol, the state behind an arc depends on the arc's token alone and is
kept as a difference: the state of the token's right part as it was when the token
was made, minus the arcs deleted since.  A later arc ``uv`` is missing exactly
where ``u`` already was.  So the compiled automaton has at most one state a merge.
Its tables, made when the file is loaded, are sorted arrays: the deleted arcs with
the time of their deletion, each token's parts and time, and the spelling of all
arcs as one transition table over bytes.

Pre-split words of a batch are walked together through these tables: at each place
of a word the arcs that end there are tried against the state behind them, longest
first.  The automaton accepts one sequence of arcs for each word, its tokens.

Defined cases: null text counts as empty (no ids, empty decoding); a letter without a
symbol in the vocabulary is left out, as the library does; null doc_ids, repeated rows
and empty tables pass through; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm import byte_bpe, shared
from surety.llm import textbytes as tb

@functools.cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@functools.cache
def simple_table() -> np.ndarray:
    """Code points that array operations normalise as the library does."""
    table = byte_bpe.safe_table().copy()
    for cp in np.flatnonzero(table):
        ch = chr(cp)
        same = unicodedata.normalize("NFC", ch) == ch and not unicodedata.combining(ch)
        table[cp] = same and (ch.lower() == ch or cp < 0x80 or (0xC0 <= cp <= 0xDE and cp != 0xD7))
    return table


#: Words of more bytes are walked one by one.
WALKED_TOGETHER = 24


class MergeAutomaton:
    """Compiled from ``merges``, pairs of token strings in the order of application."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()
        self.label = {i: s for s, i in vocab.items()}
        self.inner = {bytes([b]): vocab[letters[b]] for b in range(256) if letters[b] in vocab}
        self.final = {bytes([b]): vocab[letters[b] + suffix] for b in range(256) if letters[b] + suffix in vocab}
        #: Bytes that have a symbol inside a word, and at its end.
        self.known, self.known_last = np.array([bytes([b]) in self.inner for b in range(256)]), np.array([bytes([b]) in self.final for b in range(256)])
        spelling = {i: (s, False) for s, i in self.inner.items()} | {i: (s, True) for s, i in self.final.items()}
        never, size = len(merges), max(vocab.values()) + 1
        left, right, made = np.full(size, -1), np.full(size, -1), np.full(size, never)
        cut: dict[int, int] = {}
        for time, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if left[uv] >= 0 or uv in spelling:
                raise ValueError(f"two merges make {a + b!r}")
            cut.setdefault(u << 32 | v, time)
            left[uv], right[uv], made[uv] = u, v, time
            spelling[uv] = (spelling[u][0] + spelling[v][0], spelling[v][1])
            (self.final if spelling[uv][1] else self.inner)[spelling[uv][0]] = uv
        self.left, self.right, self.made = left, right, made
        self.cut_key = np.array(sorted(cut), np.int64)
        self.cut_time = np.array([cut[k] for k in sorted(cut)], np.int64)
        self.has_cut = np.zeros(size, bool)
        self.has_cut[self.cut_key >> 32] = True
        self.longest = max((len(s) for s, _ in spelling.values()), default=1)
        self._compile_spelling()
        self.tested: dict[int, bool] = {}

    def _compile_spelling(self) -> None:
        """One transition table over bytes: (place, byte) to place; a place has the inner and the final arc spelled so far."""
        steps: dict[int, int] = {}
        arcs: list[list[int]] = [[-1, -1]]
        for kind, tokens in enumerate((self.inner, self.final)):
            for spelled, token in tokens.items():
                place = 0
                for byte in spelled:
                    place = steps.setdefault(place << 8 | byte, len(arcs))
                    if place == len(arcs):
                        arcs.append([-1, -1])
                arcs[place][kind] = token
        self.step_key = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in sorted(steps)], np.int64)
        self.arcs = np.array(arcs, np.int64)

    def has_arcs(self, tokens: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether the state behind each of ``after`` has an arc for the token."""
        out, never = np.ones(len(tokens), bool), len(self.left) + len(self.cut_key)
        live, state, until = np.arange(len(tokens)), after.copy(), np.full(len(tokens), never)
        while len(live):
            inner = np.flatnonzero(self.has_cut[state])
            part, since = tokens[live[inner]], until[inner]
            while len(inner):
                key = state[inner] << 32 | part
                at = np.minimum(np.searchsorted(self.cut_key, key), max(len(self.cut_key) - 1, 0))
                time = np.where(self.cut_key[at] == key, self.cut_time[at], never)
                gone = (time < until[inner]) & (time <= since)
                out[live[inner[gone]]] = False
                more = ~gone & (self.left[part] >= 0)
                inner, since, part = inner[more], self.made[part[more]], self.left[part[more]]
            keep = out[live] & (self.right[state] >= 0)
            until, live, state = self.made[state[keep]], live[keep], self.right[state[keep]]
        return out

    def _tested(self, token: int, after: int) -> bool:
        key = after << 32 | token
        ok = self.tested.get(key)
        if ok is None:
            if len(self.tested) > 1_000_000:
                self.tested.clear()
            ok = self.tested[key] = bool(self.has_arcs(np.array([token]), np.array([after]))[0])
        return ok

    def accept(self, word: bytes, ended: bool = True) -> list[int]:
        """The tokens of one pre-split word: the labels of its accepted path (``ended``: its last letter has the suffix)."""
        if ended and word and not (self.known_last[word[-1]] and all(self.known[b] for b in word[:-1])):
            kept = bytes(b for b in word[:-1] if self.known[b])
            return self.accept(kept + word[-1:]) if self.known_last[word[-1]] else self.accept(kept, False)
        n, longest = len(word), self.longest
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            tokens = self.final if i == n and ended else self.inner
            for j in range(max(0, i - longest), i):
                token = tokens.get(word[j:i])
                if token is None or (j and (last[j] < 0 or not self._tested(token, last[j]))):
                    continue
                last[i], back[i] = token, j
                break
        out, i = [], n
        while i > 0:
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def accept_all(self, words: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each word, and all tokens end to end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        odd = ~self.known[data]
        some = np.flatnonzero(size)
        last = start[some] + size[some] - 1
        odd[last] = ~self.known_last[data[last]]
        count = np.concatenate(([0], np.cumsum(odd)))
        walked = np.flatnonzero((size > 0) & (size <= WALKED_TOGETHER) & (count[start + size] == count[start]))
        number, token = self._walk(data, start[walked], size[walked])
        sizes = np.zeros(len(words), np.int64)
        sizes[walked] = number
        single = {k: self.accept(words[k]) for k in np.flatnonzero((size > 0) & (sizes == 0)).tolist()}
        for k, found in single.items():
            sizes[k] = len(found)
        first = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype)
        out[tb.gather(first[walked], number)] = token
        for k, found in single.items():
            out[first[k] : first[k] + len(found)] = found
        return sizes, out

    def _walk(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of known letters, all words at once."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(-size, kind="stable")
        at = tb.gather(start[order], size[order])
        data, size = data[at].astype(np.int64), size[order]
        start = np.cumsum(size) - size
        end = np.repeat(start + size, size)
        longest = int(min(self.longest, size[0]))
        # spelled[k, p]: the arc of k + 1 bytes from place p, a final one where it ends the word.
        spelled = np.full((longest, len(data)), -1)
        live, place = np.arange(len(data)), np.zeros(len(data), np.int64)
        for k in range(longest):
            live = live[live + k < end[live]]
            key = place[live] << 8 | data[live + k]
            to = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            fits = self.step_key[to] == key
            live, to = live[fits], self.step_to[to[fits]]
            place[live] = to
            spelled[k, live] = self.arcs[to, (live + k + 1 == end[live]).astype(np.int64)]
        last, back = np.full(len(data), -1), np.zeros(len(data), np.int64)
        for i in range(1, int(size[0]) + 1):
            here = start[: np.searchsorted(-size, -i, "right")] + i - 1
            for k in range(min(i, longest), 0, -1):
                token = spelled[k - 1, here - k + 1]
                good = token >= 0
                if i > k:
                    before = last[here - k]
                    good &= before >= 0
                    some = np.flatnonzero(good)
                    good[some] = self.has_arcs(token[some], before[some])
                last[here[good]], back[here[good]] = token[good], k
                here = here[~good]
                if not len(here):
                    break
        at, live, found = start + size - 1, np.arange(len(start)), []
        number = np.zeros(len(start), np.int64)
        while len(live):
            found.append((live, last[at[live]]))
            number[live] += 1
            at[live] -= back[at[live]]
            live = live[at[live] >= start[live]]
        turned = np.empty(len(number), np.int64)
        turned[order] = number
        first = (np.cumsum(turned) - turned)[order]
        out = np.empty(int(number.sum()), np.int64)
        for k, (word, token) in enumerate(found):
            out[first[word] + number[word] - 1 - k] = token
        return turned, out


class WordBpe:
    """Encoder and decoder for a tokenizers file of a lower-casing word BPE."""

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer

        spec = json.loads(json_text)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_str(json_text)
        self.normalise, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        labels = self.automaton.label | {i: s for s, i in self.special.items()}
        texts = [(" " + labels[i]).encode() if i in labels else b"" for i in range(max(labels) + 1)]
        self.label_size = np.array([len(x) for x in texts])
        self.label_start = np.cumsum(self.label_size) - self.label_size
        self.label_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.table = tb.SpanTable(np.uint16 if max(labels) < 1 << 16 else np.uint32)

    def encode_text(self, text: str) -> list[int]:
        """Ids of any one text; the library normalises and pre-splits it."""
        out: list[int] = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word, _ in self.presplit(self.normalise(part)):
                out += self.automaton.accept(bytes(self.byte_of[c] for c in word))
        return out

    def _spans(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of normalised simple texts."""
        n = len(data)
        kinds = tb.byte_classes(data)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        start = first[:n].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        quote = np.flatnonzero(start & (data == 0x27))
        quote = quote[quote + 1 < n]
        quote = quote[(kinds[quote + 1] == tb.LETTER) & ~first[quote + 1]]
        start |= (kinds == tb.NUMBER) & tb.char_starts(data)
        if len(quote):
            size = byte_bpe.contraction_ends(data, kinds, quote, bounds[np.searchsorted(bounds, quote, "right")])
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            start[(quote + size)[quote + size < n]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        keep = kinds[starts] != tb.SPACE
        return starts[keep], ends[keep]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and each document's bounds among them."""
        docs = len(bounds) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
        at, cp, _ = tb.non_ascii(data)
        places = [at[~simple_table()[cp]]]
        raw = data.tobytes()
        for s in self.special:
            k = raw.find(s.encode())
            while k >= 0:
                places.append(np.array([k]))
                k = raw.find(s.encode(), k + 1)
        odd = np.unique(np.searchsorted(bounds, np.concatenate(places), "right") - 1)
        low = tb.lower_ascii(data)
        big = at[(cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7)]
        low[big + 1] += 0x20
        starts, ends = self._spans(low, bounds)
        if len(odd):
            keep = ~np.isin(np.searchsorted(bounds, starts, "right") - 1, odd)
            starts, ends = starts[keep], ends[keep]
        row = self.table.rows_of(low, starts, ends, lambda words: self.automaton.accept_all(words, self.table.dtype))
        sizes = self.table.size[row].astype(np.int64)
        ids = self.table.values[tb.gather(self.table.start[row], sizes)]
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, bounds)]
        if not len(odd):
            return ids, upto
        found = [self.encode_text(raw[bounds[i] : bounds[i + 1]].decode()) for i in odd]
        counts = np.diff(upto)
        counts[odd] = [len(x) for x in found]
        out = np.zeros(docs + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        whole = np.empty(out[-1], self.table.dtype)
        plain = np.setdiff1d(np.arange(docs), odd)
        whole[tb.gather(out[plain], counts[plain])] = ids
        whole[tb.gather(out[odd], counts[odd])] = np.array([i for x in found for i in x], self.table.dtype)
        return whole, out

    def decode(self, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all documents end to end with a blank before each token, and its bounds."""
        sizes = self.label_size[ids]
        text = self.label_bytes[tb.gather(self.label_start[ids], sizes)]
        return text, np.concatenate(([0], np.cumsum(sizes)))[upto]


_loaded: dict[int, WordBpe] = {}


def loaded(json_text: str) -> WordBpe:
    """The coder of this worker process, kept between its tasks."""
    key = hash(json_text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(json_text)
    return _loaded[key]


def _coded(docs: DataFrame, tokenizer_path: str, row, schema: str) -> DataFrame:
    shared.bound_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path).read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(source.value)
        for batch in batches:
            for lo, hi, data, bounds in tb.text_slices(batch.column(1)):
                ids, upto = coder.encode(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *row(coder, ids, upto)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int> and decoded string of each document."""

    def row(coder, ids, upto):
        text, at = coder.decode(ids, upto)
        raw = text.tobytes()
        decoded = [raw[a + 1 : b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())

    return _coded(docs, tokenizer_path, row, "doc_id long, ids array<int>, decoded string")


def coding_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""

    def row(coder, ids, upto):
        text, at = coder.decode(ids, upto)
        wide, text = memoryview(ids.astype("<u4")).cast("B"), memoryview(text)
        of_ids = [hashlib.sha256(wide[4 * a : 4 * b]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        of_text = [hashlib.sha256(text[a + 1 : b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.array(np.diff(upto)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())

    return _coded(docs, tokenizer_path, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
