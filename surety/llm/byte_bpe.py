"""Byte-level BPE of many texts at once, with the tokenizers library as the encoder.

A text is cut into pre-tokens by array operations; the library encodes each
distinct pre-token once and a table keeps its ids.  Texts outside the checked
characters, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from surety.llm import textbytes as tb

#: Code points below this one, and those in SAFE_RANGES, are classified alike here and in the library.
SAFE_BELOW = 0x0250
SAFE_RANGES = ((0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x0391, 0x03A1), (0x03A3, 0x03C9), (0x0410, 0x044F), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: The letters after an apostrophe that the pre-tokenizer splits off.
ONE_LETTER, TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")


@functools.cache
def safe_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[:SAFE_BELOW] = True
    table[0x80:0xA0] = False
    for a, b in SAFE_RANGES:
        table[a : b + 1] = True
    return table


def contraction_ends(data: np.ndarray, kinds: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Length (0, 2 or 3) of the contraction at each lone apostrophe ``at``; ``last`` is its document's end."""
    n = len(data)
    one, two = data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
    size = np.zeros(len(at), np.int64)
    for a, b in TWO_LETTERS:
        size[(one == a) & (two == b) & (at + 2 < last)] = 3
    size[np.isin(one, np.frombuffer(ONE_LETTER, np.uint8)) & (at + 1 < last)] = 2
    return size


def pretokens(data: np.ndarray, bounds: np.ndarray, chars=None) -> np.ndarray:
    """Starts of the byte-level pre-tokens of each document (its bounds are starts too)."""
    n = len(data)
    kinds = tb.byte_classes(data, chars)
    first = np.zeros(n + 1, bool)
    first[bounds[:-1]] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    head = np.flatnonzero(start)
    # A last white-space character before other text stands alone or, if a blank, joins what follows.
    after = head[(head > 0) & ~first[head]]
    after = after[(kinds[after] != tb.SPACE) & (kinds[after - 1] == tb.SPACE)]
    joined = after[data[after - 1] == 0x20]
    lead = after - 1
    for _ in range(3):
        lead -= (data[lead] & 0xC0) == 0x80
    start[lead] = True
    start[joined] = False
    quote = head[(data[head] == 0x27) & start[head]]
    quote = quote[(quote + 1 < n)]
    quote = quote[(kinds[quote + 1] == tb.LETTER) & ~first[quote + 1]]
    if len(quote):
        size = contraction_ends(data, kinds, quote, bounds[np.searchsorted(bounds, quote, "right")])
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        inner = (quote + size)[quote + size < n]
        start[inner] = True
    return np.flatnonzero(start)


class ByteBpe:
    """``json_text``: a tokenizers file of a byte-level BPE without prefix space."""

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(json_text)
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.whole = spec.get("normalizer") is not None or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("ByteLevel", False, True)
        self.table = tb.SpanTable(np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))

    def _odd(self, data: np.ndarray, bounds: np.ndarray, chars) -> np.ndarray:
        """Documents that the library encodes whole."""
        if self.whole:
            return np.arange(len(bounds) - 1)
        at = [chars[0][~safe_table()[chars[1]]]]
        raw = data.tobytes()
        for s in self.special:
            k = raw.find(s)
            while k >= 0:
                at.append(np.array([k]))
                k = raw.find(s, k + 1)
        return np.unique(np.searchsorted(bounds, np.concatenate(at), "right") - 1)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and each document's bounds among them."""
        docs = len(bounds) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs + 1, np.int64)
        chars = tb.non_ascii(data)
        odd = self._odd(data, bounds, chars)
        starts = pretokens(data, bounds, chars)
        ends = np.append(starts[1:], len(data))
        if len(odd):
            keep = ~np.isin(np.searchsorted(bounds, starts, "right") - 1, odd)
            starts, ends = starts[keep], ends[keep]
        row = self.table.rows_of(data, starts, ends, lambda spans: self._library([s.decode() for s in spans]))
        sizes = self.table.size[row].astype(np.int64)
        ids = self.table.values[tb.gather(self.table.start[row], sizes)]
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, bounds)]
        if not len(odd):
            return ids, upto
        raw = data.tobytes()
        more, values = self._library([raw[bounds[i] : bounds[i + 1]].decode() for i in odd])
        counts = np.diff(upto)
        counts[odd] = more
        out = np.zeros(docs + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        whole = np.empty(out[-1], np.uint32)
        plain = np.setdiff1d(np.arange(docs), odd)
        whole[tb.gather(out[plain], counts[plain])] = ids
        whole[tb.gather(out[odd], more)] = values
        return whole, out


_loaded: dict[int, ByteBpe] = {}


def loaded(json_text: str) -> ByteBpe:
    """The encoder of this worker process, kept between its tasks."""
    key = hash(json_text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(json_text)
    return _loaded[key]
