"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

Everything here works on one ``uint8`` array that holds many documents end to
end and an array of document bounds, so no Python string is made per word.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

#: Spans of more bytes are hashed by a digest and compared as bytes, one by one.
LONG_SPAN = 1 << 10
#: The bytes of an eight-byte word that belong to a span with so many bytes left.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, bounds


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``size`` bytes together."""
    rows, lo = len(bounds) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


def text_slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds from 0) for each slice of a column."""
    data, bounds = buffers(column)
    for lo, hi in slices(bounds, size):
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
    release()


def release() -> None:
    """Give freed memory back to the system; a worker shares an executor's with others."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_at(data: np.ndarray) -> np.ndarray:
    """The little-endian eight-byte word from every place of ``data``, zeros behind its end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: eight bytes a step, mixed into a state that began with the length.

    A step is a bijection of the state, so spans of up to eight bytes and one length never
    collide, and no regular pair of texts does; others do with chance 2**-64 a pair.
    """
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(size):
        return h
    word, step = words_at(data), 0
    live = None
    while True:
        live = np.flatnonzero((size > 8 * step) & (size <= LONG_SPAN)) if live is None else live[size[live] > 8 * step]
        if not len(live):
            break
        part = word[starts[live] + 8 * step] & _MASKS[np.minimum(size[live] - 8 * step, 8)]
        h[live] = mix((h[live] ^ part) + np.uint64(0xD6E8FEB86659FD93))
        step += 1
    for k in np.flatnonzero(size > LONG_SPAN):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    for cp in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[cp] = SPACE
    return table


def non_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, code points and byte lengths of the characters beyond ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int32)
    size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
    cp = lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in (1, 2, 3):
        m = size > k
        cp[m] = (cp[m] << 6) | (data[at[m] + k] & 0x3F)
    return at, cp, size


def byte_classes(data: np.ndarray, chars=None) -> np.ndarray:
    """Class of every byte, that of its character."""
    table = class_table()
    out = table[:256].copy()
    out[128:] = OTHER
    out = out[data]
    at, cp, size = chars or non_ascii(data)
    kinds = table[cp]
    out[at] = kinds
    for k in (1, 2, 3):
        m = size > k
        out[at[m] + k] = kinds[m]
    return out


def char_starts(data: np.ndarray) -> np.ndarray:
    """True where a character starts."""
    return (data & 0xC0) != 0x80


def runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut at document bounds."""
    edge = np.zeros(len(flags) + 1, np.int8)
    edge[:-1] = flags
    edge[1:] -= flags.astype(np.int8)
    starts, ends = edge == 1, edge == -1
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(flags))]
    inner = inner[flags[inner - 1] & flags[inner]] if len(inner) else inner
    starts[inner] = True
    ends[inner] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


#: Fixed value of the words' definition: every byte but blank and \t\n\v\f\r.
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and how many precede each document."""
    starts, ends = runs(_WORD_BYTE[data], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span, one span after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    out = np.ones(total, np.int64)
    live = np.flatnonzero(sizes)
    first = ends[live] - sizes[live]
    out[first] = starts[live]
    out[first[1:]] -= starts[live[:-1]] + sizes[live[:-1]] - 1
    return np.cumsum(out)


class SpanTable:
    """A span's bytes to its encoded values, kept between batches of a worker.

    Open addressing by hash in arrays, probed for all spans at once; the bytes of every
    span found are compared, and spans that share a hash with others are kept by their
    bytes.  ``limit`` spans and ``room`` bytes of spans bound its memory: beyond them it
    starts anew, which costs time only.
    """

    def __init__(self, dtype, limit: int = 600_000, room: int = 32 << 20):
        self.dtype, self.limit, self.room = dtype, limit, room
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.hashes = np.zeros(1024, np.uint64)
        self.start, self.size, self.values = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(8192, self.dtype)
        self.span_start, self.span_size, self.text = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint8)
        self.rows = self.used = self.held = 0
        self.shared: dict[bytes, int] = {}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is new."""
        mask = np.uint64((1 << self.bits) - 1)
        at = h & mask
        row = np.full(len(h), -1, np.int64)
        seen = self.keys[at]
        hit = seen == h
        row[hit] = self.slot[at[hit]]
        open_ = np.flatnonzero(~hit & (seen != 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & mask
            seen = self.keys[at[open_]]
            hit = seen == h[open_]
            row[open_[hit]] = self.slot[at[open_[hit]]]
            open_ = open_[~hit & (seen != 0)]
        return row

    def _grow(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _place(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        at, left = h & mask, np.arange(len(h))
        while len(left):
            free = self.keys[at[left]] == 0
            spot, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[spot] = h[won]
            self.slot[spot] = rows[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + np.uint64(1)) & mask

    def add(self, spans: list[bytes], sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Rows for new spans with their values, end to end."""
        n, long = len(spans), np.fromiter(map(len, spans), np.int64, len(spans))
        raw = np.frombuffer(b"".join(spans), np.uint8)
        for name in ("start", "size", "span_start", "span_size", "hashes"):
            self._grow(name, self.rows + n)
        self._grow("values", self.used + len(values))
        self._grow("text", self.held + len(raw) + 8)
        rows = np.arange(self.rows, self.rows + n)
        self.size[rows], self.span_size[rows] = sizes, long
        self.start[rows] = self.used + np.cumsum(sizes) - sizes
        self.span_start[rows] = self.held + np.cumsum(long) - long
        self.values[self.used : self.used + len(values)] = values
        self.text[self.held : self.held + len(raw)] = raw
        self.rows += n
        self.used += len(values)
        self.held += len(raw)
        return rows

    def differ(self, row: np.ndarray, word: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which spans are not the bytes that their rows keep."""
        size = ends - starts
        wrong = self.span_size[row] != size
        kept = np.ndarray((len(self.text) - 7,), "<u8", self.text, 0, (1,))
        live, step = np.flatnonzero(~wrong & (size <= LONG_SPAN)), 0
        while len(live := live[size[live] > 8 * step]):
            mask = _MASKS[np.minimum(size[live] - 8 * step, 8)]
            bad = ((kept[self.span_start[row[live]] + 8 * step] ^ word[starts[live] + 8 * step]) & mask) != 0
            wrong[live[bad]] = True
            live = live[~bad]
            step += 1
        for k in np.flatnonzero(~wrong & (size > LONG_SPAN)):
            at = self.span_start[row[k]]
            wrong[k] = not np.array_equal(self.text[at : at + size[k]], data[starts[k] : ends[k]])
        return np.flatnonzero(wrong)

    def rows_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable) -> np.ndarray:
        """Row of every span; ``encode(spans as bytes) -> (sizes, values)`` serves the new ones."""
        if self.rows > self.limit or self.held > self.room:
            self.clear()
        h = span_hash(data, starts, ends)
        h[h == 0] = 1
        row = self.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            at = new[first]
            raw = data.tobytes()
            spans = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            rows = self.add(spans, *encode(spans))
            self.hashes[rows] = fresh
            if 2 * self.rows > 1 << self.bits:
                self.bits = int(4 * self.rows - 1).bit_length()
                self.keys, self.slot = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
                keyed = np.flatnonzero(self.hashes[: self.rows])  # a span kept by its bytes has no hash here
                self._place(self.hashes[keyed], keyed)
            else:
                self._place(fresh, rows)
            row[new] = self.find(h[new])
        for k in self.differ(row, words_at(data), data, starts, ends):
            span = data[starts[k] : ends[k]].tobytes()
            if span not in self.shared:
                self.shared[span] = int(self.add([span], *encode([span]))[0])
                self.hashes[self.shared[span]] = 0
            row[k] = self.shared[span]
        return row
