"""Words, shingles and their 64-bit hashes, computed a column at a time.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A text's shingles are its five-word windows; a shorter text is one shingle, its
whole sequence of words.  Texts without words have none.  Hashes are polynomials
over random byte codes, mixed at the end; they depend on nothing but the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
_SLICE = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES[0x41:0x5B] = _CODES[0x61:0x7B]
_CODES[_SPACE] = 0
_STEP = 0x9E3779B97F4A7C15
_FOLD = _U(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_STEP, _SLICE)
_DOWN = _powers(pow(_STEP, -1, 2**64), _SLICE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its values; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _slices(data: np.ndarray, bounds: np.ndarray):
    """Cuts of about a megabyte that never fall inside a word."""
    at, n = 0, len(data)
    while at < n:
        to = at + _SLICE
        if to >= n:
            yield at, n
            return
        back = to - (1 << 16)
        spaces = np.flatnonzero(_SPACE[data[back:to]])
        ends = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, to, "right")]
        cut = max(back + int(spaces[-1]) if len(spaces) else 0, int(ends[-1]) if len(ends) else 0)
        if cut <= at:  # a word of more than a megabyte
            spaces = np.flatnonzero(_SPACE[data[at + 1 :]])
            cut = min(at + 1 + int(spaces[0]) if len(spaces) else n, int(bounds[np.searchsorted(bounds, at, "right")]))
        yield at, cut
        at = cut


def word_hashes(texts: pa.Array, spans: bool = False):
    """Hashes of all words in order, and how many words come before each text.

    With ``spans``, also the byte positions where each word starts and ends.
    """
    data, bounds = text_bytes(texts)
    hashes, starts, stops = [], [], []
    for a, b in _slices(data, bounds):
        part = data[a:b]
        inside = ~_SPACE[part]
        edge = np.zeros(b - a + 1, bool)
        cuts = bounds[np.searchsorted(bounds, a, "left") : np.searchsorted(bounds, b, "right")] - a
        edge[cuts] = True
        edge[0] = edge[-1] = True
        first = inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))
        at = np.flatnonzero(first)
        if not len(at):
            continue
        if b - a <= _SLICE:
            up, down = _UP[: b - a], _DOWN[at]
        else:
            up, down = _powers(_STEP, b - a), _powers(pow(_STEP, -1, 2**64), b - a)[at]
        hashes.append(mix(np.add.reduceat(_CODES[part] * up, at) * down))
        starts.append(at + a)
        if spans:
            last = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
            stops.append(np.flatnonzero(last) + a + 1)
    none = np.zeros(0, np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.concatenate(starts) if starts else none
    before = np.searchsorted(begin, bounds, "left")
    if spans:
        return words, before, begin, (np.concatenate(stops) if stops else none), bounds
    return words, before


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= _FOLD
        h += words[k : k + n]
    return mix(h ^ _U(width))


def shingle_sets(texts: pa.Array, width: int = WIDTH):
    """Sorted distinct shingle hashes of each text, one array per text."""
    words, before = word_hashes(texts)
    rolled = windows(words, width)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        else:
            yield windows(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def blocks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of a batch whose texts take about ``limit`` bytes; one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    size = np.cumsum(np.diff(text_bytes(col)[1]))
    a = 0
    while a < len(col):
        done = int(size[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


def with_text(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """A batch's first column, a struct, and beside it as ``text`` its field ``column``, of which there is one copy."""
    row = batch.column(0)
    return pa.RecordBatch.from_arrays([row, row.field(column)], [batch.schema.names[0], "text"])
