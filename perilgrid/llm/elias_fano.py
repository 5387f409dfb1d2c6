"""Elias-Fano sequences and the two-level trie of word pairs built from them."""

from __future__ import annotations

import mmap

import numpy as np

_WINDOW = 1 << 15


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned 64-bit values: low bits as they are, high bits in unary."""
    n = len(values)
    if not n:
        return np.zeros(2, np.uint64).tobytes()
    values = values.astype(np.uint64)
    width = max(0, (int(values[-1]) // n).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(high[-1]) + n + 1, np.uint8)
    unary[high + np.arange(n)] = 1
    head = np.array([n, width], np.uint64).tobytes()
    return head + _pack(values & np.uint64((1 << width) - 1), width) + np.packbits(unary, bitorder="little").tobytes()


class EliasFano:
    """Reads an encoded sequence from a buffer, a window of values at a time.

    Only one position of the unary part per window is kept in memory.
    """

    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint8)
        self.n, self.width = (int(x) for x in raw[:16].view(np.uint64))
        cut = 16 + (self.n * self.width + 7) // 8
        self.low, self.high = raw[16:cut], raw[cut:]
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        firsts = np.arange(0, self.n, _WINDOW)
        self.byte = np.searchsorted(ones, firsts, "right")
        self.before = np.where(self.byte > 0, ones[self.byte - 1], 0) if len(ones) else firsts
        self.first = np.array([self.values(a, a + 1)[0] for a in firsts], np.uint64)

    def values(self, a: int, b: int) -> np.ndarray:
        """The values at positions ``a`` to ``b``."""
        b = min(b, self.n)
        if a >= b:
            return np.zeros(0, np.uint64)
        k = a // _WINDOW
        start = int(self.byte[k])
        need, end = b - int(self.before[k]), start
        found = np.zeros(0, np.int64)
        while len(found) < need:
            end = min(len(self.high), max(end + need // 4 + 64, start + 2 * (end - start)))
            found = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little"))
        skip = a - int(self.before[k])
        high = found[skip : skip + b - a] + start * 8 - np.arange(a, b)
        out = high.astype(np.uint64) << np.uint64(self.width)
        if self.width:
            at = a * self.width
            bits = np.unpackbits(self.low[at // 8 : (b * self.width + 7) // 8], bitorder="little")[at % 8 :][: (b - a) * self.width]
            powers = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
            out |= (bits.reshape(-1, self.width) * powers).sum(axis=1, dtype=np.uint64)
        return out

    def successors(self, wanted: np.ndarray) -> np.ndarray:
        """For sorted ``wanted``, the position of the first value that is not less."""
        out = np.full(len(wanted), self.n, np.int64)
        last = np.searchsorted(self.first, wanted, "left") - 1  # the window before the first one that starts not less
        edges = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1]))) if len(wanted) else []
        for a, b in zip(edges, [*edges[1:], len(wanted)]):
            k = max(int(last[a]), 0)
            base = k * _WINDOW
            out[a:b] = base + np.searchsorted(self.values(base, base + _WINDOW), wanted[a:b], "left")
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at sorted positions."""
        out = np.zeros(len(at), np.uint64)
        window = at // _WINDOW
        edges = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1]))) if len(at) else []
        for a, b in zip(edges, [*edges[1:], len(at)]):
            base = int(window[a]) * _WINDOW
            out[a:b] = self.values(base, base + _WINDOW)[at[a:b] - base]
        return out


class PairTrie:
    """Contexts, monotone pointers to their successors, the successors, and quantised values.

    The levels lie one after the other in one memory map.  A successor is stored
    relative to its context: its id plus the context's rank times ``span``, which
    makes the whole level one increasing sequence.
    """

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, values: np.ndarray, span: int, step: float, top: int = 65535):
        first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(contexts) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(contexts))))
        levels = [
            encode(contexts[first]),
            encode(np.append(first, len(contexts))),
            encode(rank.astype(np.uint64) * np.uint64(span) + successors.astype(np.uint64)),
            np.clip(np.rint(values / step), 0, top).astype(np.uint16).tobytes(),
        ]
        self.span, self.step = span, step
        self.map = mmap.mmap(-1, max(1, sum(len(x) + (-len(x)) % 8 for x in levels)))
        at, view = 0, []
        for level in levels:
            self.map[at : at + len(level)] = level
            view.append(np.frombuffer(self.map, np.uint8, len(level), at))
            at += len(level) + (-len(level)) % 8
        self.contexts, self.pointers, self.successors = (EliasFano(v) for v in view[:3])
        self.quantised = view[3].view(np.uint16)

    def lookup(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Values of pairs sorted by context and successor; 0 for pairs that are not there."""
        out = np.zeros(len(contexts))
        if not self.contexts.n or not len(contexts):
            return out
        rank = np.minimum(self.contexts.successors(contexts.astype(np.uint64)), self.contexts.n - 1)
        known = self.contexts.get(rank) == contexts
        relative = rank.astype(np.uint64) * np.uint64(self.span) + successors.astype(np.uint64)
        at = np.minimum(self.successors.successors(relative), self.successors.n - 1)
        inside = (self.pointers.get(rank) <= at.astype(np.uint64)) & (at.astype(np.uint64) < self.pointers.get(rank + 1))
        found = known & inside & (self.successors.get(at) == relative)
        out[found] = self.quantised[at[found]] * self.step
        return out
