"""Collocations mined from a prefix-free parse of the corpus.

Texts are cut into pieces at punctuation and line ends.  A chunk ends wherever a hash of
the next four words says so, and takes these four along: neighbours overlap by as many
words as the longest phrase has less one.  The cuts depend on the words alone, so
repeated passages give the same chunks; the distinct ones and how often each occurs are
the dictionary that all later steps read.  A phrase that starts in a chunk's own words
lies in the chunk as a whole and is counted there, times the chunk's frequency; one that
starts in the overlap belongs to the next chunk, so nothing is counted twice.

Phrases are counted by length.  One of ``k`` words is looked at only if both its parts
of ``k - 1`` words are frequent, which a bitmap of bounded size answers; it may let more
through but never less, as the counts decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.llm.bits import bitmap, maybe
from perilgrid.llm.words import blocks, mix, text_bytes, windows, word_hashes
from perilgrid.session import cut_lineage

LONGEST = 5
_OVERLAP = LONGEST - 1
#: One in 16 windows of words starts a new chunk.
_TRIGGER = np.uint64(60)
_BLOCK, _HELD = 2 << 20, 1_000_000
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_CUTS = np.zeros(256, bool)
_CUTS[list(b".,;:!?\n\v\f\r")] = True


# --- parse ------------------------------------------------------------------------


def _gather(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray) -> pa.Array:
    """Strings made of the byte ranges, joined by spaces; ``first`` tells at which range each string begins."""
    last = np.zeros(len(starts), bool)
    last[np.append(first[1:], len(starts)) - 1] = True
    length = stops - starts + ~last
    ends = np.cumsum(length)
    at = np.repeat(starts - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[ends[~last] - 1] = 0x20
    bounds = np.append((ends - length)[first], len(out)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes()))


def parse(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Language, words, number of own words and frequency of the distinct chunks of some texts."""
    data, bounds = text_bytes(texts)
    cut = _CUTS[data]
    low = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    plain = pa.LargeStringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(np.where(cut, 0x20, low).astype(np.uint8).tobytes())
    )
    words, before, starts, stops, _ = word_hashes(plain, spans=True)
    n = len(words)
    if not n:
        return pa.array([], pa.string()), pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    piece = np.cumsum(cut)[starts]
    opens = np.append(True, piece[1:] != piece[:-1])
    opens[before[:-1][before[:-1] < n]] = True
    edge = np.flatnonzero(opens)
    stop_of = np.repeat(np.append(edge[1:], n), np.diff(np.append(edge, n)))
    inside = np.flatnonzero(np.arange(n) + _OVERLAP <= stop_of)
    hit = windows(words, _OVERLAP)[inside] >> _TRIGGER == 0 if n >= _OVERLAP else np.zeros(0, bool)
    opens[inside[hit]] = True
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], n)
    stop = np.where(end < stop_of[begin], end + _OVERLAP, end)
    own = end - begin
    up, down = np.full(n, _STEP, _U), np.full(n, pow(_STEP, -1, 2**64), _U)
    up[0] = down[0] = 1
    sums = np.append(_U(0), np.cumsum(words * np.multiply.accumulate(up)))
    value = (sums[stop] - sums[begin]) * np.multiply.accumulate(down)[begin]
    lang = pc.dictionary_encode(langs.fill_null("und"))
    code = np.asarray(lang.indices)[np.searchsorted(before, begin, "right") - 1].astype(_U)
    value = mix(mix(value ^ mix(own.astype(_U))) + (stop - begin).astype(_U) * _U(_STEP) + code)
    _, at, times = np.unique(value, return_index=True, return_counts=True)
    begin, stop = begin[at], stop[at]
    size = stop - begin
    first = np.cumsum(size) - size
    word = np.repeat(begin - first, size) + np.arange(int(size.sum()))
    return lang.dictionary.take(pa.array(code[at].astype(np.int32))), _gather(low, starts[word], stops[word], first), own[at].astype(np.int32), times


def chunk_dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id``, ``lang``, ``lang_code``, ``words``, ``own``, ``n``: the distinct chunks and how often each occurs."""
    source = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def build(batches):
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK):
                lang, words, own, n = parse(part.column(0), part.column(1))
                yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), words.cast(pa.string()), pa.array(own), pa.array(n)], ["lang", "words", "own", "n"])

    rows = source.mapInArrow(build, "lang string, words string, own int, n bigint").groupBy("lang", "own", "words").agg(F.sum("n").alias("n"))
    return cut_lineage(rows.select(F.xxhash64("lang", "own", "words").alias("id"), "lang", F.xxhash64("lang").alias("lang_code"), "words", "own", "n"))


# --- counts -----------------------------------------------------------------------


class _Chunks:
    """The words of a batch of dictionary rows, hashed with their language."""

    def __init__(self, batch: pa.RecordBatch):
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        self.data, _ = text_bytes(col["words"])
        words, before, self.starts, self.stops, _ = word_hashes(col["words"], spans=True)
        size = np.diff(before)
        self.chunk = np.repeat(np.arange(len(size)), size)
        self.words = mix(words ^ col["lang_code"].to_numpy().view(_U)[self.chunk])
        self.id, self.n, own = col["id"].to_numpy(), col["n"].to_numpy(), col["own"].to_numpy()
        place = np.arange(len(words)) - before[self.chunk]
        self.owned = place < own[self.chunk]
        self.left = size[self.chunk] - place

    def grams(self, k: int) -> np.ndarray:
        return windows(self.words, k)

    def starts_of(self, k: int) -> np.ndarray:
        """Where phrases of ``k`` words start that belong to their chunk."""
        return np.flatnonzero(self.owned & (self.left >= k))

    def text(self, at: np.ndarray, k: int) -> pa.Array:
        size = np.full(len(at), k)
        word = np.repeat(at, size) + np.tile(np.arange(k), len(at))
        return _gather(self.data, self.starts[word], self.stops[word], np.arange(len(at)) * k)


def _summed(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(hashes, kind="stable")
    h = hashes[by]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[at], np.add.reduceat(n[by], at)


def _counted(dictionary: DataFrame, k: int, shorter: DataFrame | None, least: int) -> DataFrame:
    """``h``, ``a``: the phrases of ``k`` words that occur ``least`` times; both parts of one must be in ``shorter``."""
    known = None if shorter is None else _shared_bitmap(shorter)

    def count(batches):
        held, size = [], 0

        def out():
            h, n = _summed(*[np.concatenate(c) for c in zip(*held)])
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for batch in batches:
            for part in blocks(batch, "words", _BLOCK):
                chunks = _Chunks(part)
                at = chunks.starts_of(k)
                if known is not None and len(at):
                    parts = chunks.grams(k - 1)
                    frequent = maybe(known.value, parts)
                    at = at[frequent[at] & frequent[at + 1]]
                if not len(at):
                    continue
                held.append(_summed(chunks.grams(k)[at], chunks.n[chunks.chunk[at]]))
                size += len(held[-1][0])
                if size >= _HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = dictionary.select("lang_code", "words", "own", "n", "id").mapInArrow(count, "h bigint, n bigint")
    return cut_lineage(rows.groupBy("h").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))


def _shared_bitmap(rows: DataFrame):
    """A bitmap of ``h`` with 16 bits to a row, but no more than 32 MB."""
    bits = min(28, max(16, math.ceil(math.log2(16 * rows.count() + 1))))
    return rows.sparkSession.sparkContext.broadcast(bitmap(rows, "h", bits))


def _owners(dictionary: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """``h``, ``id``: one chunk for each phrase that has it among its own."""
    known = _shared_bitmap(phrases)

    def find(batches):
        for batch in batches:
            for part in blocks(batch, "words", _BLOCK):
                chunks, hashes, ids = _Chunks(part), [], []
                for k in range(2, longest + 1):
                    at = chunks.starts_of(k)
                    if len(at):
                        h = chunks.grams(k)[at]
                        ok = maybe(known.value, h)
                        hashes.append(h[ok])
                        ids.append(chunks.id[chunks.chunk[at[ok]]])
                if hashes:
                    h, first = np.unique(np.concatenate(hashes), return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(ids)[first])], ["h", "id"])

    found = dictionary.select("lang_code", "words", "own", "n", "id").mapInArrow(find, "h bigint, id bigint")
    return found.groupBy("h").agg(F.min("id").alias("id")).join(phrases, "h")


def _spelled(dictionary: DataFrame, owners: DataFrame, longest: int) -> DataFrame:
    """``owners`` with ``lang``, ``phrase``, and the hashes ``lefts`` and ``rights`` of both sides of every cut."""
    spark = dictionary.sparkSession
    known = _shared_bitmap(owners)
    chunk_bits = min(28, max(16, math.ceil(math.log2(16 * owners.count() + 1))))
    wanted = spark.sparkContext.broadcast(bitmap(owners.select(F.xxhash64("id").alias("c")), "c", chunk_bits))

    def spell(batches):
        for batch in batches:
            mark = batch.column(6).to_numpy().view(_U)
            for part in blocks(batch.filter(pa.array(maybe(wanted.value, mark))), "words", _BLOCK):
                chunks = _Chunks(part)
                grams = [None, *[chunks.grams(k) for k in range(1, longest + 1)]]
                for k in range(2, longest + 1):
                    at = chunks.starts_of(k)
                    at = at[maybe(known.value, grams[k][at])] if len(at) else at
                    if not len(at):
                        continue
                    _, first = np.unique(np.stack((grams[k][at], chunks.chunk[at].astype(_U))), axis=1, return_index=True)
                    at = at[first]
                    lefts = np.stack([grams[j][at] for j in range(1, k)], 1).view(np.int64)
                    rights = np.stack([grams[k - j][at + j] for j in range(1, k)], 1).view(np.int64)
                    steps = pa.array((np.arange(len(at) + 1) * (k - 1)).astype(np.int32))
                    rows = pa.array(chunks.chunk[at])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams[k][at].view(np.int64)), pa.array(chunks.id[chunks.chunk[at]]), part.column(5).take(rows), chunks.text(at, k).cast(pa.string()),
                            pa.ListArray.from_arrays(steps, pa.array(lefts.ravel())), pa.ListArray.from_arrays(steps, pa.array(rights.ravel())),
                        ],
                        ["h", "id", "lang", "phrase", "lefts", "rights"],
                    )

    rows = dictionary.select("lang_code", "words", "own", "n", "id", "lang", F.xxhash64("id").alias("mark"))
    found = rows.mapInArrow(spell, "h bigint, id bigint, lang string, phrase string, lefts array<bigint>, rights array<bigint>")
    return cut_lineage(found.join(owners, ["h", "id"]).drop("id"))


# --- collocations -----------------------------------------------------------------


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int | None = 2000, longest: int = LONGEST
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the ``top`` phrases of each language.

    Words are lower-cased (A-Z) runs of bytes other than space and tab inside pieces that
    end at ``. , ; : ! ?`` and line ends.  ``a`` is how often a phrase of 2 to ``longest``
    words occurs, ``least`` times or more.  Of its cuts into a first part, that
    occurs ``l`` times, and a rest, that occurs ``r`` times, the one with the lowest
    ``floor(1000 * a * n / (l * r))`` counts, the first of equal ones; ``n`` is the number of
    words of the language.  A phrase all of whose occurrences lie inside those of
    a longer one is left out.  Ties rank by higher ``a``, then by the phrase's bytes.

    Rows without a language are ``und``.  Null and empty texts have no words.  Every row
    counts, repeated ones as often as they occur.  Words are compared by 64-bit hashes,
    sums are exact.  Other columns are not read; an empty table gives no rows.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    dictionary = chunk_dictionary(docs, text_col, lang_col)
    total = dictionary.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("n"))
    levels = [_counted(dictionary, 1, None, least)]
    for k in range(2, longest + 1):
        levels.append(_counted(dictionary, k, levels[-1], least))
    known, phrases = levels[0], levels[1]
    for level in levels[2:]:
        phrases = phrases.union(level)
    known = known.union(phrases)
    spelled = _spelled(dictionary, cut_lineage(_owners(dictionary, phrases, longest)), longest)

    cuts = spelled.select("h", "lang", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("cut", "side"))
    cuts = cuts.select("h", "lang", "a", "cut", F.col("side.lefts").alias("lh"), F.col("side.rights").alias("rh"))
    cuts = cuts.join(known.select(F.col("h").alias("lh"), F.col("a").alias("l")), "lh")
    cuts = cuts.join(known.select(F.col("h").alias("rh"), F.col("a").alias("r")), "rh").join(total, "lang")
    # products of three counts pass 64 bits
    score = F.expr("(cast(a as decimal(17,0)) * 1000 * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", score).groupBy("h").agg(F.min(F.struct("score", "cut", "l", "r", "n")).alias("best"))

    longer = spelled.filter(F.size("lefts") > 1)
    inside = longer.select(F.element_at("lefts", -1).alias("h"), "a").union(longer.select(F.element_at("rights", 1).alias("h"), "a")).distinct()
    kept = spelled.select("h", "lang", "phrase", "a").join(inside, ["h", "a"], "left_anti").join(lowest, "h")
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:  # the first of each share, then of them all, so that no language meets in one task
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
        rows = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    rows = rows.withColumn("rank", rank)
    if top is not None:
        rows = rows.filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
