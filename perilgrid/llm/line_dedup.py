"""Removes passages that repeat, by windows of three consecutive lines.

A document is a row of lines.  Physical lines are cut further by their words alone,
wherever they begin: at every sentence end (a word that ends in ``.``, ``!`` or ``?``), and in
each run of eight words without one at the word where a hash of the last three words of
the line is least (the last such word).  Whether a word ends a line depends on nine
words before it and seven after it, and no line has more than eight words but at the
ends of a physical line, so a passage of 50 words always holds the same three whole
lines.  Blank lines are not counted.

Each window of three lines is hashed by its words, so case (A-Z) and spacing do not
matter.  A first pass counts the hashes alone; a second one sends the places of those
that occur more than once.  The first occurrence by id and place stays; the lines that
later occurrences cover, overlaps merged, are removed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilgrid.llm.bits import bitmap, maybe
from perilgrid.llm.words import blocks, mix, text_bytes, word_hashes
from perilgrid.session import cut_lineage, release

WINDOW = 3
_CUT_AFTER = 8
_CONTEXT = 3
_BLOCK = 2 << 20
_DONE = ["_id", "text", "_rest", "n_lines", "n_removed"]
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_K = np.uint64(0xA24BAED4963EE407)
_PLACE = np.uint64((1 << 20) - 1)


def _content_cuts(words: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words after which a line ends by its content; ``first`` marks the first words of physical lines."""
    n, line = len(words), np.cumsum(first)
    value = words
    for d in range(1, _CONTEXT):
        earlier = np.zeros(n, np.uint64)
        earlier[d:] = np.where(line[d:] == line[:-d], words[:-d], np.uint64(0))
        value = value * _K + earlier
    value = mix(value)
    value[ends] = 0
    cut = np.zeros(n, bool)
    cut[ends] = True
    wide = n - _CUT_AFTER + 1
    if wide > 0:
        # the place goes into the lowest bits, so that the last of equal values is the least
        place = np.arange(n, dtype=np.uint64)
        least = (value & ~_PLACE) | (~place & _PLACE)
        for step in (1, 2, 4):  # over two, four and eight words
            least = np.minimum(least[:-step], least[step:])
        whole = np.flatnonzero(line[:wide] == line[_CUT_AFTER - 1 :])
        cut[whole + ((~least[whole] - whole.astype(np.uint64)) & _PLACE).astype(np.int64)] = True
    return np.flatnonzero(cut)


def lines_of(texts: pa.Array):
    """Hashes of the lines of a column, byte position where each starts, lines before each text, text bounds."""
    data, bounds = text_bytes(texts)
    words, before, starts, stops, bounds = word_hashes(texts, spans=True)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64), bounds
    breaks = np.flatnonzero((data == 0x0A) | (data == 0x0D))
    newline = np.searchsorted(breaks, starts)
    first = np.ones(n, bool)
    first[1:] = newline[1:] != newline[:-1]
    first[before[:-1][before[:-1] < n]] = True  # each text starts a line
    after = _content_cuts(words, first, np.flatnonzero(_ENDS[data[stops - 1]])) + 1
    first[after[after < n]] = True
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, n))
    place = (np.arange(n) - np.repeat(at, length)).astype(np.uint64)
    # order within the line matters: each word is mixed with its place before adding up
    hashes = mix(np.add.reduceat(mix(words + place * _K), at) ^ length.astype(np.uint64))
    return hashes, starts[at], np.searchsorted(at, before), bounds


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window of a column, the text it is in, its first line there; and the lines of each text."""
    h, _, before, _ = lines_of(texts)
    lines = np.diff(before)
    count = np.maximum(lines - WINDOW + 1, 0)
    rows = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    at = before[rows] + pos
    w = mix(mix(h[at] * _K + h[at + 1]) * _K + h[at + 2]) if len(at) else np.zeros(0, np.uint64)
    return w, rows, pos, lines


def _repeated(source: DataFrame) -> DataFrame:
    """``window``: the hashes that occur more than once."""

    def build(batches):
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK):
                w, n = np.unique(_windows(part.column(0))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["window", "n"])

    seen = source.select("text").mapInArrow(build, "window bigint, n bigint").groupBy("window").agg(F.sum("n").alias("n"))
    return cut_lineage(seen.filter("n > 1").select("window"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("_id"), row.alias("_row"), F.col(text_col).alias("text"))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_row``, ``n_lines``, ``starts``: of each text its lines, and the first lines of its later windows."""
    source = _source(docs, id_col, text_col)
    kind = source.schema["_id"].dataType.simpleString()
    repeated = _repeated(source)
    bits = min(28, max(16, math.ceil(math.log2(16 * repeated.count() + 1))))
    known = docs.sparkSession.sparkContext.broadcast(bitmap(repeated, "window", bits))

    def build(batches):
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK):
                w, rows, pos, lines = _windows(part.column(2))
                some = maybe(known.value, w)
                take = pa.array(rows[some], pa.int64())
                cols = [part.column(0).take(take), part.column(1).take(take), pa.array(w[some].view(np.int64)), pa.array(pos[some], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "_row", "window", "pos"])
                # and a row without a window for the number of lines
                cols = [part.column(0), part.column(1), pa.nulls(part.num_rows, pa.int64()), pa.array(lines, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "_row", "window", "pos"])

    found = cut_lineage(source.mapInArrow(build, f"_id {kind}, _row bigint, window bigint, pos int"))
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("pos").alias("pos"))
    first = found.filter("window is not null").groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    # one passage may stand in a third of all texts: adaptive execution splits the larger side
    later = found.join(first.select("window", "first"), "window").filter(~place.eqNullSafe(F.col("first")))
    sizes = found.filter("window is null").select("_id", "_row", F.col("pos").alias("n_lines"), F.lit(None).cast("int").alias("pos"))
    both = sizes.union(later.select("_id", "_row", F.lit(None).cast("int").alias("n_lines"), "pos"))
    cuts = cut_lineage(both.groupBy("_id", "_row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("starts")))
    release(repeated, found)
    return cuts


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the repeated lines, and ``n_lines`` and ``n_removed`` counted on the way.

    What stays is byte for byte as it was; a removed line takes the white space
    up to the next line with it.  Texts with fewer than three lines have no
    windows and stay whole.  A null text stays null, with no lines.  Rows with
    the same id and text count as one document, so they get the same result; a
    null id sorts after all others.  Other columns are kept, but for those
    named ``n_lines`` or ``n_removed``, which are replaced.  An empty table
    gives no rows.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_removed")]
    source = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_row"),
        F.col(text_col).alias("text"),
        F.struct(F.lit(True).alias("_"), *[F.col(c) for c in others]).alias("_rest"),
    )
    cuts = later_windows(docs, id_col, text_col)
    same = source["_id"].eqNullSafe(cuts["_id"]) & (source["_row"] == cuts["_row"])
    joined = source.join(cuts, same, "left").select(source["_id"], source["text"], "starts", "_rest", "n_lines")

    def remove(batches):
        for batch in batches:
            some = pa.compute.greater(pa.compute.list_value_length(batch.column(2)), 0)
            rest = batch.filter(pa.compute.invert(some))
            none = pa.array(np.zeros(rest.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), rest.column(3), rest.column(4), none], _DONE)
            for part in blocks(batch.filter(some), "text", _BLOCK):
                texts = part.column(1)
                data, _ = text_bytes(texts)
                _, starts, before, bounds = lines_of(texts)
                out, gone = [], []
                for i, cut in enumerate(part.column(2)):
                    drop = np.zeros(int(before[i + 1] - before[i]), bool)
                    drop[(np.asarray(cut.as_py())[:, None] + np.arange(WINDOW)).ravel()] = True
                    gone.append(int(drop.sum()))
                    edges = np.concatenate(([bounds[i]], starts[before[i] + 1 : before[i + 1]], [bounds[i + 1]]))
                    out.append(b"".join(data[edges[k] : edges[k + 1]].tobytes() for k in np.flatnonzero(~drop)).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), part.column(3), part.column(4), pa.array(gone, pa.int32())], _DONE)

    schema = joined.select("_id", "text", "_rest").schema.add("n_lines", "integer").add("n_removed", "integer")
    done = joined.mapInArrow(remove, schema)
    kept = {id_col: F.col("_id"), text_col: F.col("text")}
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return done.select(*[kept.get(c, F.col("_rest").getField(c)).alias(c) for c in order], "n_lines", "n_removed")
