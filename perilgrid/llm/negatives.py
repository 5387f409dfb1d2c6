"""Hard negatives for contrastive training, by threshold joins over an inverted index.

Rows are packed into chunks; each chunk is an index of its own.  Its dimensions are
ordered by their weight in the chunk, and a row is entered under its leading dimensions
only: the trailing ones are left out as soon as their norm is a small share of the
row's.  For a block of anchors the scores are added up over what is indexed.  What is
missing is at most the product of both remaining norms, so every pair has an upper
bound, and only pairs whose bound reaches the threshold are finished exactly.  An
anchor's threshold starts high and is lowered until its windows are full or the
window's own limit is reached; later chunks start from what earlier ones have found.

The anchors are a stated query set: every block of them meets every chunk once, and each
task sends only the best few rows of each window on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilgrid.session import cut_lineage

_CHUNK, _QUERIES, _CHUNKS_A_TASK = 4096, 256, 32
#: Dimensions are left out of the index once they hold at most this share of a row's norm.
_REST = 0.35
_START, _LOWER, _LEAST = 0.9, 0.85, 0.05
_NONE = np.iinfo(np.int64).max
_EXACT = 2.0**26
_ROWS = "chunk bigint, ids binary, labels binary, dims int, width int, vectors binary"
_ANCHORS = "part bigint, keys binary, ids binary, labels binary, tops binary, dims int, width int, vectors binary"
_FOUND = "key bigint, place int, id bigint, score bigint"


# --- packing ----------------------------------------------------------------------


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of whole numbers, short ones filled up with zeros, and which rows take part."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, valid = len(lists), np.asarray(lists.is_valid())
    length = np.where(valid, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    dims = int(length.max(initial=0))
    out = np.zeros((n, dims))
    row = np.repeat(np.arange(n), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    out[row, at] = values
    with np.errstate(over="ignore", invalid="ignore"):
        fits = np.isfinite(out).all(1) & ((out * out).sum(1) < 2.0**62)
    keep = valid & fits
    return np.where(keep[:, None], out, 0.0).astype(np.int64), keep


def _packed(values: np.ndarray) -> tuple[int, int, bytes]:
    most = int(np.abs(values).max(initial=0))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    return values.shape[1], np.dtype(kind).itemsize, values.astype(kind).tobytes()


def _unpacked(dims: int, width: int, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(rows, dims).astype(np.int64)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _chunks(rows: DataFrame) -> DataFrame:
    """``rows`` (``id``, ``label``, ``vector``) packed into chunks; unusable rows are left out."""

    def pack(batches):
        from pyspark import TaskContext

        held, size, made = [], 0, TaskContext.get().partitionId() << 32

        def out(many):
            nonlocal made
            ids, labels = (np.concatenate([h[k] for h in many]) for k in (0, 1))
            dims = max(h[2].shape[1] for h in many)
            values = np.concatenate([np.pad(h[2], ((0, 0), (0, dims - h[2].shape[1]))) for h in many])
            for a in range(0, len(ids), _CHUNK):
                d, w, data = _packed(values[a : a + _CHUNK])
                made += 1
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": made, "ids": ids[a : a + _CHUNK].tobytes(), "labels": labels[a : a + _CHUNK].tobytes(), "dims": d, "width": w, "vectors": data}],
                    pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("dims", pa.int32()), ("width", pa.int32()), ("vectors", pa.binary())]),
                )

        for batch in batches:
            values, keep = _matrix(batch.column(2))
            ids = batch.column(0).fill_null(_NONE).to_numpy()
            held.append((ids[keep], batch.column(1).to_numpy()[keep], values[keep]))
            size += int(keep.sum())
            if size >= _CHUNK:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)

    return rows.select("id", "label", "vector").mapInArrow(pack, _ROWS)


def _blocks(anchors: DataFrame, groups: int) -> DataFrame:
    """Anchors (``key``, ``id``, ``label``, ``vector`` and the scores ``tops``) in blocks, a copy of each for every group."""

    def pack(batches):
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, _QUERIES):
                part = batch.slice(a, _QUERIES)
                values, keep = _matrix(part.column(3))
                if not keep.any():
                    continue
                tops = np.full((part.num_rows, 1 + max([0, *[len(t) for t in part.column(4).to_pylist()]])), _NONE, np.int64)
                for i, t in enumerate(part.column(4).to_pylist()):
                    tops[i, : len(t)] = t
                d, w, data = _packed(values[keep])
                longs = [part.column(k).to_numpy()[keep].tobytes() for k in range(3)]
                made += 1
                yield pa.RecordBatch.from_pylist(
                    [{"part": made, "keys": longs[0], "ids": longs[1], "labels": longs[2], "tops": tops[keep].tobytes(), "dims": d, "width": w, "vectors": data}],
                    pa.schema([("part", pa.int64()), *[(c, pa.binary()) for c in ("keys", "ids", "labels", "tops")], ("dims", pa.int32()), ("width", pa.int32()), ("vectors", pa.binary())]),
                )

    blocks = anchors.select("key", "id", "label", "vector", "tops").mapInArrow(pack, _ANCHORS)
    return blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "group")


# --- index ------------------------------------------------------------------------


class _Index:
    """A chunk's rows under their leading dimensions, longest first, so that a posting list is a run of rows."""

    def __init__(self, ids, labels, values):
        energy = (values.astype(np.float64) ** 2).sum(0)
        self.order = np.argsort(-energy, kind="stable")
        x = values[:, self.order].astype(np.float64)
        left = np.cumsum((x * x)[:, ::-1], 1)[:, ::-1]  # squared norm from each dimension on
        left = np.concatenate((left, np.zeros((len(x), 1))), 1)
        depth = (left > (_REST**2) * left[:, :1]).sum(1)
        by = np.argsort(-depth, kind="stable")
        self.ids, self.labels, self.values, self.depth = ids[by], labels[by], values[by], depth[by]
        x, left = x[by], left[by]
        self.most = float(np.sqrt(left[:, 0].max(initial=0.0)))
        self.rest = np.sqrt(left[np.arange(len(x)), self.depth])
        self.postings = [(j, int((self.depth > j).sum())) for j in range(0, x.shape[1], 8)]
        self.indexed = np.where(np.arange(x.shape[1]) < self.depth[:, None], x, 0.0)
        self.plain = self.values.astype(np.float64) if self.most < _EXACT else None

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For every query and row the most that their score can be."""
        d = len(self.order)
        q = np.zeros((len(queries), d))
        w = min(d, queries.shape[1])
        q[:, :w] = queries[:, :w]
        q = q[:, self.order]
        left = np.concatenate((np.cumsum((q * q)[:, ::-1], 1)[:, ::-1], np.zeros((len(q), 1))), 1)
        total = np.sqrt(left)[:, self.depth] * self.rest
        for j, n in self.postings:
            if n:
                total[:, :n] += q[:, j : j + 8] @ self.indexed[:n, j : j + 8].T
        return total * (1 + 1e-9) + 1.0  # sums of rounded numbers

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        w = min(self.values.shape[1], len(query))
        if self.plain is not None and np.abs(query).max(initial=0) < _EXACT and float(query.astype(np.float64) @ query) < _EXACT**2:
            return (self.plain[rows, :w] @ query[:w].astype(np.float64)).astype(np.int64)
        return self.values[rows, :w] @ query[:w]


class _Window:
    """The best rows with a score from ``low`` to ``high``, ties by id; an id counts once per score."""

    def __init__(self, size: int, low: float, high: float):
        self.size, self.low, self.high = size, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        if not inside.any():
            return
        s, i = np.append(self.scores, scores[inside]), np.append(self.ids, ids[inside])
        by = np.lexsort((i, -s))
        s, i = s[by], i[by]
        new = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))
        self.scores, self.ids = s[new][: self.size], i[new][: self.size]

    def needs(self) -> float:
        """Rows below this score are of no use."""
        return float(self.scores[-1]) if len(self.scores) == self.size else self.low


def _fill(windows: list[_Window], bounds: np.ndarray, rows: np.ndarray, index: _Index, query: np.ndarray, start: float) -> None:
    """Lowers the threshold until every window is full or at its own limit."""
    bounds = bounds[rows]
    need = min(w.needs() for w in windows)
    full = all(len(w.scores) == w.size for w in windows)
    level, above = need if full else max(need, start), np.inf
    while True:
        take = rows[(bounds >= level) & (bounds < above)]
        if len(take):
            scores = index.scores(take, query)
            for w in windows:
                w.add(scores, index.ids[take])
        need = min(w.needs() for w in windows)
        if level <= need:
            return
        above, level = level, max(need, level * _LOWER if level > _LEAST * start else -np.inf)


def _join(chunks: DataFrame, blocks: DataFrame, groups: int, size: int, low: int, negatives: bool) -> DataFrame:
    """``key``, ``place`` of the window, ``id``, ``score``: the best rows of each window in each task.

    Without ``negatives`` there is one window per anchor, for rows of its label; with
    it one per entry of ``tops``, for rows of other labels, down to ``low`` percent.
    """

    def search(batches):
        index, windows, current = {}, [], None

        def found(block, windows):
            rows = [(k, p, int(i), int(s)) for k, ws in zip(block, windows) for p, w in enumerate(ws) for i, s in zip(w.ids, w.scores)]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], [], []), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "place", "id", "score"])

        keys = None
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                if r["chunk"] not in index:
                    if len(index) >= 2 * _CHUNKS_A_TASK:
                        index.clear()
                    of = _longs(r["r_ids"])
                    index[r["chunk"]] = _Index(of, _longs(r["r_labels"]), _unpacked(r["r_dims"], r["r_width"], r["r_vectors"], len(of)))
                at = index[r["chunk"]]
                if r["part"] != current:
                    if current is not None:
                        yield from found(keys, windows)
                    current, keys = r["part"], _longs(r["keys"]).tolist()
                    ids, labels = _longs(r["ids"]), _longs(r["labels"])
                    queries = _unpacked(r["dims"], r["width"], r["vectors"], len(ids))
                    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
                    tops = _longs(r["tops"]).reshape(len(ids), -1)
                    if negatives:
                        windows = [[_Window(size, -(-low * int(t) // 100), int(t)) for t in ts[ts != _NONE]] for ts in tops]
                    else:
                        windows = [[_Window(size, -np.inf, np.inf)] for _ in ids]
                bounds = at.bounds(queries)
                for q in range(len(ids)):
                    mine = windows[q]
                    if not mine:
                        continue
                    same = at.labels == labels[q]
                    rows = np.flatnonzero((~same if negatives else same) & (at.ids != ids[q]))
                    if len(rows):
                        start = max(w.high for w in mine) if negatives else _START * norms[q] * at.most
                        _fill(mine, bounds[q], rows, at, queries[q], float(start))
        if current is not None:
            yield from found(keys, windows)

    side = chunks.select(
        "chunk", *[F.col(c).alias(f"r_{c}") for c in ("ids", "labels", "dims", "width", "vectors")], F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("group")
    ).repartition(groups, "group")
    return blocks.join(side, "group").drop("group").mapInArrow(search, _FOUND)


def _best(found: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows of each window over all tasks, numbered from 1."""
    once = found.distinct()
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Vectors hold whole numbers and scores are their inner products.  The rows for
    which ``anchor`` holds are the anchors.  An anchor's positives are the best
    ``n_positives`` rows of its label; for each of them the best ``n_negatives`` rows of
    other labels with a score from ``low`` percent of the positive's up to the
    positive's own are returned, ties by smaller id.  An anchor without positives, or
    a positive without such rows, gives no row; so does a positive with a score
    below zero, whose window is empty.

    Rows with a null label, a null vector, or a component that is null or not finite take no
    part, nor do vectors whose squared norm passes 2**62, as scores would not fit.
    Vectors of different lengths are compared as if the short one ended in zeros; an
    empty vector scores 0 with all.  Rows that share an id with the anchor are the anchor
    itself.  Rows that repeat an id count once per score, and an anchor that repeats its
    id, label and vector once.  A null id is never an anchor, comes after all others in
    ties and is returned as null.  An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    clean = rows.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(label_col)).alias("label"), vector.alias("vector"), anchor.alias("anchor")
    )
    clean = clean.filter(~F.exists("vector", lambda x: x.isNull()))
    chunks = cut_lineage(_chunks(clean))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // _CHUNKS_A_TASK))
    anchors = clean.filter("anchor and id is not null").withColumn("key", F.xxhash64("id", "label", "vector")).drop("anchor").dropDuplicates(["key"])
    anchors = cut_lineage(anchors)
    none = F.array().cast("array<bigint>")
    near = _join(chunks, _blocks(anchors.withColumn("tops", none), groups), groups, n_positives, low, False)
    positives = cut_lineage(_best(near, n_positives))
    tops = positives.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("tops"))
    met = _join(chunks, _blocks(anchors.join(tops, "key"), groups), groups, n_negatives, low, True)
    best = _best(met, n_negatives).select("key", (F.col("place") + 1).alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select(
        "key", "anchor_id", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    null = lambda c: F.when(F.col(c) != _NONE, F.col(c)).alias(c)
    return named.join(best, ["key", "p"]).select("anchor_id", null("positive_id"), "rank", null("negative_id"), "positive_score", "negative_score")
