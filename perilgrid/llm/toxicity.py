"""Toxicity by a linear classifier over character n-grams.

Features are the n-grams (``ORDERS`` bytes of the UTF-8 text, A-Z lower-cased,
every other ASCII byte but letters and digits read as a blank) that a text
contains at least once, scaled by their naive Bayes log-count ratio; a logistic
regression with a ridge penalty weighs them.

Counting, selecting and scoring are Spark jobs.  The regression itself runs on the
driver, over at most ``fit_rows`` labelled texts (those with the smallest hash of
the id) and ``features`` n-grams, which bounds what it needs whatever the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.llm.words import blocks, mix, text_bytes, with_text
from perilgrid.session import cut_lineage

ORDERS = (3, 4, 5, 6)
_BUCKET_BITS = 20
_U = np.uint64
_FOLD = _U(0x9FB21C651E98DF25)
_CODES = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64)
_CLASS = np.arange(256)
_CLASS[0x41:0x5B] += 0x20
_CLASS[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
_CODES = _CODES[_CLASS]


def gram_hashes(texts: pa.Array):
    """Yields one list of hash arrays per text, an array for each order, with repeats.

    A blank is put before and after each text; blanks in a row count singly each.
    """
    data, bounds = text_bytes(texts)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        blank = _CODES[0x20:0x21]
        codes = np.concatenate((blank, _CODES[data[a:b]], blank))
        h, out = codes, []
        for n in range(2, ORDERS[-1] + 1):
            if len(codes) < n:
                break
            h = h[:-1] * _FOLD + codes[n - 1 :]
            if n in ORDERS:
                out.append(mix(h ^ _U(n)))
        yield out


def _held_out(id_col: Column, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, fit_rows: int) -> DataFrame:
    """``text``, ``y`` of the labelled texts to fit on, and a random ``part``."""
    marked = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("_id").isNotNull() & F.col("y").isNotNull() & ~_held_out(F.col("_id"), folds))
        .groupBy("_id")
        .agg(F.max("y").alias("y"))
    )
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return cut_lineage(texts.join(F.broadcast(chosen), "_id").select("_id", "text", "y"))


def _bucket_counts(sample: DataFrame) -> DataFrame:
    """Texts of each label that hold a hash bucket: ``b``, ``pos``, ``neg``."""

    def count(batches):
        totals = np.zeros((2, 1 << _BUCKET_BITS), np.int32)
        for batch in batches:
            labels = batch.column(2).to_pylist()
            at = 0
            for part in blocks(batch, "text"):
                for grams in gram_hashes(part.column(1)):
                    if grams:
                        held = np.zeros(1 << _BUCKET_BITS, bool)
                        for g in grams:
                            held[g >> _U(64 - _BUCKET_BITS)] = True
                        totals[1 if labels[at] > 0 else 0] += held
                    at += 1
        seen = np.flatnonzero(totals.sum(axis=0) > 0)
        for a in range(0, len(seen), 50_000):
            b = seen[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(totals[1, b]), pa.array(totals[0, b])], ["b", "pos", "neg"])

    return sample.mapInArrow(count, "b int, pos int, neg int").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _telling(counts: DataFrame, n_pos: int, n_neg: int, keep: int) -> DataFrame:
    """The ``keep`` rows whose share differs most between the labels, in standard errors."""
    p, q, both = F.col("pos") / n_pos, F.col("neg") / n_neg, (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    spread = F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_neg))
    z = F.when(spread > 0, F.abs(p - q) / spread).otherwise(0.0)
    return counts.withColumn("_z", z).filter("pos + neg > 1").orderBy(F.desc("_z"), *[c for c in counts.columns if c in ("b", "g")]).limit(keep).drop("_z")


def _grams_in(sample: DataFrame, buckets: np.ndarray) -> DataFrame:
    """``g``, ``pos``, ``neg``: texts of each label that hold each n-gram of the chosen buckets."""
    chosen = np.zeros(1 << _BUCKET_BITS, bool)
    chosen[buckets] = True

    def count(batches):
        for batch in batches:
            labels = batch.column(2).to_pylist()
            at = 0
            for part in blocks(batch, "text"):
                grams, marks = [], []
                for found in gram_hashes(part.column(1)):
                    if found:
                        all_grams = np.concatenate(found)
                        kept = np.unique(all_grams[chosen[all_grams >> _U(64 - _BUCKET_BITS)]])
                        grams.append(kept)
                        marks.append(np.full(len(kept), labels[at] > 0))
                    at += 1
                if grams:
                    pos = np.concatenate(marks)
                    g = np.concatenate(grams).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(pos.astype(np.int32)), pa.array((~pos).astype(np.int32))], ["g", "pos", "neg"])

    rows = sample.mapInArrow(count, "g bigint, pos int, neg int")
    return rows.groupBy("g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class Model:
    """N-gram weights: a sorted array of hashes, their weights, and the bias."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, bias: float):
        self.grams, self.weights, self.bias = grams, weights, bias
        self.maybe = np.zeros(1 << _BUCKET_BITS, bool)
        self.maybe[grams >> _U(64 - _BUCKET_BITS)] = True

    def features(self, found: list[np.ndarray]) -> np.ndarray:
        """Indices of the model's n-grams that a text holds."""
        if not found or not len(self.grams):
            return np.zeros(0, np.int64)
        near = np.concatenate([g[self.maybe[g >> _U(64 - _BUCKET_BITS)]] for g in found])
        at = np.minimum(np.searchsorted(self.grams, near), len(self.grams) - 1)
        return np.unique(at[self.grams[at] == near])

    def score(self, found: list[np.ndarray]) -> float:
        x = self.bias + float(self.weights[self.features(found)].sum())
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def _regress(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float, steps: int):
    """Ridge-penalised logistic regression on 0/1 features times ``scale``, by accelerated gradient steps."""
    n, values = len(y), scale[cols]
    forward = lambda w: np.bincount(rows, values * w[cols], n)
    backward = lambda e: np.bincount(cols, values * e[rows], len(scale))
    v = np.ones(len(scale))
    for _ in range(20):
        v = backward(forward(v / max(np.linalg.norm(v), 1e-12)))
    step = 1 / (np.linalg.norm(v) / 4 / n + 0.25 + ridge)
    w = u = np.zeros(len(scale))
    b = c = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for k in range(steps):
        e = 1 / (1 + np.exp(-np.clip(forward(u) + c, -500, 500))) - y
        w2, b2 = u - step * (backward(e) / n + ridge * u), c - step * e.mean()
        m = k / (k + 3)
        u, c, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    fit_rows: int = 20_000,
    features: int = 4096,
    ridge: float = 1e-4,
    steps: int = 150,
) -> Model:
    """Fits on labelled texts whose id is not held out (crc32 of the id as text, modulo ``folds``, is 0).

    Rows with a null id or label teach nothing; an id labelled more than once
    counts as toxic if any of its labels does.  With one label only, or none,
    the model has no n-grams and scores every text the same.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col, folds, fit_rows)
    sizes = sample.agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") <= 0).alias("n")).first()
    none = np.zeros(0, np.uint64)
    if not sizes.p or not sizes.n:
        return Model(none, np.zeros(0), math.log((sizes.p + 0.5) / (sizes.n + 1.5)))
    buckets = _telling(_bucket_counts(sample), sizes.p, sizes.n, features).toArrow()["b"].to_numpy()
    table = _telling(_grams_in(sample, buckets), sizes.p, sizes.n, features).toArrow()
    if not table.num_rows:
        return Model(none, np.zeros(0), math.log((sizes.p + 0.5) / (sizes.n + 1.5)))
    grams = table["g"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    grams, pos, neg = grams[order], table["pos"].to_numpy()[order] + 1.0, table["neg"].to_numpy()[order] + 1.0
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    index = Model(grams, np.zeros(len(grams)), 0.0)

    def active(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                rows = [index.features(f).astype(np.int32) for f in gram_hashes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(rows, pa.list_(pa.int32()))], ["y", "on"])

    held = sample.mapInArrow(active, "y int, on array<int>").toArrow().combine_chunks()
    lists = held["on"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    cols = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(held.num_rows), lists.value_lengths().to_numpy())
    y = (held["y"].to_numpy() > 0).astype(float)
    weights, bias = _regress(rows, cols, ratio, y, ridge, steps)
    return Model(grams, weights * ratio, bias)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, score_col: str = "score") -> DataFrame:
    """The rows of ``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from a score of 0.5).

    Null and empty texts get the score of a text without n-grams.  A row with a
    null id is not held out.  Repeated rows are scored each.  Columns of these
    three names are replaced, other columns kept.
    """
    names = ("held_out", score_col, "predicted")
    others = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*others).alias("_row")
    once = text_col in others  # a batch then holds its texts once
    source = docs.select(row) if once else docs.select(row, F.col(text_col).alias("text"))

    def judge(batches):
        for batch in batches:
            for part in blocks(with_text(batch, text_col) if once else batch, "text"):
                scores = [shared.value.score(f) for f in gram_hashes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["_row", "s"])

    scored = source.mapInArrow(judge, source.select("_row").schema.add("s", "double"))
    return scored.select(
        *[F.col("_row").getField(c).alias(c) for c in others],
        _held_out(F.col("_row").getField(id_col), folds).alias("held_out"),
        F.col("s").alias(score_col),
        (F.col("s") >= 0.5).cast("int").alias("predicted"),
    )
