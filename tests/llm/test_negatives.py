import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilgrid.llm.negatives import _Index, hard_negatives


def brute(rows, low=80, n=5):
    """rows: (id, label, vector of whole numbers), ids distinct."""
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        dot = lambda v: sum(x * y for x, y in zip(va, v))
        scored = sorted(((-dot(v), i, lab) for i, lab, v in rows if i != a))
        positives = [(i, -s) for s, i, lab in scored if lab == la][:n]
        for p, ps in positives:
            window = [(i, -s) for s, i, lab in scored if lab != la and low * ps <= -100 * s <= 100 * ps][:n]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(window)]
    return sorted(out)


def run(spark, rows, schema="vec_id bigint, embedding array<double>, label int"):
    df = spark.createDataFrame(rows, schema)
    got = hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 40) for _ in range(24)] for _ in range(4)]
    rows = []
    for i in range(900):
        c = centres[rng.randrange(4)]
        v = [math.floor(x + rng.gauss(0, 30)) for x in c]
        rows.append((i, rng.randrange(5), v if i % 7 else list(centres[0]) and [math.floor(x) for x in centres[0]]))
    got = run(spark, [(i, [float(x) for x in v], lab) for i, lab, v in rows])
    assert got == brute(rows) and got


def test_few_rows_ties_and_negative_scores(spark):
    rows = [(0, 1, [3, 0]), (1, 1, [-2, 5]), (2, 2, [3, 1]), (3, 2, [3, 9]), (100, 2, [0, 0]), (101, 2, [1, 1]), (102, 1, [4, 4]), (200, 3, [5, 5])]
    assert run(spark, [(i, [float(x) for x in v], lab) for i, lab, v in rows]) == brute(rows)


def test_nulls_lengths_repeats_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (5, [1.0], 1), (5, [1.0], 1), (6, [1.0, None], 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, None, 2), (10, [9.0, 9.0], None)]
    rows += [(11, [], 2), (12, [1.0, 0.0, 7.0], 2), (12, [1.0, 0.0, 7.0], 2), (None, [1.0, 0.0], 2), (300, [], 1), (None, [0.0], 1), (13, [1e300, 1.0], 2)]
    got = run(spark, rows)
    assert [r for r in got if r[0] == 0] and all(r[:1] == (0,) or r[0] == 300 for r in got)
    # the best positive of 0 is 5 (score 1); 12 and the row without id score 1 as well
    assert [(r[2], r[3], r[5]) for r in got if r[:2] == (0, 5) and r[3] is not None] == [(1, 12, 1)]
    assert any(r[:2] == (0, 5) and r[3] is None and r[2] == 2 for r in run(spark, rows[:3] + rows[10:13] + [(None, [1.0, 0.0], 2)]))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert hard_negatives(df.filter("vec_id > 1000"), F.col("vec_id") % 100 == 0).count() == 0


def test_clashing_columns(spark):
    rows = [(0, [2.0], 1, 5, 6), (1, [2.0], 1, 5, 6), (2, [2.0], 2, 5, 6)]
    assert run(spark, rows, "vec_id bigint, embedding array<double>, label int, key int, chunk int") == [(0, 1, 1, 2, 4, 4)]


def test_bounds_hold():
    rng = np.random.Generator(np.random.PCG64(5))
    x = np.floor(rng.normal(0, 30, (500, 64))).astype(np.int64)
    index = _Index(np.arange(500), np.zeros(500, np.int64), x)
    q = x[:20]
    true = q @ index.values.T
    bounds = index.bounds(q.astype(np.float64))
    assert (bounds >= true).all() and np.median(bounds - true) < 0.2 * np.median(np.diag(q @ q.T))
    assert all((index.scores(np.arange(500), v) == t).all() for v, t in zip(q, true))
    assert index.depth.mean() < 64  # some dimensions are left out
