import math
import random

from perilgrid.llm.language_model import score_texts
from perilgrid.llm.queries import QUERIES
from test_language_model import brute


def same(got, rows):
    got = sorted(((str(r.doc_id), *tuple(r)[1:]) for r in got), key=str)
    want = brute(rows, 10**9)  # every word is kept
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert math.isclose(g[6], w[6], abs_tol=1e-6 + w[2] / 4000)
    return want


def test_the_list_of_frequent_words_does_not_change_scores(spark):
    rng = random.Random(8)
    words = [f"w{i}é" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words[: rng.choice([5, 60, 300])], k=rng.choice([0, 1, 30, 200])))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "unseen words w1é w2é"), (None, "w1é w299é"), (3, rows[3][1]), (1003, "w250é w251é " * 2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for vocabulary in (1, 20, 65_000):
        want = same(score_texts(df, vocabulary=vocabulary, all_pairs=True).collect(), rows)
    capped = {str(r.doc_id): r.score for r in score_texts(df, vocabulary=20).collect()}
    assert any(abs(capped[w[0]] - w[6]) > 1 for w in want)
    assert score_texts(df.filter("doc_id < 0"), all_pairs=True).count() == 0


def test_query_learns_pairs_of_all_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    same(QUERIES["op9_language_model"](spark, "/root/testdata/sf0.01").collect(), [(r.doc_id, r.text) for r in docs.collect()])
