import random
import re
import zlib

import numpy as np
import pyarrow as pa

from perilgrid.llm.toxicity import ORDERS, gram_hashes, score_toxicity, train


def test_grams_of_a_text():
    texts = ["Ab, é", "ab  É".replace("É", "é"), "", None]
    a, b, c, d = gram_hashes(pa.array(texts))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))
    assert [len(x) for x in a] == [len(" ab  é ".encode()) - n + 1 for n in ORDERS]
    assert c == d == []
    assert len(np.unique(np.concatenate(a))) == sum(len(x) for x in a)


def corpus(n=600):
    rng = random.Random(1)
    syllables = ["ba", "ko", "li", "té", "mu", "ran", "sol", "vi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([5, 40, 400]))]
        toxic = i % 8 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), "Grumph" + rng.choice(syllables))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(9001, None, None), (9002, "", ""), (None, "ba Grumphko ba", ""), (0, rows[0][1], "again")], "doc_id bigint, text string, predicted string")
    # held-out labels are all wrong: they must not be learnt from
    wrong = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows]
    labels = spark.createDataFrame([*wrong, (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = score_toxicity(docs, train(docs, labels, features=512)).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([by[i].predicted == y for i, y in truth.items() if by[i].held_out]) > 0.98
    assert by[None].predicted == 1 and by[None].held_out is False
    assert by[9001].score == by[9002].score < 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_missing(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id bigint, text string")
    for labels in ([], [(1, 0)], [(1, 1)]):
        table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
        assert len({r.score for r in score_toxicity(docs, train(docs, table)).collect()}) == 1
    assert score_toxicity(docs.limit(0), train(docs, table)).count() == 0


def test_real_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = score_toxicity(docs, train(docs, labels)).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got if r.held_out]) > 0.9
