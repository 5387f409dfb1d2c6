import random
import re

import pyarrow as pa
import pytest

from perilgrid.llm.line_dedup import lines_of
from perilgrid.llm.queries import QUERIES

RNG = random.Random(11)
WORDS = [f"w{k}" for k in range(5000)]


def prose(n, sentence):
    out = RNG.choices(WORDS, k=n)
    return [w + "." if sentence and (i + 1) % sentence == 0 else w for i, w in enumerate(out)]


@pytest.mark.parametrize("sentence", [2, 6, 7, 8, 9, 13, 30, 0])
def test_a_passage_of_fifty_words_shares_a_window_at_every_offset(sentence):
    passage = prose(50, sentence)
    texts = [" ".join(passage)]
    for ahead in range(40):
        texts.append(" ".join([*prose(ahead, RNG.choice([0, 5, 11])), *passage, *prose(RNG.randrange(20), 0)]))
    hashes, _, before, _ = lines_of(pa.array(texts))
    windows = [{tuple(hashes[k : k + 3].tolist()) for k in range(a, b - 2)} for a, b in zip(before, before[1:])]
    assert all(windows[0] & w for w in windows[1:])


def test_cuts_as_stated():
    text = "one. two! " + " ".join(WORDS[:60]) + "\nthree four\n" + "same " * 20
    _, starts, before, _ = lines_of(pa.array([text]))
    edges = [*starts.tolist(), len(text)]
    lines = [re.findall(r"\S+", text[a:b]) for a, b in zip(edges, edges[1:])]
    assert sum(lines, []) == text.split() and lines[:2] == [["one."], ["two!"]] and ["three", "four"] in lines
    k = lines.index(["three", "four"])
    assert all(len(x) <= 8 for x in lines[3:k]) and 7 < len(lines[2:k]) < 40


@pytest.mark.parametrize("sentence", [6, 0])
def test_query_removes_the_passage_at_every_offset(spark, tmp_path, sentence):
    passage = prose(55, sentence)
    docs = [(0, " ".join(passage))] + [(k, " ".join([*prose(k, 0), *passage, *prose(5, 0)])) for k in range(1, 17)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert got[0].text == docs[0][1] and got[0].n_removed == 0
    assert all(got[k].n_removed >= 3 for k in range(1, 17))


def test_lines_do_not_depend_on_the_neighbours():
    texts = [" ".join(prose(n, RNG.choice([0, 3, 7, 12]))) for n in range(1, 61) for _ in range(3)] + ["", "a\nb c d e f g h i j k l m n o p"]
    alone = [tuple(lines_of(pa.array([t]))[0].tolist()) for t in texts]
    for size in (2, 3, 7, len(texts)):
        for a in range(0, len(texts), size):
            hashes, _, before, _ = lines_of(pa.array(texts[a : a + size]))
            assert [tuple(hashes[p:q].tolist()) for p, q in zip(before, before[1:])] == alone[a : a + size]
            sliced = lines_of(pa.array(texts).slice(a, size))
            assert sliced[0].tolist() == hashes.tolist()
