import math
import random
import zlib
from collections import Counter

import numpy as np

from brute import words
from perilgrid.llm.elias_fano import EliasFano, PairTrie, encode
from perilgrid.llm.language_model import score_texts


def test_elias_fano_reads_back():
    rng = np.random.Generator(np.random.PCG64(2))
    for n, top in ((1, 0), (1, 2**40), (7, 3), (1000, 10**6), (100_000, 2**60), (70_000, 70_000), (40_000, 5)):
        v = np.sort(rng.integers(0, top + 1, n, dtype=np.uint64))
        ef = EliasFano(encode(v))
        assert ef.n == n
        assert np.array_equal(np.concatenate([ef.values(a, a + (1 << 15)) for a in range(0, n, 1 << 15)]), v)
        q = np.sort(np.concatenate((rng.choice(v, 200), rng.integers(0, top + 2, 200, dtype=np.uint64))))
        assert np.array_equal(ef.successors(q), np.searchsorted(v, q, "left"))
        at = np.sort(rng.integers(0, n, 300))
        assert np.array_equal(ef.get(at), v[at])
        assert np.array_equal(ef.values(n // 2, n // 2 + 3), v[n // 2 : n // 2 + 3])
    assert EliasFano(encode(np.zeros(0, np.uint64))).n == 0
    # two bits and the low part per value
    v = np.arange(0, 2**30, 2**10, dtype=np.uint64)
    assert len(encode(v)) < len(v) * 1.7


def test_trie_lookup():
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(300), rng.randrange(50)) for _ in range(4000)})
    values = {p: rng.random() * 8 for p in pairs}
    trie = PairTrie(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array([values[p] for p in pairs]), 64, 1 / 4096)
    asked = sorted({(rng.randrange(320), rng.randrange(64)) for _ in range(5000)})
    got = trie.lookup(np.array([a[0] for a in asked]), np.array([a[1] for a in asked]))
    assert np.allclose(got, [values.get(a, 0.0) for a in asked], atol=1 / 8192)
    none = PairTrie(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 64, 1 / 4096)
    assert none.lookup(np.array([1]), np.array([2])).tolist() == [0.0]


END = object()


def brute(rows, vocabulary=65_000):
    texts = [[*words(t), END] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c, pairs = Counter(), Counter()
    for t, h in zip(texts, held):
        if not h:
            c.update(t)
    n, once = sum(c.values()), sum(x == 1 for x in c.values())
    unknown = min(max(once, 1), max(n // 2, 1)) / (n + 1)
    kept, room = set(), vocabulary
    levels = Counter(math.floor(math.log2(x) * 16) for x in c.values())
    for level in sorted(levels, reverse=True):
        if levels[level] > room:
            break
        room -= levels[level]
        kept |= {w for w, x in c.items() if math.floor(math.log2(x) * 16) == level}
    for t, h in zip(texts, held):
        if not h:
            pairs.update((a, b) for a, b in zip([END, *t], t) if a in kept and b in kept)
    share = lambda h: 0.1 + 0.5 * c[h] / (c[h] + 5000) if h in kept else 0.0
    single = lambda w: (1 - unknown) * c[w] / n if c[w] else unknown
    out = []
    for (i, _), t, hd in zip(rows, texts, held):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in t)
        score = sum(math.log10(share(h) * pairs[h, w] / max(c[h], 1) + (1 - share(h)) * single(w)) for h, w in zip([END, *t], t))
        out.append((str(i), hd, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return sorted(out, key=str)


def check(df, rows, **more):
    got = sorted(((str(r.doc_id), *tuple(r)[1:]) for r in score_texts(df, **more).collect()), key=str)
    want = brute(rows, **more)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert math.isclose(g[6], w[6], abs_tol=1e-6 + w[2] / 4000)


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}é" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocab[: rng.choice([5, 400])], k=rng.choice([0, 1, 30, 300])))) for i in range(120)]
    rows += [(1000 + i, rows[5][1].upper()) for i in range(5)] + [(2000, None), (2001, ""), (2002, " new  words\tonly "), (None, "w1é w2é"), (3, rows[3][1]), (2003, "w1é " * 40_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, batch string, doc int").repartition(3)
    check(df, rows)
    check(df, rows, vocabulary=20)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert score_texts(df).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(only, "held out words")]
    check(spark.createDataFrame(rows, "doc_id int, text string"), rows)


def test_real_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows)
    held = [r for r in score_texts(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in held)
