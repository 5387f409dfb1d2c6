import random

import numpy as np
import pyarrow as pa
import pytest

from brute import components, shingles
from perilgrid.llm import parity_join
from perilgrid.llm.bits import maybe
from perilgrid.llm.components import components as spark_components
from perilgrid.llm.parity_join import similar_texts
from perilgrid.llm.sketches import band_keys, folded, most_differences
from perilgrid.llm.words import shingle_sets


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    by_shingle = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    pairs = {(p, q) for ks in by_shingle.values() for p in ks for q in ks if p < q}
    links = [(sets[p][0], sets[q][0]) for p, q in pairs if similar(sets[p][1], sets[q][1])]
    return {i: (len(s), c) for (i, s), c in zip(sets, components([i for i, _ in sets], links).values())}


def variants(rng, n_groups=25):
    vocab = [f"w{i}" for i in range(2000)]
    docs, boiler = [], " ".join(rng.choices(vocab, k=40))
    for g in range(n_groups):
        base = rng.choices(vocab, k=rng.choice([1, 2, 4, 6, 9, 16, 19, 40, 70, 260, 900]))
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 20 + 1)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(3) or [w[k]]
            text = " ".join(w)
            docs.append(text if rng.random() < 0.6 else boiler + " " + text)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def test_similar_sets_share_a_key():
    rng = random.Random(3)
    none, every = np.zeros(4, np.uint64), np.full(4, 2**64 - 1, np.uint64)
    values = np.random.Generator(np.random.PCG64(1))
    for _ in range(1500):
        n = rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 40, 63, 64, 65, 250, 300])
        base = values.integers(0, 2**63, 2 * n, dtype=np.uint64)
        i = n - rng.randrange(n // 4 + 1)
        a, b = np.unique(base[:n]), np.unique(np.concatenate((base[:i], base[n : n + rng.randrange(n // 4 + 1)])))
        both = len(np.intersect1d(a, b))
        if 7 * both >= 3 * (len(a) + len(b)):
            hot = rng.choice([none, every])
            assert np.intersect1d(band_keys(a, hot), band_keys(b, hot)).size
            apart = len(a) + len(b) - 2 * both
            assert apart <= min(most_differences(len(a)), most_differences(len(b)))
            assert int(np.bitwise_count(folded(a) ^ folded(b)).sum()) <= apart


def test_similar_sets_share_two_keys():
    values = np.random.Generator(np.random.PCG64(7))
    for n in [1, 2, 3, 4, 7, 12, 15, 16, 60, 64, 65, 260, 1100] * 20:
        base = values.integers(0, 2**63, 2 * n, dtype=np.uint64)
        cut = int(values.integers(0, n // 4 + 1))
        a, b = np.unique(base[:n]), np.unique(base[cut : n + int(values.integers(0, cut + 1))])
        if 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b)):
            hot = [np.zeros(4, np.uint64), np.full(4, 2**64 - 1, np.uint64), values.integers(0, 2**63, 4, dtype=np.uint64)][n % 3]
            assert np.intersect1d(band_keys(a, hot), band_keys(b, hot)).size >= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    docs = variants(random.Random(seed))
    docs += [(5000, docs[3][1].upper()), (5001, None), (5002, ""), (5003, " \n"), (5004, "x " * 30_000), (5005, "X\t" * 30_000)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_texts(df).collect()}
    assert got == brute(docs)


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(50 - k, " ".join(words[3 * k : 3 * k + 40])) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_texts(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == brute(docs) and {c for _, c in got.values()} == {31}


def crowd(rng, n, far):
    """Changed copies of one text of 400 words; ``far`` of them too much changed to link with it, of which some are changed once more."""
    vocab = [f"w{i}" for i in range(2000)]
    base = rng.choices(vocab, k=400)

    def changed(words, times):
        words = list(words)
        for k in rng.sample(range(len(words)), times):
            words[k] = rng.choice(vocab) if rng.random() < 0.7 else words[k] + " " + rng.choice(vocab)
        return " ".join(words).split()

    out = [changed(base, rng.randrange(1, 9)) for _ in range(n - far)] + [changed(base, rng.randrange(16, 24)) for _ in range(far)]
    out += [changed(rng.choice(out[-far:]), rng.randrange(1, 11)) for _ in range(far // 4)]
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("crowded", [1, 8, 63])
def test_crowded_keys_lose_no_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(parity_join, "_CROWDED", crowded)
    rng = random.Random(crowded)
    docs = list(enumerate(crowd(rng, 150, 60) + [t for _, t in variants(rng, 10)]))
    rng.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_texts(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == brute(docs)


def test_crowded_keys_are_not_expanded_into_pairs(spark, monkeypatch):
    made, apart = [], parity_join._apart
    monkeypatch.setattr(parity_join, "_apart", lambda pairs, roots: made.append(pairs.count()) or apart(pairs, roots))
    texts = crowd(random.Random(5), 300, 150)
    similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert made[0] < 30 * len(texts)


def test_near_copies_have_one_leader(spark):
    has = {k: {n for n in range(20) if k not in (n, (n + 1) % 20)} for k in range(20)} | {k: set(range(30, 40)) for k in (50, 51)}
    rows = [(k, n, 200, n % 3, len(ns)) for k, ns in has.items() for n in ns]
    crowd = parity_join._crowds(spark.createDataFrame(rows, "key bigint, node bigint, n bigint, root bigint, many bigint")).collect()
    assert sorted((r.node, r.root) for r in crowd) == [(n, n % 3) for n in [*range(20), *range(30, 40)]]
    led = {a: {r.node for r in crowd if r.a == a} for a in {r.a for r in crowd}}
    assert all(any(ns <= nodes for nodes in led.values()) for ns in has.values())


def test_places_left_of_a_node_far_from_the_leader():
    rng = random.Random(4)
    tight = 0
    for _ in range(20_000):
        n = rng.choice([4, 12, 30])
        part = [rng.randrange(n // 4 + 1) for _ in range(7)]
        part[rng.randrange(7)] += n
        a, x, y = ({i for k in range(7) if (k + 1) >> which & 1 for i in range(100 * k, 100 * k + part[k])} for which in range(3))
        if a and similar(x, y) and not similar(x, a):
            both, outer = len((x ^ a) & (y ^ a)), 7 * len(x ^ a) - len(x) - len(a)
            assert 8 * both >= outer > 0 and 14 * both >= 7 * len(x ^ a) + 7 * len(y ^ a) - len(x) - len(y)
            assert 14 * both > 7 * len(y ^ a) - len(y) + len(a)
            tight += 1
    assert tight > 500


def test_nulls_repeats_and_empty(spark):
    t = "one two three four five six"
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (7, "other words"), (None, "alone here"), (None, None)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_texts(df).collect())
    assert got == [("7", 1, "7"), ("7", 2, "7"), ("7", 2, "7"), ("None", 0, "None"), ("None", 1, "None"), ("None", 2, "7")]
    assert similar_texts(df.filter("doc_id > 100")).count() == 0


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_texts(docs).collect()}
    assert got == brute(rows)
    assert sum(i != c for i, (_, c) in got.items()) > 30


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.node: r.root for r in spark_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 200: 100, 300: 100}


def test_bitmap_lets_members_through(spark):
    from perilgrid.llm.bits import bitmap

    h = next(iter(shingle_sets(pa.array(["a b c d e f g h i j k"]))))
    words = bitmap(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h bigint"), "h", 10)
    assert maybe(words, h).all() and int(np.bitwise_count(words).sum()) <= len(h)
