import random

import numpy as np
import pyarrow as pa
import pytest

from brute import components, shingles
from perilgrid.llm import bbit_minhash as B
from perilgrid.llm.words import shingle_sets


def brute(docs):
    sets = [(i, shingles(t, 4)) for i, t in docs]
    by_shingle = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    pairs = {(p, q) for ks in by_shingle.values() for p in ks for q in ks if p < q}
    links = [(sets[p][0], sets[q][0]) for p, q in pairs if 100 * len(sets[p][1] & sets[q][1]) >= 80 * len(sets[p][1] | sets[q][1])]
    return {i: (len(s), c, i == c) for (i, s), c in zip(sets, components([i for i, _ in sets], links).values())}


def run(spark, docs, schema="doc_id bigint, text string"):
    got = B.near_duplicates(spark.createDataFrame(docs, schema))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()}


def variants(rng, n_groups=25):
    vocab = [f"w{i}" for i in range(2000)]
    docs, shared = [], " ".join(rng.choices(vocab, k=40))
    for _ in range(n_groups):
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 8, 16, 19, 40, 70, 260, 900]))
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25 + 1)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(3) or [w[k]]
            docs.append(" ".join(w) if rng.random() < 0.6 else shared + " " + " ".join(w))
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("size", [4, 60, 1500])
def test_minima_agree_as_often_as_sets_are_similar(size):
    rng = np.random.Generator(np.random.PCG64(size))
    errors, agree, longer = [], [], []
    for _ in range(150):
        x = rng.integers(0, 2**63, 2 * size, dtype=np.uint64) * np.uint64(2)
        shift = int(rng.integers(0, size // 2 + 1))
        a, b = np.unique(x[:size]), np.unique(x[shift : size + shift])
        low = B.minima([a, b])
        true = (size - shift) / (size + shift)
        agree.append((low[0] == low[1]).mean() - true)
        sig = B.packed(low)
        errors.append(float(B.likeness(B.apart(sig[0], sig[1]))) - true)
        wide = B.packed(B.minima([a, b], B.LONG))
        longer.append(float(B.likeness(B.apart(wide[0], wide[1]), B.LONG)) - true)
        if true >= 0.8:
            assert B.apart(sig[0], sig[1]) <= B.MOST_APART and B.apart(wide[0], wide[1]) <= B.MOST_APART_LONG
    assert abs(np.mean(agree)) < 0.01 and np.std(agree) < 0.035 and abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04
    assert abs(np.mean(longer)) < 0.01 and np.std(longer) < 0.02


def test_similar_sets_share_a_key():
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.integers(0, 2**63, 140, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate((x[:k], x[k + 11 : 111]))) for k in range(90)]  # each 80 % of the next at least
    keys = B.band_keys(B.minima(sets))
    assert all(np.intersect1d(a, b).size for a, b in zip(keys, keys[1:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    docs = variants(random.Random(seed))
    docs += [(5000, docs[3][1].upper()), (5001, None), (5002, ""), (5003, " \n"), (5004, "x " * 30_000), (5005, "X\t" * 30_000)]
    assert run(spark, [(*d, "clash", 1) for d in docs], "doc_id bigint, text string, node string, n int") == brute(docs)


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(120)]
    docs = [(50 - k, " ".join(words[2 * k : 2 * k + 40])) for k in range(20)]
    got = run(spark, docs)
    assert got == brute(docs) and {c for _, c, _ in got.values()} == {31}


def test_crowded_buckets_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(B, "_TILE", 7)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(160):  # similarities of 0.6 to 1 to each other
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"v{rng.randrange(400)}"
        docs.append((i, " ".join(w)))
    assert run(spark, docs) == brute(docs)


def test_nulls_repeats_and_empty(spark):
    t = "one two three four five six"
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (7, "other words"), (None, "alone here"), (None, None)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in B.near_duplicates(df).collect())
    want = [("7", 1, "7", True), ("7", 3, "7", True), ("7", 3, "7", True), ("None", 0, "None", True), ("None", 1, "None", True), ("None", 3, "7", False)]
    assert got == want
    assert B.near_duplicates(df.filter("doc_id > 100")).count() == 0


def test_sets_of_the_words():
    assert [len(s) for s in shingle_sets(pa.array(["a b c", "a b c d", "a b c d e", None]), B.WIDTH)] == [1, 1, 2, 0]
