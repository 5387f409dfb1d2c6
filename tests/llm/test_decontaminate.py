import random

from perilgrid.llm.decontaminate import _sketch_size, find_items
from brute import shingles


def brute(docs, items):
    out = set()
    sets = [(i, shingles(t)) for i, t in items]
    for d, t in docs:
        s = shingles(t)
        out |= {(d, i, len(q), len(q & s)) for i, q in sets if q and 4 * len(q & s) >= 3 * len(q)}
    return out


def found(df):
    return {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 60)))) for i in range(60)] + [(100, None), (101, " \n"), (102, "only four words here"), (103, "dup " * 9), (103, "dup " * 9)]
    docs = []
    for d in range(150):
        w = rng.choices(vocab, k=rng.choice([0, 3, 50, 400]))
        for _ in range(rng.randrange(3)):
            q = items[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(4)):
                q[rng.randrange(len(q))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = q
        docs.append((d, " ".join(w).upper() if d % 3 else "\t".join(w)))
    docs += [(500, "Only  four WORDS here"), (501, "x only four words here y"), (502, None), (503, "dup " * 30_000), (504, items[7][1]), (504, items[7][1])]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(*i, "clash") for i in items], "item_id int, text string, shingles string")
    got = find_items(df, it)
    assert found(got) == brute(docs, items)
    assert got.count() == len(found(got))
    # a bitmap that lets everything through changes nothing
    assert found(find_items(df, it, bits=7)) == brute(docs, items)


def test_sketch_misses_nothing():
    for n in range(1, 2000):
        assert _sketch_size(n, 0.75) >= min(n, n - -(-3 * n // 4) + 1)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (1, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "b c d e f"), (2, None)], "item_id bigint, text string")
    assert [tuple(r) for r in find_items(docs, items).collect()] == [(None, None, 1, 1, 1.0)]
    assert find_items(docs, items.filter("item_id > 5")).count() == 0
    assert find_items(docs.filter("doc_id > 5"), items).count() == 0


def test_real_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert want and found(find_items(docs, items)) == want
