import hashlib
import random
import re

from pyspark.sql import functions as F

from perilgrid.llm import fingerprints
from perilgrid.llm.fingerprints import PIECES, fingerprint_documents, subtract


def pieces(text):
    width = next(w for below, w in PIECES if below is None or len(text) < below)
    return set(re.findall(rf"[^\n]{{1,{width}}}\n*|\n+", text))


def alike(a, b):
    a, b = pieces(a), pieces(b)
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def brute(docs):
    rows = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, nxt), 9))
    return out


def check(df, docs):
    rows = fingerprint_documents(df).collect()
    got = {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows}
    assert got == brute(docs)
    prints = {}
    for r in rows:
        assert prints.setdefault(dict(docs)[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    return rows


def test_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdé😀\n. ", k=rng.randrange(1, 9)))
    docs = [(i * 7, " ".join(word() for _ in range(rng.choice([0, 1, 3, 30, 300])))) for i in range(60)]
    docs += [(500, docs[-1][1]), (501, None), (502, ""), (503, "x" * 90_000), (504, "line\n" * 5000), (505, "\n\n"), (-3, "ab"), (506, " ".join(str(k) for k in range(30_000)))]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, _text string, fingerprint int")
    check(df, docs)


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)


def test_larger_sketch_after_failure(spark):
    rng = random.Random(2)
    a, b = [[rng.getrandbits(62) for _ in range(n)] for n in (300, 200)]
    df = spark.createDataFrame([(1, a + b[:50], b), (2, a, a), (3, a[:20], [])], "id int, a array<bigint>, b array<bigint>")
    crowded = {r.id: (r.found, r.left) for r in subtract(df, ["id"], 0, 400.0).collect()}
    assert crowded[1][1] > 0 and 2 not in crowded and crowded[3] == (20, 0)
    roomy = {r.id: (r.found, r.left) for r in subtract(df, ["id"], 1, 8.0).collect()}
    assert roomy[1] in ((450, 0),) or roomy[1][1] > 0
    assert subtract(df.filter(F.lit(False)), ["id"], 0, 8.0).count() == 0


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "abc abc"), (4, "one two three"), (4, "four"), (4, "four")], "doc_id bigint, text string")
    rows = fingerprint_documents(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "4", "4", "None"]
    assert fingerprint_documents(df.filter("doc_id > 9")).count() == 0
    one = fingerprint_documents(df.filter("text = 'one two three'")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"one two tone ").hexdigest()


def test_tasks_grow_with_the_digests(spark, monkeypatch):
    pairs = spark.createDataFrame([(i, list(range(30)), list(range(10 + i))) for i in range(20)], "at int, a array<bigint>, b array<bigint>")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fingerprints._tasks(pairs) == fingerprints._tasks(pairs.limit(0)) == least
    monkeypatch.setattr(fingerprints, "_PER_TASK", 100)
    assert fingerprints._tasks(pairs) == 10  # 990 digests


def test_only_failed_pairs_are_written(spark, monkeypatch):
    written, cut = [], fingerprints.cut_lineage
    monkeypatch.setattr(fingerprints, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    rng = random.Random(4)
    docs = [(i, "\n".join(f"word{rng.randrange(900)}" for _ in range(rng.choice([5, 40, 900])))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    check(df, docs)
    held = lambda t: [c for c, kind in t.dtypes if "array<bigint>" in kind]
    assert all(t.filter(F.col(c).isNotNull()).count() <= 20 for t in written for c in held(t))
    monkeypatch.setattr(fingerprints, "_PER_PAGE", 4000.0)
    written.clear()
    check(df, docs)
    assert len(written) > 1 and written[0].filter("_again is not null").count() > 20


def test_one_shuffle_of_texts(spark, monkeypatch):
    plans, cut = [], fingerprints.cut_lineage
    monkeypatch.setattr(fingerprints, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fingerprint_documents(docs, by_content=True).count()
    first = plans[0]
    assert "ShuffledHashJoin" in first and "hashpartitioning(_bucket" in first and "hashpartitioning(_at" not in first
    assert not [x for x in first.splitlines() if "Exchange" in x and "_bucket" in x and "_at" in x]
