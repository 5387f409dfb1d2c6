import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from brute import lower
from perilgrid.llm.phrases import chunk_dictionary, collocations, parse


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]


def brute(docs, least, top=2000, longest=5):
    counts, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for w in pieces(text):
            n[lang] += len(w)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside.get(p[i:j], 0), a)
        rows = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def run(docs, **more):
    got = collocations(docs, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {kind for c, kind in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(tuple(r) for r in got.collect())


def texts(seed, n=250):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünder", "ÉTÉ", "it's", "New", "york", "x y"]
    fixed = [rng.choices(vocab, k=k) for k in (2, 3, 5, 9, 40)]
    docs = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(12)):
            words += rng.choice(fixed) if rng.random() < 0.4 else rng.choices(vocab, k=rng.randrange(30))
            if rng.random() < 0.5 and words:
                words[-1] += rng.choice([".", ",", "!?", ";", ":", "\n", "\r\n"])
        text = rng.choice([" ", "  ", "\t", " \t "]).join(words)
        docs.append((rng.choice([text, text.upper(), " " + text]), rng.choice(["en", "de", None])))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = texts(seed)
    df = spark.createDataFrame([(t, g, "x", 3) for t, g in docs], "text string, lang string, words string, n int")
    for least, top, longest in ((6, 2000, 5), (12, 17, 5), (9, 2000, 2)):
        assert run(df, least=least, top=top, longest=longest) == brute(docs, least, top, longest)


def test_every_phrase_is_counted_once_at_its_start(spark):
    docs = texts(9, 60) + [("same " * 5000, "en"), ("one two three four five six seven " * 800, "en")]
    df = spark.createDataFrame(docs, "text string, lang string")
    got, want = Counter(), Counter()
    for r in chunk_dictionary(df).collect():
        w = r.words.split(" ")
        assert len(w) - r.own in (0, 4)
        got.update({(r.lang, *w[i : i + k]): 0 for i in range(r.own) for k in range(1, 6) if i + k <= len(w)})
        for i in range(r.own):
            for k in range(1, min(6, len(w) - i + 1)):
                got[(r.lang, *w[i : i + k])] += r.n
    for text, lang in docs:
        for w in pieces(text):
            want.update((lang or "und", *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert got == want


def test_repeated_passages_give_the_same_chunks():
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(300))
    texts = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(k)) + " " + passage for k in range(20)]
    _, words, own, times = parse(pa.array(texts), pa.array(["en"] * 20))
    assert len(texts) * 250 < sum(int(o) * int(t) for o, t in zip(own, times) if t >= 20) and len(words) < 100


def test_nulls_empty_and_large_counts(spark):
    schema = "text string, lang string"
    assert run(spark.createDataFrame([(None, "en"), ("", None), (" ,. ", "en")], schema)) == []
    assert run(spark.createDataFrame([], schema)) == []
    docs = [("big cat " * 60_000, None), ("big cat", "und")] + [("a lone dog", "en")] * 100
    want = brute(docs, 100)
    assert run(spark.createDataFrame(docs, schema)) == want and want[-1][0] == "und"
