import pyarrow as pa

from perilgrid.llm.line_dedup import dedup_lines, lines_of
from brute import dedup, lines

LONG = "This passage has more than eight words in it now. Here comes a second part of the passage, just as long! And is there a third part to it as well? Then it ends with a fourth part that is also long."


def test_lines_are_cut_as_stated():
    texts = [None, "", " \n\n ", "a\nb\n\nc d\r\ne", LONG, "\n x " + LONG + "\n" + LONG, "é. É! " * 30, "w " * 50]
    hashes, starts, before, bounds = lines_of(pa.array(texts))
    names = {}
    for i, t in enumerate(texts):
        got = [(hashes[k], starts[k] - bounds[i]) for k in range(before[i], before[i + 1])]
        want = lines(t)
        assert [len((t or "")[:p].encode()) for _, p in want] == [p for _, p in got]
        for (w, _), (h, _) in zip(want, got):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_removal_against_brute_force(spark):
    own = [f"Line {i} of its own, with words." for i in range(20)]
    docs = [
        (1, "\n".join([*own[:4], LONG])),
        (2, "head\n" + LONG + "\ntail"),
        (3, LONG.upper().replace(" ", "  ")),
        (4, "\n".join(own[1:4] + ["x"] + own[0:4])),
        (5, "two\nlines"),
        (6, "two\nlines"),
        (7, "a\nb\nc\na\nb\nc\na\nb\nc"),
        (8, ""),
        (9, "é\n" * 10),
        (10, "\n\n\n\n"),
        (11, ("w " * 20 + ". ") * 2000),
    ]
    df = spark.createDataFrame([(i, t, "k", 7) for i, t in docs], "doc_id bigint, text string, _row string, n_lines int")
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_row", "n_lines", "n_removed"]
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == dedup(docs)
    assert {r._row for r in rows} == {"k"}
    assert {r.doc_id: r.n_removed for r in rows}[5] == 0 and {r.doc_id: r.n_removed for r in rows}[7] == 6


def test_nulls_repeats_and_empty(spark):
    t = "one\ntwo\nthree\nfour"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (6, None), (5, t + "\nfive")], "doc_id bigint, text string")
    got = sorted(((str(r.doc_id), r.text) for r in dedup_lines(df).collect()), key=str)
    assert ("None", "") in got and ("6", None) in got and got.count(("5", t)) in (0, 2)
    assert sum(x.startswith("one\ntwo") for _, x in got if x) == (2 if got.count(("5", t)) else 1)
    assert dedup_lines(df.filter("doc_id > 100")).count() == 0


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = dedup([(r.doc_id, r.text) for r in docs.collect()])
    rows = dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r.n_removed for r in rows) > 50
