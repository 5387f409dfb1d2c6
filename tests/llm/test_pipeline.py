import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from brute import components, dedup, lines, shingles
from perilgrid.llm.pieces import encode_pieces
from perilgrid.llm.toxicity import Model, score_toxicity
from perilgrid.session import cut_lineage

SF = "/root/testdata/sf0.01"


def similar_groups(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(p, q) for ks in holders.values() for p in ks for q in ks if p < q}
    similar = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    return components([i for i, _ in sets], [(sets[p][0], sets[q][0]) for p, q in pairs if similar(sets[p][1], sets[q][1])])


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = cut_lineage(stage(spark, docs, SF))
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and docs.columns[: len(columns)] == columns
        if name == "toxicity":
            assert sum(after.get(i) is None for i in before if labels.get(i) == 0) <= 2
            assert sum(i in after for i in before if labels.get(i) == 1) <= 6
            assert all(before[i] == t for i, t in after.items())
        elif name == "line_dedup":
            want = dedup(list(before.items()))
            gone = {i for i, t in want.items() if lines(before[i]) and not lines(t)}
            assert after == {i: t for i, t in want.items() if i not in gone}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "ngram_jaccard":
            assert set(after) == {i for i, c in similar_groups(list(before.items())).items() if i == c}
        elif name == "decontamination":
            held = lambda t: any(q and 4 * len(q & shingles(t)) >= 3 * len(q) for q in items)
            assert set(after) == {i for i, t in before.items() if not held(t)}
        else:
            assert after == before
            assert {r.doc_id: r.ids for r in rows} == {i: sp.encode(t) for i, t in before.items()}
        assert len(after) < len(before) or name in ("line_dedup", "sentencepiece")


def test_odd_rows_pass_through(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, "a", None), (None, "some words", "en", None, 10), (2, "", "en", "a", 0), (3, "x y z", None, None, 5), (3, "x y z", None, None, 5)]
    for name, data, kind in (
        ("documents", rows, schema),
        ("labels", [], "doc_id bigint, quality int, toxic int"),
        ("benchmark", [(None, None)], "item_id bigint, text string"),
    ):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "None"]


def test_one_python_worker_a_task(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= 1, name


def test_a_batch_holds_its_texts_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = score_toxicity(docs, Model(np.zeros(0, np.uint64), np.zeros(0), 0.0))
    for out in (scored, encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))):
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = plan[next(k for k, x in enumerate(plan) if "MapInArrow" in x) + 1]
        assert below.count("text#") == 1, below
