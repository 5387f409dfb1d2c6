import public_tokenizers
import pytest

from perilgrid.llm.token_counts import count_tokens, stored_counts

SCHEMA = "doc_id bigint, text string, n_tokens string, content string"
TEXTS = [
    None,
    "",
    " ",
    "plain words, don't stop",
    "a  b\n \nc \t d\r\n\r\n  e   ",
    "<|endoftext|> in <|endoftext|>text",
    "no-break  space  x\x0b y \x1c\x1d z\u0085",
    "naïve 漢字 \U0001f600 ½ Ⅷ ١٢٣",
    "word " * 4000 + "x" * 5000,
]


def brute(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(sp.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [len(tok.encode(t or "", add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_as_the_library(spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "x y", None, None), (3, TEXTS[3], "a", "b")]
    got = count_tokens(spark.createDataFrame(rows, SCHEMA), path).collect()
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), n) for r, n in zip(rows, brute(path, [r[1] for r in rows])))
    assert sorted((r[0] if r[0] is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_real_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, brute(path, list(texts.values()))))
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, path).collect()} == want


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    one = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id int, text string")
    assert sorted(r.n_tokens for r in count_tokens(one, path, cache=cache).collect()) == [0, 2, 2]
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    version = stored.first().version
    # a count put into the cache by hand is believed, so nothing was encoded again
    spark.createDataFrame([("0" * 64, version, 7)], "content string, version string, n_tokens bigint").write.mode("append").parquet(cache)
    two = spark.createDataFrame([(1, "a b"), (9, "new")], "doc_id int, text string")
    assert sorted(r.n_tokens for r in count_tokens(two, path, cache=cache).collect()) == [1, 2]
    assert spark.read.parquet(cache).count() == 4
    assert stored_counts(spark, cache, version).count() == 4
    assert stored_counts(spark, cache, "other").count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
