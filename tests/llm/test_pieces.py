import numpy as np
import public_tokenizers
import sentencepiece

from perilgrid.llm.pieces import Decoder, Encoder, build_tokenizer, decode_pieces, encode_pieces, round_trip

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None,
    "",
    " ",
    "  ",
    "Plain words, and  double   spaces ",
    "tabs\tand\nnew\r\nlines \n x",
    "naïve 漢字 \U0001f600 \u0000 ½ ▁ mark",
    "<s> </s> <unk> <0x41>",
    "aba ababa banana abaabaaba",
    "long" * 20_000 + " " + "x y " * 20_000,
]


def reference():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_as_the_library(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id int, text string, _rest string")
    coded = encode_pieces(df, MODEL)
    assert coded.columns == ["doc_id", "text", "_rest", "ids"]
    sp = reference()
    for r in decode_pieces(coded, MODEL).collect():
        assert r.ids == (None if r.text is None else sp.encode(r.text)) and r._rest == "clash"
        assert r.decoded == (None if r.text is None else sp.decode(r.ids))


def test_whole_text_tokenizer_agrees():
    tok, _ = build_tokenizer(open(MODEL, "rb").read())
    sp = reference()
    for t in TEXTS[4:-1]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert ids == sp.encode(t) and tok.decode(ids) == sp.decode(ids)


def test_differences_are_repaired():
    codec = Encoder(open(MODEL, "rb").read())
    codec.encode(["some words"])
    assert codec.repaired == 0


class Counted:
    def __init__(self, library):
        self.library, self.given = library, []

    def encode(self, texts, **more):
        self.given += texts
        return self.library.encode(texts, **more)


def test_stretches_are_checked_in_rows_and_remembered():
    sp, codec = reference(), Encoder(open(MODEL, "rb").read())
    codec.reference, codec.remember = Counted(sp), 1_000
    often = " ".join(f"often{i}" for i in range(50))
    texts = [often + " " + " ".join(f"word{k}x{i}" for i in range(200)) for k in range(20)] + TEXTS[2:]
    for t in texts:
        assert codec.encode([t]) == [np.array(sp.encode(t), np.int32).tobytes()]
    assert len(codec.known) + len(codec.older) <= 1_000 + 250 and not codec.repaired
    words = [w for t in codec.reference.given for w in t.split(" ")]
    assert words.count("often7") == 1 and len(codec.reference.given) < 400


def test_differences_between_the_libraries_in_a_row_are_repaired():
    sp, codec = reference(), Encoder(open(MODEL, "rb").read())
    low, high = Counted(sp), codec.tok
    codec.reference = low

    class Wrong:
        def encode_batch(self, texts, **more):
            return high.encode_batch([t.replace("banana", "bananas") for t in texts], **more)

    codec.tok = Wrong()
    text = "a banana and an apple"
    assert codec.encode([text]) == [np.array(sp.encode(text), np.int32).tobytes()] and codec.repaired == 1


def test_bytes_that_are_no_text():
    spec, sp = open(MODEL, "rb").read(), reference()
    lists = [[sp.piece_to_id("<0xC3>"), sp.piece_to_id("▁a")], [], [sp.piece_to_id("▁a"), 1, 2, 0]]
    ends = np.cumsum([0, *map(len, lists)])
    got = Decoder(spec).decode(np.array([i for x in lists for i in x], np.int32), ends).to_pylist()
    assert got[0] == "\ufffd a" and got[1] == "" and got[2].startswith("a")


def test_round_trip_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sp, got = reference(), round_trip(docs, MODEL).collect()
    want = {r.doc_id: sp.encode(r.text) for r in docs.collect()}
    assert {r.doc_id: r.ids for r in got} == want and all(r.same for r in got)
    assert all(r.n_pieces == len(r.ids) for r in got)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b"), (1, "a b")], "doc_id bigint, text string")
    got = round_trip(df, MODEL).collect()
    assert len(got) == 4 and [(r.n_pieces, r.same) for r in got if r.ids is None] == [(None, None)]
    assert round_trip(df.limit(0), MODEL).columns == ["doc_id", "n_pieces", "ids", "same"]
    assert round_trip(df.filter("doc_id > 5"), MODEL).count() == 0
