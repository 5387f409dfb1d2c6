"""SentencePiece encoding and decoding with the tokenizers library as its engine.

The model protobuf is parsed and rebuilt: normaliser, metaspace marker, the pieces
with their scores (a unigram lattice, or for BPE models the merges the scores
imply) and byte fallback.  No piece runs on past the step from a character to a
marker, so a text falls into stretches that begin with markers; each distinct
stretch is encoded once per worker, many of them in a row and in multithreaded
batches, and checked against the sentencepiece library.  When a worker's memory of
stretches fills up, those not met lately go.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilgrid.llm.words import blocks, with_text

MARK = "▁"
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_KNOWN_STRETCHES = 200_000
#: Bytes of text, and stretches, that are encoded at a time; the library's results are some hundred times as large as the ids.
_BLOCK, _AT_A_TIME = 1 << 19, 5_000
#: Stretches that are encoded as one text; the pieces that begin with a marker tell where each starts.
_IN_ROW = 32
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_codecs: dict[tuple, object] = {}


def build_tokenizer(spec: bytes):
    """A ``tokenizers.Tokenizer`` with the behaviour of a serialised sentencepiece model."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    proto = pb.ModelProto()
    proto.ParseFromString(spec)
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if train.treat_whitespace_as_suffix or any(p.type == _USER for p in proto.pieces):
        raise ValueError("markers after words and user-defined pieces are not supported")
    unknown = next(p.piece for p in proto.pieces if p.type == _UNKNOWN)
    ids = {p.piece: i for i, p in enumerate(proto.pieces)}
    if train.model_type == 1:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], ids[unknown], train.byte_fallback)
    else:
        normal = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        merges = [
            (-score, len(left), left, piece[len(left) :])
            for piece, score in normal.items()
            for left in (piece[:k] for k in range(1, len(piece)))
            if left in normal and piece[len(left) :] in normal
        ]
        model = models.BPE(
            ids, [(a, b) for *_, a, b in sorted(merges)], unk_token=unknown, fuse_unk=True, byte_fallback=train.byte_fallback
        )
    tok = Tokenizer(model)
    steps = []
    if norm.precompiled_charsmap:
        steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    ends = [decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return tok, proto


class Encoder:
    """Encodes texts; ``repaired`` counts stretches in which the two libraries differed."""

    def __init__(self, spec: bytes):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        full, proto = build_tokenizer(spec)
        self.normal = full.normalizer
        norm = proto.normalizer_spec
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        full.normalizer = None
        self.tok = full
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=spec)
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        self.begins = np.array([p.piece[:1] == MARK for p in proto.pieces])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remember = _KNOWN_STRETCHES
        self.repaired = 0

    def _learn(self, stretches: list[str]) -> None:
        """Encodes stretches with both libraries, those that begin with one marker many in a row."""
        in_row = [bool(self.prefix) and len(s) > 1 and s[0] == MARK != s[1] for s in stretches]
        rows = [s for s, good in zip(stretches, in_row) if good]
        alone = [s for s, good in zip(stretches, in_row) if not good]
        rows = [rows[a : a + _IN_ROW] for a in range(0, len(rows), _IN_ROW)]
        for a in range(0, len(rows), _AT_A_TIME // _IN_ROW):
            some = rows[a : a + _AT_A_TIME // _IN_ROW]
            texts = ["".join(row) for row in some]
            wanted = self.reference.encode([t[1:].replace(MARK, " ") for t in texts], num_threads=2)
            for row, got, want in zip(some, self.tok.encode_batch(texts, add_special_tokens=False), wanted):
                ids = got.ids
                packed = np.array(ids, np.int32)
                at = np.flatnonzero(self.begins[packed])
                if ids != want or len(at) != len(row):  # a marker is in no other place, so as many begin as there are
                    alone += row
                    continue
                raw, cuts = packed.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                self.known.update(zip(row, [raw[i:j] for i, j in zip(cuts, cuts[1:])]))
        self._learn_alone(alone)

    def _learn_alone(self, stretches: list[str]) -> None:
        cut = len(self.prefix)
        for a in range(0, len(stretches), _AT_A_TIME):
            some = stretches[a : a + _AT_A_TIME]
            wanted = self.reference.encode([s[cut:].replace(MARK, " ") for s in some], num_threads=2)
            for s, got, want in zip(some, self.tok.encode_batch(some, add_special_tokens=False), wanted):
                ids = got.ids
                if ids != want and len(s) > cut:  # a lone marker cannot be given to the reference
                    self.repaired += 1
                    ids = want
                self.known[s] = np.array(ids, np.int32).tobytes()

    def forget(self) -> None:
        self.known.clear()
        self.older.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        if self.plain:
            marked = [self.prefix + t.replace(" ", MARK) if t else "" for t in texts]
        else:
            marked = [self.normal.normalize_str(t) if t else "" for t in texts]
            marked = ["" if m == self.prefix else m for m in marked]
        if self.whole:
            return [np.array(e.ids, np.int32).tobytes() for e in self.tok.encode_batch(marked, add_special_tokens=False)]
        parts = [_STRETCH.findall(m) for m in marked]
        if len(self.known) > self.remember // 2:
            self.known, self.older = {}, self.known
        new = set().union(*parts).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((s, self.older[s]) for s in again)
        self._learn(list(new - again))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


class Decoder:
    """Puts texts together from the bytes of the pieces."""

    def __init__(self, spec: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(spec)
        special = {_CONTROL: b"", _UNKNOWN: " ⁇ ".encode()}
        table = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else special.get(p.type, p.piece.replace(MARK, " ").encode())
            for p in proto.pieces
        ]
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(x) for x in table])
        self.at = np.cumsum(self.size) - self.size
        self.blank = np.array([proto.normalizer_spec.add_dummy_prefix and x[:1] == b" " for x in table])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of concatenated id lists; ``ends`` has where each list ends, after a leading 0."""
        at, size = self.at[ids], self.size[ids]
        first = ends[:-1][ends[1:] > ends[:-1]]
        lead = self.blank[ids[first]].astype(np.int64)  # the marker put before every text
        at[first] += lead
        size[first] -= lead
        stop = np.cumsum(size)
        raw = self.data[np.repeat(at - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        cut = np.append(0, stop)[ends].astype(np.int32)
        texts = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(cut), pa.py_buffer(raw)])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # ids that no text gives
            texts = pa.array([raw[a:b].tobytes().decode("utf-8", errors="replace") for a, b in zip(cut, cut[1:])], pa.string())
        return texts


def _cached(kind, spec: bytes):
    """One per worker process and model."""
    key = (kind.__name__, hash(spec))
    if key not in _codecs:
        _codecs[key] = kind(spec)
    return _codecs[key]


def _rest(df: DataFrame, drop: tuple[str, ...]):
    others = [c for c in df.columns if c not in drop]
    return others, F.struct(F.lit(True).alias("_"), *[F.col(c) for c in others]).alias("_rest")


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", remember: int = _KNOWN_STRETCHES) -> DataFrame:
    """The rows of ``docs`` with ``ids``, the piece ids of the text, without begin or end.

    A worker keeps the ids of about ``remember`` stretches, until its task ends.

    A null text has null ids and an empty one none.  Whole texts are encoded,
    however long.  Rows are independent, so nulls, repeats and ties in other
    columns mean nothing; a column that has the name ``ids_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    others, rest = _rest(docs, (ids_col,))
    once = text_col in others  # a batch then holds its texts once
    source = docs.select(rest) if once else docs.select(rest, F.col(text_col).alias("text"))

    def encode(batches):
        codec = _cached(Encoder, shared.value)
        codec.remember = remember
        for batch in batches:
            for part in blocks(with_text(batch, text_col) if once else batch, "text", _BLOCK):
                texts = part.column(1).to_pylist()
                packed = codec.encode([t or "" for t in texts])
                ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
                gone = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)), mask=gone)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["_rest", "ids"])
        codec.forget()

    done = source.mapInArrow(encode, source.select("_rest").schema.add("ids", T.ArrayType(T.IntegerType())))
    return done.select(*[F.col("_rest").getField(c).alias(c) for c in others], F.col("ids").alias(ids_col))


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` with the text that the ids stand for; null ids give null.

    Bytes that are not UTF-8 become U+FFFD; control pieces give nothing.  A column
    that has the name ``text_col`` is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    others, rest = _rest(encoded, (text_col,))
    source = encoded.select(rest, F.col(ids_col).alias("ids"))

    def decode(batches):
        codec = _cached(Decoder, shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                lists = part.column(1)
                length = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
                texts = codec.decode(lists.flatten().to_numpy(), np.append(0, np.cumsum(length)))
                texts = pa.compute.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["_rest", "decoded"])

    done = source.mapInArrow(decode, source.select("_rest").schema.add("decoded", "string"))
    return done.select(*[F.col("_rest").getField(c).alias(c) for c in others], F.col("decoded").alias(text_col))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_pieces``, ``ids``, ``same``: whether decoding the ids gives the text back.

    It does unless the text itself holds the marker character, which stands for
    a space.  Null texts have null ids and a null ``same``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text_col, 256).alias("_before"), F.col(text_col).alias("text"))
    coded = decode_pieces(encode_pieces(rows, model).drop("text"), model)
    return coded.select(
        F.col("_id").alias(id_col),
        F.when(F.col("ids").isNotNull(), F.size("ids")).cast("bigint").alias("n_pieces"),
        "ids",
        (F.sha2("decoded", 256) == F.col("_before")).alias("same"),
    )
