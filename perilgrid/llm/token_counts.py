"""Token counts through a cache of content digests.

Each text is reduced to the digest of its normalised content.  Digests joined
with a stored table of counts, kept per tokenizer version, leave the distinct
contents that were never counted; only those are encoded, and their counts are
appended to the table.  Normalising here means null to empty: anything more would
change the counts.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.llm.words import blocks
from perilgrid.session import scratch_path

_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_OTHER_SPACE = re.compile("[^\\S \\t\\n\\r]|[\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")
_KNOWN_PIECES = 300_000
_counters: dict[str, object] = {}


class _JsonCounter:
    """Counts through a tokenizers file.

    A byte-level vocabulary without a normaliser never joins characters across
    the step from a visible character to a blank, so a text may be cut there and
    the count of each distinct piece remembered.  Texts with rarer white space,
    and other kinds of vocabulary, are encoded whole.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_str(spec.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        pre = self.tok.pre_tokenizer
        added = self.tok.get_added_tokens_decoder().values()
        self.cuts = (
            self.tok.normalizer is None
            and isinstance(pre, ByteLevel)
            and pre.use_regex
            and not pre.add_prefix_space
            and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        )
        self.known: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self._encode(texts)
        whole = [_OTHER_SPACE.search(t) is not None for t in texts]
        parts = [[] if w else _PIECE.findall(t) for t, w in zip(texts, whole)]
        if len(self.known) > _KNOWN_PIECES:
            self.known.clear()
        new = list(set().union(*parts).difference(self.known)) if parts else []
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            self.known.update(zip(some, self._encode(some)))
        count = self.known.__getitem__
        rest = iter(self._encode([t for t, w in zip(texts, whole) if w]))
        return [next(rest) if w else sum(map(count, p)) for p, w in zip(parts, whole)]


class _PieceCounter:
    """Counts through a sentencepiece model."""

    def __init__(self, spec: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=spec)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]


def _counter(version: str, kind: str, spec: bytes):
    """One counter per worker process and tokenizer."""
    if version not in _counters:
        _counters[version] = (_JsonCounter if kind == "json" else _PieceCounter)(spec)
    return _counters[version]


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache: str | None = None,
    limit: int = 512,
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row of ``docs``.

    ``tokenizer`` is a tokenizers ``.json`` or a sentencepiece ``.model`` file,
    read once by the driver; its digest is the version under which counts are
    stored.  ``cache`` is a Parquet folder of earlier counts that this call
    appends to; without one a new folder under the shared scratch folder is used.

    A null text counts as an empty one, which has no bytes and no tokens.  Rows
    with a null or repeated id are kept as they are, one row out for each row in;
    an empty table gives no rows.  Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    spec = Path(tokenizer).read_bytes()
    kind = "model" if str(tokenizer).endswith(".model") else "json"
    version = hashlib.sha256(spec).hexdigest()
    shared = spark.sparkContext.broadcast(spec)
    cache = cache or scratch_path(spark, "token-counts")
    contents = docs.select(F.sha2(_content(text_col), 256).alias("content"), _content(text_col).alias("text"))
    misses = contents.dropDuplicates(["content"]).join(stored_counts(spark, cache, version), "content", "left_anti")

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(version, kind, shared.value)
        for batch in batches:
            for part in blocks(batch, "text"):
                counts = counter(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    with_bytes = misses.mapInArrow(encode, "content string, n_tokens bigint")
    with_bytes.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    ids = docs.select(
        F.col(id_col).alias(id_col),
        F.sha2(_content(text_col), 256).alias("content"),
        F.octet_length(_content(text_col)).cast("bigint").alias("n_bytes"),
    )
    counts = stored_counts(spark, cache, version)
    return ids.join(counts, "content", "left").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def stored_counts(spark, cache: str, version: str) -> DataFrame:
    """``content``, ``n_tokens`` of one tokenizer version; one row per content
    even where an append ran twice."""
    schema = "content string, version string, n_tokens bigint"
    try:
        table = spark.read.schema(schema).parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], schema)
    return table.filter(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
