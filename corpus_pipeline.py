"""A training corpus made ready: each stage works on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.decontaminate import find_items
from perilgrid.llm.line_dedup import dedup_lines
from perilgrid.llm.parity_join import similar_texts
from perilgrid.llm.pieces import decode_pieces, encode_pieces
from perilgrid.llm.toxicity import score_toxicity, train
from perilgrid.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns in one, so that none of them meets a column that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")).alias("_own"))


def _unpacked(docs: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    own = {c: F.col(c) for c in ("doc_id", "text")} | new
    return docs.select(*[own.get(c, F.col("_own").getField(c)).alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic.

    Null and empty texts are scored like others; rows that repeat an id are each
    judged by their own text.  Other columns are kept, whatever their names.
    """
    model = train(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return _unpacked(score_toxicity(_packed(docs), model).filter("predicted = 0"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document that is nothing else goes.

    Null and empty texts, and those of fewer than three lines, stay as they are; rows that
    repeat an id and its text get the same result.  Other columns are kept.
    """
    out = dedup_lines(_packed(docs)).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    before = F.col("_own.n_chars")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(before)
    return _unpacked(out, docs.columns, n_chars=n_chars)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of similar ones.

    Rows that repeat an id and its text are one document and stay together.
    """
    groups = similar_texts(docs)
    extra = groups.filter(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id")))
    extra = extra.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(extra["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == extra["_hash"])
    return docs.join(extra, same, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and empty texts hold none, and a null id is an id of its own."""
    hits = find_items(docs, _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_id"]), "left_anti")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids; the text is the one decoded from them.

    A null text stays null, with null ids.  Columns named ``ids`` and ``n_pieces`` are replaced.
    The ids are written before they are decoded: else every task would hold two Python workers at once.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    own = [c for c in docs.columns if c not in ("ids", "n_pieces")]
    coded = encode_pieces(docs.select(*own), model, remember=60_000).withColumn("n_pieces", F.size("ids"))
    return decode_pieces(cut_lineage(coded.drop("text")), model, text_col="text").select(*own, "n_pieces", "ids")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
