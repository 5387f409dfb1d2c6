"""Finds short benchmark items inside long documents.

Both sides are sets of five-word shingles, and an item is found where at least
``share`` of its shingles are in the document.  Items are partitioned by set size.
Within a partition each item is indexed under the smallest MinHash values of its
shingles, one more than may be missing at the partition's largest size, so a
document that holds enough of an item holds one of the indexed values.  Documents
look up their own hashes, but only in partitions of items small enough for them.
Candidates are verified by exact containment.

Documents are read once.  Two bitmaps of a fixed size, of the index and of all item
shingles, decide what leaves that pass; false positives of the bitmaps only add
rows that the joins then drop.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilgrid.llm.bits import bitmap, maybe
from perilgrid.llm.words import blocks, mix, shingle_sets
from perilgrid.session import cut_lineage

_SALT = np.uint64(0x5851F42D4C957F2D)


def _band(n: int) -> int:
    """Size partition: powers of two."""
    return max(n, 1).bit_length()


def _sketch_size(n: int, share: float) -> int:
    """Indexed values for an item of ``n`` shingles: one more than its partition's largest item may miss."""
    largest = (1 << _band(n)) - 1
    return largest - math.ceil(share * largest) + 1


def item_sets(items: DataFrame, id_col: str, text_col: str, share: float) -> DataFrame:
    """``item_id``, ``n``, ``shingles``, ``sketch``: the item's smallest MinHash values."""
    source = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def build(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                sets = list(shingle_sets(part.column(1)))
                small = [s[np.argsort(mix(s ^ _SALT))[: _sketch_size(len(s), share)]] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([s.view(np.int64) for s in small], pa.list_(pa.int64())),
                    ],
                    ["item_id", "n", "shingles", "sketch"],
                )

    kind = source.schema["item_id"].dataType.simpleString()
    return source.mapInArrow(build, f"item_id {kind}, n int, shingles array<bigint>, sketch array<bigint>").filter("n > 0")


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    share: float = 0.75,
    bits: int = 23,
) -> DataFrame:
    """``id``, ``item``, ``n_item``, ``n_shared``, ``containment`` for every item found in a document.

    Null texts and texts without words hold nothing and are found nowhere.  A
    text of fewer than five words is one shingle, its whole sequence, so such an
    item is found only in a document with just these words.  Equal rows of one id
    and text give one row per item; ids may be null and repeat, and different
    texts of one id are looked at one by one (an item found in both gives two
    rows when their counts differ).  Empty tables give no rows.
    """
    sets = cut_lineage(item_sets(items, item_col, item_text, share))
    index = sets.select("item_id", "n", "shingles", F.explode("sketch").alias("h"))
    probe, known = bitmap(index, "h", bits), bitmap(sets.select(F.explode("shingles").alias("h")), "h", bits)
    shared = docs.sparkSession.sparkContext.broadcast((probe, known))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    kind = source.schema["_id"].dataType.simpleString()

    def look_up(batches):
        probe, known = shared.value
        for batch in batches:
            for part in blocks(batch, "text"):
                rows, sizes, keys, held = [], [], [], []
                for i, s in enumerate(shingle_sets(part.column(1))):
                    found = s[maybe(probe, s)]
                    if len(found):
                        rows.append(i)
                        sizes.append(len(s))
                        keys.append(found.view(np.int64))
                        held.append(s[maybe(known, s)].view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int32()), pa.array(keys, longs), pa.array(held, longs)],
                    ["_id", "size", "keys", "held"],
                )

    probes = source.mapInArrow(look_up, f"_id {kind}, size int, keys array<bigint>, held array<bigint>")
    # an item's share has to fit into the document
    keyed = probes.select("_id", "size", "held", F.explode("keys").alias("h"))
    candidates = keyed.join(index, "h").filter(F.col("size") >= F.ceil(F.col("n") * share))
    verified = candidates.withColumn("n_shared", F.size(F.array_intersect("held", "shingles"))).filter(
        F.col("n_shared") >= F.ceil(F.col("n") * F.lit(share))
    )
    return (
        verified.select("_id", "item_id", "n", "n_shared")
        .distinct()
        .select(
            F.col("_id").alias(id_col),
            F.col("item_id").alias(item_col),
            F.col("n").alias("n_item"),
            "n_shared",
            (F.col("n_shared") / F.col("n")).alias("containment"),
        )
    )
