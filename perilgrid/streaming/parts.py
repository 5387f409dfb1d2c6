"""Keyed tables that a stream changes a part at a time.

Rows are dealt to a fixed number of parts by a hash of their key.  A batch reads and
replaces only the parts that its keys fall into; the other files stay as they are.
Each part has three places that are used in turn, and one of two small head tables,
also used in turn, says which place of each part is valid.  The head is written last,
so readers see either all of a batch or nothing of it, and a batch that runs again starts
from what it started from before.  Nothing but Spark's reader and writer is used, and the
number of files is bounded by the number of parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = "version bigint, run string, batch bigint, part int, slot int, since bigint"
_SLOTS = 3


def _read(spark: SparkSession, schema: str, *paths: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(*paths)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


class PartTable:
    """A table of rows with a key; ``schema`` is a DDL string and ``key`` names its key columns."""

    def __init__(self, path: str, schema: str, key: list[str], parts: int = 16):
        self.path, self.schema, self.key, self.parts = path.rstrip("/"), schema, key, parts

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def _heads(self, spark: SparkSession) -> list[dict]:
        """The versions that can be read, newest first; a version is a row per part that holds rows."""
        found = []
        for k in (0, 1):
            head = _read(spark, _HEAD, f"{self.path}/head-{k}")
            rows = head.collect() if head is not None else []  # one row per part
            if rows:
                # a version without parts is told by a row without a part
                found.append({"version": rows[0].version, "run": rows[0].run, "batch": rows[0].batch,
                              "parts": {r.part: (r.slot, r.since) for r in rows if r.part is not None}})
        return sorted(found, key=lambda h: -h["version"])

    def _rows(self, spark: SparkSession, parts: dict[int, tuple[int, int]]) -> DataFrame:
        """Rows of the given parts, each as of its version; the other parts are pruned."""
        if not parts:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(f"{self.schema}, _since bigint, part int, slot int").parquet(f"{self.path}/rows")
        places = " or ".join(f"(part = {p} and slot = {s})" for p, (s, _) in sorted(parts.items()))
        since = F.element_at(F.create_map(*[F.lit(x) for p, (_, v) in sorted(parts.items()) for x in (p, v)]), F.col("part"))
        return rows.filter(places).filter(F.col("_since") == since).drop("_since", "part", "slot")

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest whole version."""
        heads = self._heads(spark)
        return self._rows(spark, heads[0]["parts"] if heads else {})

    def update(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch_id: int, run: str = "") -> None:
        """Replaces the parts that ``batch`` has keys of by ``merge(their rows, batch)``.

        ``merge`` must keep rows that it does not change, and give no keys of other parts.
        ``run`` tells checkpoints apart, as each counts its batches from zero.
        """
        spark = batch.sparkSession
        heads = self._heads(spark)
        if heads and (heads[0]["run"], heads[0]["batch"]) == (run, batch_id):
            heads = heads[1:]  # the batch runs again
        base = heads[0] if heads else {"version": 0, "parts": {}}
        held = base["parts"]
        touched = {r.part for r in batch.select(self.part_of().alias("part")).distinct().collect()}
        if not touched:
            return
        version = base["version"] + 1
        slot = {p: (held[p][0] + 1) % _SLOTS if p in held else 0 for p in touched}
        merged = merge(self._rows(spark, {p: held[p] for p in touched if p in held}), batch)
        part = self.part_of()
        place = F.element_at(F.create_map(*[F.lit(x) for p in sorted(slot) for x in (p, slot[p])]), F.col("part"))
        rows = merged.withColumn("part", part).withColumn("slot", place).withColumn("_since", F.lit(version).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "slot").parquet(f"{self.path}/rows")
        # a part that has lost all its rows is left out of the head
        new = _read(spark, "_since bigint, part int, slot int", f"{self.path}/rows")
        places = " or ".join(f"(part = {p} and slot = {s})" for p, s in sorted(slot.items()))
        kept = [] if new is None else [r.part for r in new.filter(places).filter(F.col("_since") == version).select("part").distinct().collect()]
        valid = {**{p: v for p, v in held.items() if p not in touched}, **{p: (slot[p], version) for p in kept}}
        entries = [(version, run, batch_id, p, s, since) for p, (s, since) in valid.items()] or [(version, run, batch_id, None, None, None)]
        head = spark.createDataFrame(entries, _HEAD).coalesce(1)
        head.write.mode("overwrite").parquet(f"{self.path}/head-{version % 2}")


class KeyLog:
    """A growing table in which each key occurs once, with the keys of each part in a bitmap.

    Rows are appended by batch and part.  Whether a key may be stored is first asked of a
    Bloom filter, one 4 KB bitmap for every ``bucket`` of keys; only for keys that it
    knows, and only in their parts, are the stored keys read.
    """

    _BITS = 32768
    _TIMES = 3

    def __init__(self, path: str, schema: str, key: str, parts: int = 16, buckets: int = 64):
        self.path, self.schema, self.key, self.parts, self.buckets = path.rstrip("/"), schema, key, parts, buckets
        self.index = PartTable(f"{self.path}/index", "bucket int, bits binary", ["bucket"], 4)

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _marks(self, rows: DataFrame) -> DataFrame:
        """``key``, ``bucket`` and the ``place`` of each of its bits."""
        places = [F.pmod(F.xxhash64(self.key, F.lit(k)), F.lit(self._BITS)) for k in range(self._TIMES)]
        bucket = F.pmod(F.xxhash64(F.lit("bucket"), self.key), F.lit(self.buckets)).cast("int")
        return rows.select(self.key, bucket.alias("bucket"), F.explode(F.array(*places)).alias("place"))

    def maybe_stored(self, batch: DataFrame) -> DataFrame:
        """The keys of ``batch`` that the bitmaps know, all of those that are stored among them."""
        marks = self._marks(batch.select(self.key).distinct()).join(self.index.read(batch.sparkSession), "bucket")
        byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
        bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) != 0
        return marks.groupBy(self.key).agg(F.bool_and(bit).alias("known")).filter("known").select(self.key)

    def _stored(self, spark: SparkSession, batch_id: int, run: str) -> DataFrame | None:
        rows = _read(spark, f"{self.schema}, part int, run string, batch bigint", f"{self.path}/rows")
        return None if rows is None else rows.filter(~((F.col("run") == (run or "-")) & (F.col("batch") >= batch_id)))

    def read(self, spark: SparkSession) -> DataFrame:
        rows = _read(spark, self.schema, f"{self.path}/rows")
        return spark.createDataFrame([], self.schema) if rows is None else rows.drop("part", "run", "batch")

    def stored_keys(self, batch: DataFrame, batch_id: int, run: str = "") -> DataFrame | None:
        """Stored keys that may clash with ``batch``: of the parts only that hold keys the bitmaps know."""
        stored = self._stored(batch.sparkSession, batch_id, run)
        if stored is None:
            return None
        asked = [r.part for r in self.maybe_stored(batch).select(self.part_of().alias("part")).distinct().collect()]
        return stored.filter(F.col("part").isin(asked)).select(self.key) if asked else None

    def insert(self, batch: DataFrame, first: Callable[[DataFrame], DataFrame], batch_id: int, run: str = "") -> None:
        """Appends the rows of ``batch`` whose key is not stored; ``first`` picks one row per key."""
        new = first(batch)
        held = self.stored_keys(batch, batch_id, run)
        if held is not None:
            new = new.join(held, new[self.key].eqNullSafe(held[self.key]), "left_anti")
        rows = new.withColumns({"part": self.part_of(), "run": F.lit(run or "-"), "batch": F.lit(batch_id).cast("bigint")})
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "run", "batch").parquet(f"{self.path}/rows"))
        bits = self._marks(batch).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
        self.index.update(bits, _merged_bits, batch_id, run)


def _merged_bits(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


class HourLog:
    """Rows by the hour of their time, so that a question about a stretch of time reads its hours only."""

    def __init__(self, path: str, schema: str, ts: str):
        self.path, self.schema, self.ts = path.rstrip("/"), schema, ts

    def _hour(self, moment: Column) -> Column:
        return F.floor(F.unix_seconds(moment.cast("timestamp")) / 3600).cast("bigint")

    def append(self, rows: DataFrame, batch_id: int, run: str = "") -> None:
        """Adds the rows of a batch; rows without a time go to an hour of their own."""
        hour = F.coalesce(self._hour(F.col(self.ts)), F.lit(-1))
        rows = rows.withColumns({"hour": hour, "run": F.lit(run or "-"), "batch": F.lit(batch_id).cast("bigint")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "run", "batch").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        rows = _read(spark, self.schema, self.path)
        return spark.createDataFrame([], self.schema) if rows is None else rows.drop("hour", "run", "batch")

    def between(self, spark: SparkSession, since, until, batch_id: int, run: str = "") -> DataFrame:
        """Rows of earlier batches with a time from ``since`` to ``until``."""
        rows = _read(spark, f"{self.schema}, hour bigint, run string, batch bigint", self.path)
        if rows is None or since is None:
            return spark.createDataFrame([], self.schema)
        at = F.col(self.ts)
        inside = (at >= F.lit(since)) & (at <= F.lit(until)) & F.col("hour").between(self._hour(F.lit(since)), self._hour(F.lit(until)))
        own = (F.col("run") == (run or "-")) & (F.col("batch") >= batch_id)
        return rows.filter(inside & ~own).drop("hour", "run", "batch")
