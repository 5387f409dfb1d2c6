"""Operators that keep state per key, with timers: silence of feeds, newest readings, late and repeated rows.

State lives in the state store (RocksDB, see ``state_settings``) and is restored from the
checkpoint after a failure, so nothing is rewritten per batch.  Each operator has a
batch form that gives the same rows: ``health.feed_changes``, ``buffers.last_readings``
and ``buffers.arrival_fate``.
"""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from perilgrid.functions import constants as K

LATENESS = "2 hours"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def state_settings() -> dict[str, str]:
    """What a session must be built with for these operators."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _moment(micros: int) -> dt.datetime:
    """A time as Python rows carry it: local to the worker and without a zone."""
    return (_EPOCH + dt.timedelta(microseconds=micros)).astimezone().replace(tzinfo=None)


def _plain(row) -> tuple:
    """A row whose times have no zone, whether it comes from the input or from the state."""
    return tuple(x.astimezone().replace(tzinfo=None) if isinstance(x, dt.datetime) and x.tzinfo else x for x in row)


# --- silence ----------------------------------------------------------------------


class _Silence(StatefulProcessor):
    """Changes of one feed's status.

    A row waits until the watermark has passed its time, then rows are taken in the
    order of their times.  So it does not matter in which order they arrive.
    """

    def __init__(self, levels: tuple[tuple[int, str], ...], names: tuple[str, ...]):
        self.levels = [(seconds * 1000000, status) for seconds, status in levels]
        self.names = names

    def init(self, handle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "at bigint, reached int")
        self.waiting = handle.getMapState("waiting", "at bigint", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = self.heard.get()[0] if self.heard.exists() else None
        for at in {r.at for r in rows}:
            if newest is None or at > newest:
                self.waiting.updateValue((at,), (1,))
                self.handle.registerTimer(-(-at // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        last, reached = self.heard.get() if self.heard.exists() else (None, 0)
        changes = []

        def silent_until(moment):
            nonlocal reached
            while last is not None and reached < len(self.levels) and last + self.levels[reached][0] <= moment:
                changes.append((last, self.levels[reached][1], last + self.levels[reached][0]))
                reached += 1

        for at in sorted(k[0] for k in self.waiting.keys() if k[0] <= upto):
            silent_until(at)
            if reached:
                changes.append((last, "ok", at))
            last, reached = at, 0
            self.waiting.removeKey((at,))
        if last is None:
            return
        silent_until(upto)
        self.heard.update((last, reached))
        if reached < len(self.levels):
            self.handle.registerTimer(-(-(last + self.levels[reached][0]) // 1000))
        for since, status, at in changes:
            yield Row(*self.names)(key[0], _moment(since), status, _moment(at))


def feed_changes_stream(
    readings: DataFrame, key: str = "sensor_id", ts: str = "reading_ts", levels: tuple[tuple[int, str], ...] = K.FEED_LEVELS, lateness: str = LATENESS
) -> DataFrame:
    """``key``, ``since``, ``status``, ``changed_at``: each change of a feed's status, as soon as the watermark passes it.

    A feed falls silent by event time, so some feed must go on: rows without a key are
    clock ticks that only move the watermark (union the feed with a ``rate``
    source to get them).
    """
    clock = readings.select(key, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, lateness)
    rows = clock.filter(F.col(ts).isNotNull()).select(F.coalesce(F.col(key), F.lit("")).alias(key), ts, F.unix_micros(ts).alias("at"))
    out = f"{key} string, since timestamp, status string, changed_at timestamp"
    changes = rows.groupBy(key).transformWithState(_Silence(levels, (key, "since", "status", "changed_at")), out, "append", "EventTime")
    return changes.filter(F.col(key) != "")


def provider_changes_stream(images: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The same for image providers: silent after two hours."""
    return feed_changes_stream(images, "provider", "received_at", K.PROVIDER_LEVELS, lateness)


# --- newest readings --------------------------------------------------------------


class _Newest(StatefulProcessor):
    """The newest readings of a region, newest first; older ones are evicted."""

    def __init__(self, n: int, schema: StructType, ts: int, tie: int, ttl_ms: int | None):
        self.n, self.schema, self.ts, self.tie, self.ttl_ms = n, schema, ts, tie, ttl_ms

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", self.schema, self.ttl_ms)
        self.row = Row(*self.schema.fieldNames(), "recency")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        def newer(r):
            return (r[self.ts] is not None, r[self.ts] or dt.datetime.min, r[self.tie] is not None, r[self.tie] or 0)

        held = self.kept.get() if self.kept.exists() else ()
        best = heapq.nlargest(self.n, (_plain(r) for some in (held, rows) for r in some), key=newer)
        self.kept.put(best)
        for place, r in enumerate(best):
            yield self.row(*r, place + 1)


def last_readings_stream(
    readings: DataFrame, n: int = K.BUFFER_SIZE, ts: str = "reading_ts", tie: str = "reading_id", key: str = "region_id", ttl_ms: int | None = None
) -> DataFrame:
    """The whole buffer of every region that the batch touches, with ``recency``; run it in update mode.

    The buffer is a list in the state store.  ``ttl_ms`` lets go of a region that has been idle for that long.
    """
    schema = readings.schema
    processor = _Newest(n, schema, schema.fieldNames().index(ts), schema.fieldNames().index(tie), ttl_ms)
    out = StructType(list(schema.fields)).add("recency", "integer")
    return readings.groupBy(key).transformWithState(processor, out, "update", "ProcessingTime" if ttl_ms else "None")


# --- late and repeated rows -------------------------------------------------------


class _Fate(StatefulProcessor):
    """Tells late, repeated and first rows of one feed apart, in the order of arrival."""

    def __init__(self, lateness_s: int, names: list[str]):
        self.lateness, self.names = lateness_s * 1000000, names

    def init(self, handle) -> None:
        self.clock = handle.getValueState("clock", "at bigint")
        self.seen = handle.getMapState("seen", "id string, at bigint", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = self.clock.get()[0] if self.clock.exists() else None
        rows, out = [tuple(r) for r in rows], Row(*self.names)
        # the last three columns are arrival, time and id
        rows.sort(key=lambda r: [(x is not None, x if x is not None else 0) for x in r[-3:]])
        for r in rows:
            arrived, at, name = r[-3:]
            mark = (name if name is not None else "\0", at if at is not None else -(2**62))
            if at is not None and clock is not None and at < clock - self.lateness:
                fate = "late"
            elif self.seen.containsKey(mark):
                fate = "repeated"
            else:
                fate = "kept"
                self.seen.updateValue(mark, (1,))
            if at is not None and (clock is None or at > clock):
                clock = at
            yield out(*r[:-3], fate)
        if clock is not None:
            self.clock.update((clock,))
            # what is older than this is late, whether it has been seen or not
            for mark in [k for k in self.seen.keys() if -(2**62) < k[1] < clock - self.lateness]:
                self.seen.removeKey(mark)


def arrival_fate_stream(
    rows: DataFrame, key: str, id_col: str, ts: str, arrived: str, lateness_s: int = K.LATENESS_SECONDS
) -> DataFrame:
    """Every row with its ``fate``: ``kept``, ``late`` or ``repeated``; no row is lost.

    A row is late if its time is more than ``lateness_s`` before the greatest time that
    its feed (``key``) had shown when it arrived.  It is repeated if a row of the feed with
    the same id and time has been kept before.  ``arrived`` gives the order; a
    source that hands over rows in that order gives the same as the batch form.
    """
    extra = {"_arrived": _micros(arrived), "_at": _micros(ts), "_name": F.col(id_col).cast("string")}
    wide = rows.withColumn("_key", F.col(key).cast("string")).withColumns(extra)
    wide = wide.select(F.coalesce("_key", F.lit("\0")).alias("_key"), *rows.columns, *extra)
    out = StructType([wide.schema["_key"], *rows.schema.fields]).add("fate", "string")
    return wide.groupBy("_key").transformWithState(_Fate(lateness_s, out.fieldNames()), out, "append", "None").drop("_key")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))
