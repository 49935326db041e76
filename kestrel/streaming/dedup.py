"""Streaming dedup with bounded state: keyed state, event-time timers and expiry (``transformWithState``)."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

AT, EVENT_TIME, KEY, GROUP = "_kestrel_at", "_kestrel_event_time", "_kestrel_key", "_kestrel_group"

# Groups that keys are hashed to, unless the caller names another number.
GROUPS = 1 << 12

# What the state needs: RocksDB, which keeps the keys on local disk and its snapshots in the checkpoint.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# A key's JSON keeps the microseconds and offsets of its times, and its nulls.
KEY_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


class QuietPeriod(StatefulProcessor):
    """Keeps a row unless its key was seen within ``quiet`` microseconds of it.

    A call of the processor costs some milliseconds, whatever it gets; so Spark's key is a group of keys. State of a group:
    the event time of the last sighting of each of its keys. The group's timer, at the end of the quiet period that ends first,
    removes keys once the watermark says that no row of that time can come any more, and is set anew for the rest."""

    def __init__(self, quiet: int, names: list[str]):
        self.quiet, self.names = quiet, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.MapType(T.StringType(), T.LongType()))]))

    def due(self, at: int) -> int:
        """The first millisecond at which a sighting at ``at`` no longer counts."""
        return (at + self.quiet) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.last.get()
        last = dict(stored[0]) if stored is not None else {}
        changed = False
        rows = list(rows)
        fields = rows[0].__fields__
        at_i, key_i, taken = fields.index(AT), fields.index(KEY), [fields.index(c) for c in self.names]
        made = Row(*self.names)
        rows.sort(key=lambda r: (r[at_i] is not None, r[at_i] or 0))  # the micro-batch's rows of these keys
        for row in rows:
            at, k = row[at_i], row[key_i]
            if at is None:  # without a time there is nothing to compare
                yield made(*[row[i] for i in taken])
                continue
            was = last.get(k)
            if was is None or abs(at - was) > self.quiet:
                yield made(*[row[i] for i in taken])
            if was is None or at > was:
                last[k] = at
                changed = True
        if changed:
            self.last.update((last,))
            if stored is None:  # else the group has its timer
                self.handle.registerTimer(self.due(min(last.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored, now = self.last.get(), timerValues.getCurrentWatermarkInMs()
        last = {k: at for k, at in stored[0].items() if self.due(at) > now} if stored is not None else {}
        if last:
            if len(last) < len(stored[0]):
                self.last.update((last,))
            self.handle.registerTimer(self.due(min(last.values())))
        else:
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def key_json(df: DataFrame, key: list[str]) -> Column:
    """A text that two rows share if ``groupBy(*key)`` would put them together; 0.0 and -0.0 are one key."""
    floats = {c for c, kind in df.dtypes if kind in ("float", "double")}
    return F.to_json(F.struct(*[(F.col(c) + F.lit(0).cast("float") if c in floats else F.col(c)).alias(c) for c in key]), KEY_JSON)


def dedup_quiet(df: DataFrame, key: list[str], ts_col: str, quiet: dt.timedelta, lateness: str, groups: int = GROUPS) -> DataFrame:
    """The stream less rows whose key was seen within ``quiet`` of them, in event time.

    Rows of a micro-batch are taken in the order of their times, so what is kept does not depend on how they are dealt
    out; each sighting, dropped ones included, begins the quiet period anew. Rows later than ``lateness`` behind the
    greatest time are dropped by the watermark, which is also when a key's state may go. Null keys are a key like any
    other, and rows without a time are kept. State grows with the keys of one quiet period, not with the stream.

    Keys are hashed to ``groups`` groups, which changes nothing in the rows. A micro-batch reads and writes the state of
    each group it has rows of, so a group should hold some hundred keys of a quiet period; tasks beyond ``groups`` get
    nothing. A checkpoint belongs to its number of groups.
    """
    for k, v in STATE_CONF.items():
        df.sparkSession.conf.set(k, v)
    # A watermark needs a zoned time; reading a TIMESTAMP_NTZ in the session's zone shifts all rows alike.
    event = F.col(ts_col).cast("timestamp")
    timed = df.withColumn(EVENT_TIME, event).withColumn(AT, F.unix_micros(EVENT_TIME)).withWatermark(EVENT_TIME, lateness)
    grouped = timed.withColumn(KEY, key_json(df, key)).withColumn(GROUP, F.pmod(F.xxhash64(KEY), F.lit(groups)))
    return grouped.groupBy(GROUP).transformWithState(QuietPeriod(quiet // dt.timedelta(microseconds=1), df.columns), df.schema, "append", "eventtime")


def dedup_quiet_stream(spark: SparkSession, landing: str, schema: T.StructType, out: str, key: list[str], ts_col: str, quiet: dt.timedelta, lateness: str,
                       checkpoint: str, bytes_per_batch: int = 16 << 30, available_now: bool = True, groups: int = GROUPS):
    """Landed parquet files -> :func:`dedup_quiet` -> parquet files at ``out``, each micro-batch once."""
    from kestrel.streaming.jobs import run

    src = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(landing)
    writer = dedup_quiet(src, key, ts_col, quiet, lateness, groups).writeStream.format("parquet").option("path", out)
    return run(writer.option("checkpointLocation", checkpoint), available_now)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
