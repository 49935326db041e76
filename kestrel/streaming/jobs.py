"""Structured Streaming jobs: validated ingest, incremental insert-if-absent, cross-batch dedup.

All three are ``readStream`` over a landing folder -> ``foreachBatch``. Each micro-batch is an
ordinary DataFrame, so the same batch operators apply. Sinks are idempotent per batch id (a replay
after executor or driver loss re-inserts nothing: insert-if-absent by key), and the checkpoint lives
in the shared checkpoint folder. ``trigger(availableNow=True)`` processes what has landed and stops,
which is how a scheduled poll runs; a long-running job uses ``processingTime`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kestrel.sources import ingest as I
from kestrel.sources.loads import insert_new
from kestrel.sources.pull import pull_stream
from kestrel.sources.snapshots import Slices, SnapshotStore


def run(writer, available_now: bool, poll: str = "30 seconds") -> StreamingQuery:
    """Start the query: over what has landed, until that is done; or for good, polling, and return at once."""
    if not available_now:
        return writer.trigger(processingTime=poll).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def pull_stream_to(spark: SparkSession, source: str, marker: str, out: str, checkpoint: str, schema: T.StructType | None = None,
                   available_now: bool = True, **options) -> StreamingQuery:
    """The pull source at ``source`` -> parquet files at ``out``. The cursor on ``marker`` is the stream's offset: it lies
    in the checkpoint and nowhere else. Spark's file sink takes each micro-batch once, so a batch that is replayed after
    a lost driver adds nothing."""
    src = pull_stream(spark, source, marker, schema, **options)
    return run(src.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), available_now)


def inbound_stream(spark: SparkSession, landing: str, fields: list[I.Field], out_dir: str, checkpoint: str, record_key: str = "record_id",
                   bytes_per_batch: int = 16 << 30, available_now: bool = True) -> StreamingQuery:
    """JSON-lines records (record_id, payload) -> accepted table and dead-letter table (both appended).

    A micro-batch takes files up to ``bytes_per_batch`` (one at least). ``available_now=False`` starts a query that
    runs until it is stopped."""
    schema = T.StructType([T.StructField(record_key, T.StringType()), T.StructField("payload", T.StringType())])
    src = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).json(landing)

    def batch(df: DataFrame, batch_id: int) -> None:
        # each batch owns its folder and overwrites it: a replay of the same batch id after a
        # failure rewrites the same rows instead of adding them again (exactly-once output)
        v = I.validate(df, fields).persist()
        I.accepted(v, fields, keep=[record_key]).write.mode("overwrite").parquet(f"{out_dir}/accepted/batch={batch_id}")
        I.rejected(v, record_key).write.mode("overwrite").parquet(f"{out_dir}/rejected/batch={batch_id}")
        v.unpersist()

    return run(src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), available_now)


def incremental_stream(spark: SparkSession, landing: str, schema: T.StructType, store: SnapshotStore, table: str, key: list[str],
                       order_by: list[str] | None, checkpoint: str, bytes_per_batch: int = 16 << 30, slices: int = 8,
                       available_now: bool = True) -> StreamingQuery:
    """Landed delta files -> insert-if-absent: a batch looks its keys up in the hash slices that can hold them and appends
    only its new rows. The batch's own files are the written delta."""
    src = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(landing)

    def batch(df: DataFrame, batch_id: int) -> None:
        insert_new(store, table, df, key, order_by, Slices("hash", tuple(key), slices), meta={"batch_id": batch_id}, written=True)

    return run(src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), available_now)


def dedup_stream(spark: SparkSession, landing: str, schema: T.StructType, store: SnapshotStore, table: str,
                 key: list[str], checkpoint: str, **how) -> StreamingQuery:
    """Duplicates inside a batch and across batches are absorbed by key (exact: unbounded key set kept
    in the target table, not in state store memory)."""
    return incremental_stream(spark, landing, schema, store, table, key, None, checkpoint, **how)


def dedup_within_watermark(df: DataFrame, key: list[str], ts_col: str, delay: str = "1 hour") -> DataFrame:
    """Bounded-state alternative for streams whose duplicates arrive within ``delay`` of each other.

    Watermarks need a zoned TIMESTAMP; a TIMESTAMP_NTZ event time is cast into a helper column (a
    uniform shift by the session zone, which does not change which rows fall within the delay).
    """
    if dict(df.dtypes)[ts_col] == "timestamp_ntz":
        et = "_kestrel_event_time"
        return (df.withColumn(et, F.col(ts_col).cast("timestamp")).withWatermark(et, delay)
                .dropDuplicatesWithinWatermark(key).drop(et))
    return df.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(key)
