"""Exact duplicates by a stateful stream with disk-backed state that never expires.

1. *Landing.* Texts are normalised and written once, with their SHA-256 digest, to the shared folder. A row's file
   and position there are its content locator.
2. *Stream.* A Structured Streaming query reads the landed digests and keeps, per digest, the smallest identifier
   seen with its locator and the number of rows. The state lives in RocksDB, whose snapshots and changelogs are in
   the stream's checkpoint folder; there is no watermark, so nothing expires. Rows of one digest are combined in
   each task before they are shuffled, so a text that makes up a third of all rows sends one row per task.
   Every micro-batch overwrites its own folder with the keys it touched: a replayed batch changes nothing.
3. *Check.* On every hit (a digest with more than one row) the full bytes are compared: the landed texts of those
   digests are grouped by digest and whole text. Where one digest covers several texts, the rows are grouped by
   the text itself instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import SPACE, stage, without
from kestrel.session import work_dir

#: State on disk; many small stores, so none reserves space ahead, keeps large buffers or stays open between batches.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "4",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Landed files that one micro-batch reads at most; bounds its shuffle, not the result.
BATCH_FILES = 512


def normalised(c: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACE}]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def land(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], path: str) -> DataFrame:
    """Add (id, body, digest) of ``docs`` to the files in ``path``; returns all that has landed there."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body")).withColumn("digest", digest(F.col("body")))
    rows.write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def locator() -> Column:
    return F.struct(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.row_index").alias("row"))


def fold_stream(landed: DataFrame, path: str, checkpoint: str, batch_files: int = BATCH_FILES) -> DataFrame:
    """Run the stream over the files in ``path`` that ``checkpoint`` has not seen, to their end; returns (digest,
    keep_id, keep_at, n) of the keys that it has met so far, over all runs with that checkpoint."""
    spark = landed.sparkSession
    updates = f"{checkpoint}/updates"
    was = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    # The smallest id stays: nulls last, and of rows with one id the first by locator.
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), locator().alias("at"))
    state = (spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", batch_files).parquet(path)
             .groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    schema = state.select("digest", F.col("first.id").alias("keep_id"), F.col("first.at").alias("keep_at"), "n").schema

    def put(batch: DataFrame, number: int) -> None:
        (batch.select("digest", F.col("first.id").alias("keep_id"), F.col("first.at").alias("keep_at"), "n")
         .write.mode("overwrite").parquet(f"{updates}/batch={number}"))

    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        (state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{checkpoint}/stream")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not batches(spark, updates):
        return spark.createDataFrame([], schema)
    told = spark.read.schema(schema).option("basePath", updates).parquet(f"{updates}/batch=*")
    if len(batches(spark, updates)) == 1:
        return told
    last = F.max_by(F.struct("keep_id", "keep_at", "n"), "n").alias("s")  # a key's count only grows
    return told.groupBy("digest").agg(last).select("digest", "s.*")


def batches(spark, updates: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(updates)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256,
               checkpoint: str | None = None, broadcast_digests: int = 200_000) -> DataFrame:
    """(id, digest, keep_id, group_size, kept), one row per input row.

    Texts are equal when their whole normalised bytes are; the row with the smallest id stays. Null texts are
    empty ones and equal to them. Null ids come last; of rows with one id and text the one landed first stays.
    Empty table: no rows. Other columns are not read. ``digest`` may be any function of the normalised text; a
    weak one costs time, never a wrong result. With a ``checkpoint`` folder of the caller's the landed rows and the
    state last: a later call adds its documents to those of earlier ones and returns the rows of them all.
    """
    folder = checkpoint or work_dir(docs.sparkSession, "dedup-state")
    landed = land(docs, id_col, text_col, digest, f"{folder}/landed")
    state = stage(fold_stream(landed, f"{folder}/landed", folder), "dedup-keys")
    rows = landed.select("id", "digest", "body", locator().alias("at"))

    # Full bytes on hits. Few hit digests are broadcast, so that only their texts are shuffled.
    hit = state.filter("n > 1").select("digest")
    hits = without(rows, hit, {"digest": F.col("digest")}, broadcast_digests, "left_semi")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("at").alias("at"))
    texts = hits.groupBy("digest", "body").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    clash = stage(texts.groupBy("digest").count().filter("count > 1").select("digest"), "digest-clashes")

    out = [F.col("id"), F.col("digest"), F.col("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep_at")).alias("kept")]
    if clash.isEmpty():
        return rows.select("id", "digest", "at").join(state, "digest").select(out)
    plain = without(rows.select("id", "digest", "at"), clash, {"digest": F.col("digest")}).join(state, "digest").select(out)
    split = texts.join(clash, "digest", "left_semi").select("digest", "body", F.col("first.id").alias("keep_id"), F.col("first.at").alias("keep_at"), "n")
    return plain.unionByName(hits.join(clash, "digest", "left_semi").join(split, ["digest", "body"]).select(out))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows less exact duplicates, all columns kept. Of rows with one id and equal texts one stays."""
    lost = stage(duplicates(docs, id_col, text_col).filter("NOT kept").select("id", "digest", "keep_id"), "duplicates")
    same_id = F.col("id").eqNullSafe(F.col("keep_id"))
    key = {"id": F.col(id_col), "digest": sha256(normalised(F.col(text_col)))}
    rest = without(docs, lost.filter(~same_id), key)
    twice = lost.filter(same_id).select("id", "digest").distinct()
    if twice.isEmpty():
        return rest
    one = without(rest, twice, key, how="left_semi").withColumn("_digest", key["digest"]).dropDuplicates([id_col, "_digest"])
    return without(rest, twice, key).unionByName(one.drop("_digest"))
