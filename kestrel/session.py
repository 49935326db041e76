"""Session construction and the shared work folder.

Writes that must survive executor loss (snapshots, state tables, stream checkpoints) go under the
folder the cluster names in ``spark.checkpoint.dir``. Only when that setting is absent (local tests)
do we create one ourselves, and only on a local master.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings for a large cluster (~1000 executors, ~100 TB inputs). Shuffles start wide and AQE
# coalesces them to ~256 MB partitions; skewed partitions are split; scans split at 256 MB.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict | None = None) -> SparkSession:
    """Apply ``CLUSTER_CONF`` (runtime SQL settings) to an existing cluster session."""
    for k, v in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(k, v)
    return spark


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "kestrel") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder, scheme included.

    A private folder is set only when none is configured and the master is ``local``; anywhere else the
    executors could not see such a folder, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        root = tempfile.mkdtemp(prefix="kestrel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint root for one job's written tables.

    The folder is removed when the application ends, so nothing that must outlive it belongs there.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-work/{purpose}-{uuid.uuid4().hex[:12]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)  # deleteOnExit() takes only paths that exist
    fs.deleteOnExit(target)
    return path


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back: whatever is made of them sees the same rows, and a lost
    executor costs no earlier work."""
    path = f"{work_dir(df.sparkSession, purpose)}/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
