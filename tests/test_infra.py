"""Small infrastructure pieces: Hadoop FS control files, work folders, bounded broadcast."""

from pyspark.sql import functions as F

from kestrel.operators import joins as J
from kestrel.session import ensure_checkpoint_dir, work_dir
from kestrel.sources.fs import HadoopFS


def test_hadoop_fs_control_files(spark):
    fs = HadoopFS(spark)
    root = work_dir(spark, "test-fs")
    p = f"{root}/a/_CURRENT"
    assert fs.read_text(p) is None and not fs.exists(p)
    fs.mkdirs(f"{root}/a")
    fs.write_text_atomic(p, '{"v": 1}')
    fs.write_text_atomic(p, '{"v": 2}')  # replaces the file in place
    assert fs.read_text(p) == '{"v": 2}' and fs.list_names(f"{root}/a") == ["_CURRENT"]
    fs.delete(f"{root}/a")
    assert not fs.exists(p) and fs.list_names(f"{root}/a") == []


def test_work_dir_is_under_the_session_checkpoint_folder(spark):
    root = ensure_checkpoint_dir(spark)
    assert root and work_dir(spark, "x").startswith(root) and work_dir(spark, "x") != work_dir(spark, "x")


def test_cluster_conf_applies(spark):
    from kestrel.session import CLUSTER_CONF, apply_cluster_conf

    old = {k: spark.conf.get(k, None) for k in CLUSTER_CONF}
    try:
        apply_cluster_conf(spark)
        assert all(spark.conf.get(k) == v for k, v in CLUSTER_CONF.items())
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
