"""CSV export: one file with a header, whose writer does none of the work before it."""

from pyspark import TaskContext
from pyspark.sql import functions as F

from kestrel.session import work_dir
from kestrel.sources.fs import HadoopFS
from kestrel.sources.loads import export_csv


def test_one_file_written_from_rows_of_many_tasks(spark):
    path = work_dir(spark, "export") + "/csv"
    task = F.udf(lambda: TaskContext.get().taskAttemptId(), "long").asNondeterministic()
    report = spark.range(200).repartition(4, "id").select("id", F.when(F.col("id") % 2 == 0, F.lit('a,"b"')).alias("said"), task().alias("task"))
    export_csv(report, path)
    found = spark.read.option("header", True).csv(path)
    assert len([n for n in HadoopFS(spark).list_names(path) if n.startswith("part-")]) == 1
    assert found.columns == ["id", "said", "task"]
    assert sorted((int(r.id), r.said) for r in found.collect()) == [(i, None if i % 2 else 'a,"b"') for i in range(200)]
    assert found.select("task").distinct().count() == 4


def test_an_empty_report_is_a_header(spark):
    path = work_dir(spark, "export-empty") + "/csv"
    export_csv(spark.range(5).filter("id > 9"), path)
    found = spark.read.option("header", True).csv(path)
    assert found.columns == ["id"] and found.count() == 0
