"""Small-file operations on the cluster file system (HDFS, object stores, local) via Hadoop's API.

Used for the few control files a job owns (snapshot pointers, cursors) and for listing version
folders; table data is always written and read by Spark itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class HadoopFS:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return bool(self._fs(path).exists(self._path(path)))

    def mkdirs(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def list_names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return [st.getPath().getName() for st in self._fs(path).listStatus(self._path(path))]

    def is_dir(self, path: str) -> bool:
        return self.exists(path) and bool(self._fs(path).getFileStatus(self._path(path)).isDirectory())

    def delete(self, path: str, recursive: bool = True) -> None:
        if self.exists(path):
            self._fs(path).delete(self._path(path), recursive)

    def read_text(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self._fs(path).open(self._path(path))
        try:
            reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            lines = []
            line = reader.readLine()
            while line is not None:
                lines.append(line)
                line = reader.readLine()
            return "\n".join(lines)
        finally:
            stream.close()

    def write_text_atomic(self, path: str, text: str) -> None:
        """Write beside the target, then rename over it (atomic on HDFS and POSIX file systems)."""
        parent = path.rsplit("/", 1)[0]
        tmp = f"{parent}/._tmp.{uuid.uuid4().hex}"
        out = self._fs(tmp).create(self._path(tmp), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        opts = self._gateway.new_array(rename, 1)
        opts[0] = rename.OVERWRITE
        fc = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._conf)
        fc.rename(self._path(tmp), self._path(path), opts)
