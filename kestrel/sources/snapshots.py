"""Published tables: version folders behind an atomically moved pointer; slices are partitions of Spark's catalog.

Layout under a store root (inside the cluster's shared checkpoint folder):

    <root>/<table>/v=000001/             parquet files, or one folder for each slice
    <root>/<table>/v=000001-<id>/        slices that were written anew
    <root>/<table>/_CURRENT              JSON {"version": "v=000001", "previous": ..., "schema": ..., "slices": ...}

A full reload writes a new version beside the live one and moves the pointer by a rename through the Hadoop
FileSystem API (atomic on HDFS and POSIX file systems); the version before stays for readers that resolved it, and a
guard refuses an empty copy over a live table. An append adds files. Nothing is rewritten in place.

A table may be cut into slices: by month or ranges of a marker, or by hash buckets of its key. A version of it is an
external table of the session's catalog, partitioned by the slice. Upserts and range repairs write the slices they touch
to a new folder, and the catalog then takes those partitions from there (``ALTER TABLE ... PARTITION ... SET LOCATION``);
what was there before goes with the next such change. Which files belong to a table is Spark's own business
throughout: it lists, commits, prunes and counts. One job writes a table at a time, as a scheduler sees to.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import math
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.sources.fs import HadoopFS

SLICE = "_slice"
NO_SLICE = "__HIVE_DEFAULT_PARTITION__"


class GuardError(RuntimeError):
    pass


@dataclass(frozen=True)
class Slices:
    """How a table is cut: ``hash`` buckets of ``columns``, or ``month`` or ``range`` (of ``size``) of the one column.

    For hash, ``size`` is the number of buckets; choose it so that a slice is some gigabytes.
    """

    kind: str
    columns: tuple[str, ...]
    size: float = 0

    def value(self) -> Column:
        """The slice of a row; null markers have none."""
        first = F.col(self.columns[0])
        if self.kind == "hash":
            return F.concat(F.lit("h"), F.pmod(F.xxhash64(*self.columns), F.lit(int(self.size))).cast("string"))
        if self.kind == "month":
            return F.concat(F.lit("m"), F.date_format(first, "yyyy-MM"))
        return F.concat(F.lit("r"), F.floor(first / F.lit(self.size)).cast("long").cast("string"))

    def reaches(self, name: str, cutoff) -> bool:
        """Whether a slice can hold markers from ``cutoff`` on."""
        if name == NO_SLICE or self.kind == "hash":
            return True
        if self.kind == "month":
            return name[1:] >= str(cutoff)[:7]
        return int(name[1:]) >= math.floor(float(cutoff) / self.size)


def _now() -> str:
    return _dt.datetime.now(_dt.UTC).replace(tzinfo=None).isoformat()


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.fs = HadoopFS(spark)

    # ---------------------------------------------------------------- pointer
    def _dir(self, table: str) -> str:
        return f"{self.root}/{table}"

    def pointer(self, table: str) -> dict | None:
        text = self.fs.read_text(f"{self._dir(table)}/_CURRENT")
        return None if text is None else json.loads(text)

    def _move_pointer(self, table: str, meta: dict) -> None:
        self.fs.mkdirs(self._dir(table))
        self.fs.write_text_atomic(f"{self._dir(table)}/_CURRENT", json.dumps(meta))

    def versions(self, table: str) -> list[str]:
        return sorted(x for x in self.fs.list_names(self._dir(table)) if x.startswith("v=") and "-" not in x)

    def _next_version(self, table: str) -> str:
        vs = self.versions(table)
        return f"v={(int(vs[-1][2:]) if vs else 0) + 1:06d}"

    def slices(self, table: str) -> Slices | None:
        spec = (self.pointer(table) or {}).get("slices")
        return Slices(spec["kind"], tuple(spec["columns"]), spec["size"]) if spec else None

    def catalog_name(self, table: str, version: str) -> str:
        """The catalog's name of a version that is cut into slices."""
        return f"kestrel_{hashlib.sha256(self._dir(table).encode()).hexdigest()[:16]}_{version[2:]}"

    # ---------------------------------------------------------------- read
    def exists(self, table: str) -> bool:
        return self.pointer(table) is not None

    def live(self, table: str) -> str:
        return f"{self._dir(table)}/{self.pointer(table)['version']}"

    def read(self, table: str, only: Iterable[str] | None = None) -> DataFrame | None:
        """The live version with every column that it has ever got; ``only`` names the slices to read."""
        meta = self.pointer(table)
        if meta is None:
            return None
        if not meta.get("slices"):
            return self.spark.read.schema(T.StructType.fromJson(json.loads(meta["schema"]))).parquet(f"{self._dir(table)}/{meta['version']}")
        name = self.catalog_name(table, meta["version"])
        self.spark.catalog.refreshTable(name)  # a stream's batches write in a session of their own
        df = self.spark.table(name)
        return (df if only is None else df.filter(F.coalesce(F.col(SLICE), F.lit(NO_SLICE)).isin(*only))).drop(SLICE)

    def read_version(self, table: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir(table)}/{version}").drop(SLICE)

    def slice_names(self, table: str) -> list[str]:
        name = self.catalog_name(table, self.pointer(table)["version"])
        return [r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()]

    # ---------------------------------------------------------------- write
    def _observed(self, df: DataFrame, write, observe: dict | None = None) -> dict:
        """Let ``write`` write ``df``; return what was observed on the way: ``rows`` and the named aggregates."""
        obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
        write(df.observe(obs, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (observe or {}).items()]))
        try:
            return dict(obs.get)
        except Py4JJavaError:  # Spark drops the observation of a plan that turns out empty while it runs
            return {"rows": 0, **dict.fromkeys(observe or {})}

    @staticmethod
    def _dealt(df: DataFrame, slices: Slices | None, sort_within: list[str] | None) -> DataFrame:
        """Each slice is written by as many tasks as its size needs, not by every task that has rows of it."""
        if slices:
            df = df.withColumn(SLICE, slices.value()).hint("rebalance", SLICE)
        return df.sortWithinPartitions(*([SLICE] if slices else []), *(sort_within or [])) if slices or sort_within else df

    def write_version(self, table: str, df: DataFrame, sort_within: list[str] | None = None, slices: Slices | None = None,
                      observe: dict | None = None) -> tuple[str, int, dict]:
        """Write ``df`` as a new, unpublished version: (version, rows, observed), all counted during the write."""
        version = self._next_version(table)
        path = f"{self._dir(table)}/{version}"

        def write(rows: DataFrame) -> None:
            out = self._dealt(rows, slices, sort_within).write
            if slices:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.catalog_name(table, version)}")
                out.format("parquet").partitionBy(SLICE).option("path", path).saveAsTable(self.catalog_name(table, version))
            else:
                out.parquet(path)
        seen = self._observed(df, write, observe)
        return version, int(seen.pop("rows")), seen

    def discard(self, table: str, version: str) -> None:
        """Delete an unpublished version (never the live one) with all that was written for it."""
        if version != (self.pointer(table) or {}).get("version"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.catalog_name(table, version)}")
            for folder in self.fs.list_names(self._dir(table)):
                if folder == version or folder.startswith(f"{version}-"):
                    self.fs.delete(f"{self._dir(table)}/{folder}")

    def publish(self, table: str, version: str, meta: dict | None = None, slices: Slices | None = None, schema: T.StructType | None = None) -> dict:
        """Move the pointer to ``version``; the one before stays for its readers, older and failed ones go."""
        old = (self.pointer(table) or {}).get("version")
        schema = schema or self.read_version(table, version).schema
        m = {"version": version, "previous": old, "schema": schema.json(), "slices": asdict(slices) if slices else None, "published_at": _now(), **(meta or {})}
        self._move_pointer(table, m)
        for v in self.versions(table):
            if v not in (version, old):
                self.discard(table, v)
        return m

    def drop(self, table: str) -> None:
        """Unpublish: remove the pointer (readers fall back to the live path)."""
        self.fs.delete(f"{self._dir(table)}/_CURRENT", recursive=False)

    def rows(self, table: str) -> int:
        """Counted when asked, from the files' footers."""
        return self.read(table).count() if self.exists(table) else 0

    def _result(self, table: str, before: int, after: int, t0: float, **more) -> dict:
        return {"table": table, "rows_before": before, "rows_after": after, "rows_added": after - before,
                "seconds": round(time.time() - t0, 3), "status": "success", "metrics": {}, **more}

    def swap(self, table: str, df: DataFrame, guard_nonempty: bool = True, min_ratio: float | None = None, meta: dict | None = None,
             sort_within: list[str] | None = None, observe: dict | None = None, slices: Slices | None = None) -> dict:
        """Full reload: write a new copy, refuse it when it is empty (or below ``min_ratio``) over a live table with
        rows, then move the pointer. Slices stay as they were unless given."""
        before, t0, slices = self.rows(table), time.time(), slices or self.slices(table)
        version, rows, seen = self.write_version(table, df, sort_within, slices, observe)
        if before and (guard_nonempty and rows == 0 or min_ratio is not None and rows < min_ratio * before):
            self.discard(table, version)
            raise GuardError(f"refusing to publish a copy of {table} with {rows} rows over {before} live rows")
        self.publish(table, version, meta, slices, df.schema)
        return self._result(table, before, rows, t0, version=version, metrics=seen)

    def append(self, table: str, df: DataFrame, sort_within: list[str] | None = None, observe: dict | None = None,
               slices: Slices | None = None, meta: dict | None = None) -> dict:
        """Add the rows of ``df`` to the live version as further files; the first append creates the table. New columns
        are added to the table's; columns that ``df`` lacks are null."""
        if not self.exists(table):
            return self.swap(table, df, sort_within=sort_within, observe=observe, slices=slices, meta=meta)
        pointer, before, t0, now = self.pointer(table), self.rows(table), time.time(), self.read(table).schema
        new = [f for f in df.schema.fields if f.name not in now.fieldNames()]
        sliced, name = self.slices(table), self.catalog_name(table, pointer["version"])
        if sliced and new:
            self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")

        def write(rows: DataFrame) -> None:
            if not sliced:
                self._dealt(rows, None, sort_within).write.mode("append").parquet(self.live(table))
                return
            there = {c.lower() for c in rows.columns}
            whole = self.spark.table(name).drop(SLICE).schema
            every = rows.select(*[F.col(f.name) if f.name.lower() in there else F.lit(None).cast(f.dataType).alias(f.name) for f in whole.fields])
            self._dealt(every, sliced, sort_within).write.insertInto(name)
        seen = self._observed(df, write, observe)
        rows = int(seen.pop("rows"))
        if new or meta:
            self._move_pointer(table, {**pointer, "schema": T.StructType([*now.fields, *new]).json(), **(meta or {})})
        return self._result(table, before, before + rows, t0, metrics=seen)

    def replace_slices(self, table: str, touched: list[str], df: DataFrame, sort_within: list[str] | None = None) -> dict:
        """Replace the ``touched`` slices by ``df``, whose rows all belong to them; no other slice is read or written.

        ``df`` may read the table. The new slices are written to a folder of their own; only when that is complete does
        the catalog take the partitions from there, one after the other. A call that was interrupted in between is repeated.
        Files that an earlier call replaced go now, so a reader has until the next change to finish.
        """
        t0, slices, pointer = time.time(), self.slices(table), self.pointer(table)
        name, before = self.catalog_name(table, pointer["version"]), self.rows(table)
        folder = f"{self._dir(table)}/{pointer['version']}-{uuid.uuid4().hex[:12]}"
        self._observed(df, lambda rows: self._dealt(rows, slices, sort_within).write.partitionBy(SLICE).parquet(folder))
        made = {n.split("=", 1)[1] for n in self.fs.list_names(folder) if n.startswith(f"{SLICE}=")}
        replaced = [self.location(name, n) for n in touched]
        for n in touched:
            if n in made:
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({SLICE}='{n}') LOCATION '{folder}/{SLICE}={n}'")
                self.spark.sql(f"ALTER TABLE {name} PARTITION ({SLICE}='{n}') SET LOCATION '{folder}/{SLICE}={n}'")
            else:
                self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({SLICE}='{n}')")
        for path in pointer.get("replaced", []):
            self.fs.delete(path)
        self._move_pointer(table, {**pointer, "replaced": [p for p in replaced if p]})
        return self._result(table, before, self.rows(table), t0, touched=sorted(touched))

    def location(self, name: str, part: str) -> str | None:
        """Where the catalog has a slice; None if there is none."""
        if not self.spark.sql(f"SHOW PARTITIONS {name} PARTITION ({SLICE}='{part}')").collect():
            return None
        rows = self.spark.sql(f"DESCRIBE FORMATTED {name} PARTITION ({SLICE}='{part}')").collect()
        return next(r.data_type for r in rows if r.col_name == "Location")

    def append_rows(self, table: str, df: DataFrame) -> None:
        """Append-only log tables (metrics, run history, rejects): each append is a new file set."""
        df.write.mode("append").parquet(f"{self._dir(table)}/log")

    def read_log(self, table: str) -> DataFrame | None:
        p = f"{self._dir(table)}/log"
        return self.spark.read.option("mergeSchema", "true").parquet(p) if self.fs.exists(p) else None
