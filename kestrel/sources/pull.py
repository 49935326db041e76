"""A pull source: tables that an extractor lands as Arrow segments, read by cursor and time-window predicates.

Spark has no reader for Arrow IPC files, the format that Arrow-speaking clients of live databases hand over. The data source
``kestrel_pull`` reads and writes them through Spark's Python data source API:

- *Segments.* A writing task makes one file; its record batches carry the least and greatest value of each column as
  their own metadata. A file gets its final name when the whole job commits, so readers never see a part of a load.
- *Pushed filters.* Comparisons, IN and null tests reach the source (``pushFilters``). Planning leaves out batches whose
  bounds exclude them; what is read is filtered in Arrow before a row enters Spark, so Spark repeats nothing.
- *Planned partitions.* A partition is a run of batches of one file, at most ``rowsPerPartition`` rows.
- *Streams.* The offset is the cursor: the greatest marker (or pair of day and time) that has landed. A micro-batch
  holds the rows above the last offset up to the next, so Spark's checkpoint alone owns the cursor. ``overlap`` reads
  again from so far below it, for markers that land late; those rows come twice and want a dedup by key.

Options: ``path``; ``marker``: one column, or ``day,time``; ``overlap``: a number, or seconds for times;
``rowsPerPartition``; ``rowsPerBatch`` (writing). Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import sys
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

FORMAT = "kestrel_pull"
SUFFIX = ".arrow"
ROWS_PER_PARTITION = 1 << 20
ROWS_PER_BATCH = 1 << 16

# Values in offsets and bounds: how they are written to JSON and read back.
PACKED: tuple[tuple[str, type, Any], ...] = (
    ("bool", bool, bool), ("long", int, int), ("double", float, float), ("decimal", decimal.Decimal, decimal.Decimal),
    ("timestamp", dt.datetime, dt.datetime.fromisoformat), ("date", dt.date, dt.date.fromisoformat), ("text", str, str))

Test = tuple[str, str, Any]  # operator, column, value
COMPARED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def packed(value) -> list | None:
    if value is None:
        return None
    kind = next(k for k, t, _ in PACKED if isinstance(value, t))
    return [kind, value if kind in ("bool", "long", "double", "text") else str(value)]


def unpacked(stored):
    return None if stored is None else next(read for k, _, read in PACKED if k == stored[0])(stored[1])


def as_test(f: D.Filter) -> Test | None:
    """The filter as a test on one top-level column; None if the source doesn't evaluate it."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = f.attribute[0]
    if any(isinstance(v, float) and v != v for v in (getattr(f, "value", None) if isinstance(f, D.In) else [getattr(f, "value", None)])):
        return None  # NaN equals itself in Spark only
    if type(f) in COMPARED:
        return COMPARED[type(f)], column, f.value
    if isinstance(f, D.In):
        return "in", column, tuple(f.value)
    if isinstance(f, (D.IsNull, D.IsNotNull)):
        return "null" if isinstance(f, D.IsNull) else "not null", column, None
    return None


def may_hold(test: Test, bounds: dict) -> bool:
    """Whether a batch with these bounds (column: [least, greatest, nulls]) can hold a row that passes."""
    op, column, value = test
    if column not in bounds:
        return True
    low, high, nulls = (unpacked(bounds[column][0]), unpacked(bounds[column][1]), bounds[column][2])
    if op == "null":
        return nulls > 0
    if low is None:  # nulls only
        return False
    if op == "in":
        return any(v is not None and low <= v <= high for v in value)
    return {"=": lambda: low <= value <= high, ">": lambda: high > value, ">=": lambda: high >= value, "<": lambda: low < value,
            "<=": lambda: low <= value, "not null": lambda: True}[op]()


def expression(tests: list[Test], schema: pa.Schema) -> pc.Expression | None:
    """All tests as one Arrow expression."""
    out = None
    for op, column, value in tests:
        field, kind = pc.field(column), schema.field(column).type
        if op in ("null", "not null"):
            one = field.is_null() if op == "null" else field.is_valid()
        elif op == "in":
            one = field.isin(pa.array(value, kind))
        else:
            v = pa.scalar(value, kind)
            one = {"=": field == v, ">": field > v, ">=": field >= v, "<": field < v, "<=": field <= v}[op]
            if pa.types.is_floating(kind) and op in (">", ">="):
                one = one | field.is_nan()  # the greatest of all, in Spark
        out = one if out is None else out & one
    return out


def bounds_of(batch: pa.RecordBatch) -> dict:
    """Least and greatest value and number of nulls of each column that has an order (of a float, no NaN)."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        kind = column.type
        if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind) or pa.types.is_date(kind) or pa.types.is_timestamp(kind) or pa.types.is_string(kind):
            if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
                continue
            if pa.types.is_string(kind) and pc.max(pc.binary_length(column)).as_py() not in range(257):
                continue  # bounds stay small; nulls only have none
            ends = pc.min_max(column).as_py()
            out[name] = [packed(ends["min"]), packed(ends["max"]), column.null_count]
    return out


class Segments:
    """The landed files of one table."""

    def __init__(self, path: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)

    def files(self) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(SUFFIX) and not f.base_name.startswith("_"))

    def open(self, file: str) -> pa.ipc.RecordBatchFileReader:
        local = isinstance(self.fs, pyarrow.fs.LocalFileSystem)
        return pa.ipc.open_file(pa.memory_map(file) if local else self.fs.open_input_file(file))

    def schema(self) -> pa.Schema:
        files = self.files()
        if not files:
            raise FileNotFoundError(f"no segments in {self.root}; give the reader a schema")
        return self.open(files[0]).schema

    def batches(self) -> Iterator[tuple[str, int, int, dict]]:
        """(file, batch, rows, bounds) of all that has landed."""
        for file in self.files():
            reader = self.open(file)
            for i in range(reader.num_record_batches):
                batch, meta = reader.get_batch_with_custom_metadata(i)
                yield file, i, batch.num_rows, json.loads(meta[b"bounds"]) if meta and b"bounds" in meta else {}

    def plan(self, tests: list[Test], rows_per_partition: int) -> list[tuple[str, list[int]]]:
        """(file, batches) for each partition: batches that can hold a row, in runs of bounded rows."""
        out: list[tuple[str, list[int]]] = []
        held = 0
        for file, i, rows, bounds in self.batches():
            if all(may_hold(t, bounds) for t in tests):
                if out and out[-1][0] == file and held + rows <= rows_per_partition:
                    out[-1][1].append(i)
                    held += rows
                else:
                    out.append((file, [i]))
                    held = rows
        return out

    def read(self, file: str, batches: list[int], tests: list[Test], pair: tuple | None = None) -> Iterator[pa.RecordBatch]:
        reader = self.open(file)
        where = expression(tests, reader.schema)
        if pair is not None:
            where = pair_range(*pair, reader.schema) if where is None else where & pair_range(*pair, reader.schema)
        for i in batches:
            found = pa.Table.from_batches([reader.get_batch(i)])
            yield from (found if where is None else found.filter(where)).to_batches()

    def greatest(self, marker: list[str]) -> list | None:
        """The greatest marker that has landed (a pair: by day, then time); None if there is none."""
        known = [(unpacked(b[marker[0]][1]), file, i) for file, i, _, b in self.batches() if marker[0] in b and b[marker[0]][1] is not None]
        if not known:
            return None
        top = max(k for k, _, _ in known)
        if len(marker) == 1:
            return [top]
        # of the batches that reach the last day, the greatest time on it
        times = [pc.max(t.column(marker[1])).as_py() for k, file, i in known if k == top
                 for t in self.read(file, [i], [("=", marker[0], top), ("not null", marker[1], None)])]
        return [top, max((t for t in times if t is not None), default=None)]


def pair_range(columns: list[str], after: list | None, upto: list, schema: pa.Schema) -> pc.Expression:
    """``after < (day, time) <= upto``; a null time of a day counts as before all of its times."""
    day, time = (pc.field(c) for c in columns)
    value = lambda c, v: pa.scalar(v, schema.field(c).type)

    def at_most(bound):
        d, t = bound
        on_day = (time <= value(columns[1], t)) | time.is_null() if t is not None else time.is_null()
        return (day < value(columns[0], d)) | ((day == value(columns[0], d)) & on_day)
    out = day.is_valid() & at_most(upto)
    return out if after is None else out & ~pc.coalesce(at_most(after), pc.scalar(False))


class PullReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.segments, self.tests = Segments(options["path"]), []
        self.rows, self.names = int(options.get("rowsPerPartition", ROWS_PER_PARTITION)), schema.fieldNames()

    def pushFilters(self, filters):
        for f in filters:
            test = as_test(f)
            if test is None or test[1] not in self.names:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        return [D.InputPartition(p) for p in self.segments.plan(self.tests, self.rows)] or [D.InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            for batch in self.segments.read(*partition.value, self.tests):
                yield batch.select(self.names)


class PullStream(D.DataSourceStreamReader):
    """The offset is {"cursor": the greatest marker taken, or null}."""

    def __init__(self, options: dict, schema: T.StructType):
        if "marker" not in options:
            raise ValueError("a stream needs the option marker: the column that grows, or day,time")
        self.segments, self.marker, self.names = Segments(options["path"]), [c.strip() for c in options["marker"].split(",")], schema.fieldNames()
        if not 1 <= len(self.marker) <= 2 or any(c not in self.names for c in self.marker):
            raise ValueError(f"marker must name one or two columns, not {options['marker']!r}")
        self.rows, self.overlap = int(options.get("rowsPerPartition", ROWS_PER_PARTITION)), float(options.get("overlap", 0))
        if self.overlap and len(self.marker) == 2:
            raise ValueError("overlap goes with a marker of one column")

    def initialOffset(self):
        return {"cursor": None}

    def latestOffset(self):
        top = self.segments.greatest(self.marker)
        return {"cursor": None if top is None else [packed(v) for v in top]}

    def partitions(self, start, end):
        after, upto = (None if o["cursor"] is None else [unpacked(v) for v in o["cursor"]] for o in (start, end))
        if upto is None:
            return [D.InputPartition(None)]
        if len(self.marker) == 2:
            tests = [("<=", self.marker[0], upto[0])] + ([(">=", self.marker[0], after[0])] if after else [])
            pair = (self.marker, after, upto)
        else:
            tests, pair = [("<=", self.marker[0], upto[0])], None
            if after is not None:
                low = after[0] - (dt.timedelta(seconds=self.overlap) if isinstance(after[0], dt.date) else type(after[0])(self.overlap)) if self.overlap else after[0]
                tests.append((">=" if self.overlap else ">", self.marker[0], low))
        return [D.InputPartition((*p, tests, pair)) for p in self.segments.plan(tests, self.rows)] or [D.InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            for batch in self.segments.read(*partition.value):
                yield batch.select(self.names)


class Landed(D.WriterCommitMessage):
    def __init__(self, pending: str | None, final: str | None):
        self.pending, self.final = pending, final


class PullWriter(D.DataSourceArrowWriter):
    """Each task lands one segment under a name that readers pass over; the commit of the job gives all their final names."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("segments are only added to: use mode append")
        self.path, self.rows = options["path"], int(options.get("rowsPerBatch", ROWS_PER_BATCH))

    def write(self, iterator):
        segments, name = Segments(self.path), uuid.uuid4().hex + SUFFIX
        segments.fs.create_dir(segments.root)
        pending, sink, writer = f"{segments.root}/_{name}", None, None
        for batch in iterator:
            if writer is None:
                sink = segments.fs.open_output_stream(pending)
                writer = pa.ipc.new_file(sink, batch.schema)
            for at in range(0, batch.num_rows, self.rows):
                part = batch.slice(at, self.rows)
                writer.write_batch(part, custom_metadata={"bounds": json.dumps(bounds_of(part))})
        if writer is None:
            return Landed(None, None)
        writer.close()
        sink.close()
        return Landed(pending, f"{segments.root}/{name}")

    def commit(self, messages):
        fs = Segments(self.path).fs
        for m in messages:
            if m is not None and m.pending:
                fs.move(m.pending, m.final)

    def abort(self, messages):
        fs = Segments(self.path).fs
        for m in messages:
            if m is not None and m.pending:
                fs.delete_file(m.pending)


class PullSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return from_arrow_schema(Segments(self.options["path"]).schema(), prefer_timestamp_ntz=True)

    def reader(self, schema):
        return PullReader(self.options, schema)

    def streamReader(self, schema):
        return PullStream(self.options, schema)

    def writer(self, schema, overwrite):
        return PullWriter(self.options, overwrite)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let Spark hand it filters."""
    spark.dataSource.register(PullSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def land(df: DataFrame, path: str, **options) -> None:
    """Add the rows of ``df`` to the table of segments at ``path``, all at once."""
    register(df.sparkSession)
    writer: DataFrameWriter = df.write.format(FORMAT).mode("append").option("path", path)
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.save()


def pull(spark: SparkSession, path: str, **options) -> DataFrame:
    """The table at ``path``; filters on it are pushed to the segments."""
    register(spark)
    reader = spark.read.format(FORMAT).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def pull_stream(spark: SparkSession, path: str, marker: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """The table at ``path`` as a stream whose offset is the cursor on ``marker`` (a column, or "day,time")."""
    register(spark)
    reader = spark.readStream.format(FORMAT).option("path", path).option("marker", marker)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return (reader.schema(schema) if schema is not None else reader).load()
