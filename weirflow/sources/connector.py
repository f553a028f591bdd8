"""Statements of JSON lines as a Spark data source: ``spark.read.format("statements").load(folder)``, with the option
``pushdown`` where the session pushes filters into Python sources.

Files are cut into ranges of bytes, a partition each; a line belongs to the range in which it begins. Comparisons of ``seq`` and
``day`` (the ISO date of a row's transaction) are pushed into the reader, so that rows before the look-back or the resume
index are dropped where they are read, before they are made into columns. Bad lines are rows with nothing but ``bad_line``.

Reading goes by ``pyarrow.fs``: local and mounted paths, and the stores it knows (S3, GCS, HDFS).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from weirflow.schema import RAW
from weirflow.sources.registry import Fetched, SourceAdapter, registry

#: Bytes of a partition, rows of a batch, bytes that are looked through at once for the end of a line.
SPLIT, ROWS, STEP = 64 << 20, 4096, 1 << 20
#: Columns of a row that aren't in ``schema.RAW``, and those whose comparisons the reader takes.
DAY, BAD = "day", "bad_line"
PUSHED = ("seq", DAY)
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have the package


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def _day(text: object) -> str | None:
    """yyyy-MM-dd of the first dd/MM/yy in a text, as the engine reads it; '' for none, null for null."""
    import re

    if not isinstance(text, str):
        return None
    found = re.search(r"\d\d/\d\d/\d\d", text, re.ASCII)
    return f"20{found[0][6:]}-{found[0][3:5]}-{found[0][:2]}" if found else ""


def _lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin within [start, end)."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(at) as f:
        size, pos, rest = f.size(), max(start - 1, 0), b""
        skip = start > 0  # up to the end of the line that began before
        begun = start if start == 0 else None
        while pos < size and (begun is None or begun < end):
            chunk = f.read_at(min(STEP, size - pos), pos)
            pos += len(chunk)
            rest += chunk
            while (cut := rest.find(b"\n")) >= 0:
                line, rest = rest[:cut], rest[cut + 1 :]
                if skip:
                    skip, begun = False, pos - len(rest)
                    if begun >= end:
                        return
                    continue
                yield line
                begun = pos - len(rest)
                if begun >= end:
                    return
        if rest and not skip and begun is not None and begun < end:
            yield rest


class StatementReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.split = schema, options["path"], int(options.get("split", SPLIT))
        self.filters: list[tuple[str, str, object]] = []

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(at)
        files = [found] if found.is_file else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [Range(scheme + x.path, a, min(a + self.split, x.size)) for x in sorted(files, key=lambda x: x.path) for a in range(0, x.size, self.split)]

    def _wanted(self, row: dict) -> bool:
        for name, how, value in self.filters:
            x = row.get(name)
            if x is None or not {">=": x >= value, ">": x > value, "<=": x <= value, "<": x < value, "=": x == value}[how]:
                return False
        return True

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        import json

        if part is None:  # nothing to read
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, kept = to_arrow_schema(self.schema), []
        text = [f.name for f in RAW.fields if f.name != "seq"]
        for line in _lines(part.path, part.start, part.end):
            if not line.strip():
                continue
            try:
                found = json.loads(line)
                row = {"seq": int(found["seq"])} | {c: None if found.get(c) is None else str(found[c]) for c in text}
                row[DAY] = _day(row["transaction_ts_raw"])
                if not self._wanted(row):
                    continue
            except (ValueError, TypeError, KeyError):
                if self.filters and not any(f.name == BAD for f in self.schema.fields):
                    continue
                row = {BAD: line.decode("utf-8", "replace")}
            kept.append(row)
            if len(kept) >= ROWS:
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in kind.names} for r in kept], schema=kind)
                kept = []
        if kept:
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in kind.names} for r in kept], schema=kind)


class PushingReader(StatementReader):
    """The reader for sessions that push filters: Spark refuses one that could take them where it doesn't."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Take the comparisons of ``PUSHED`` columns; whatever else there is stays with Spark."""
        taken = {GreaterThanOrEqual: ">=", GreaterThan: ">", LessThanOrEqual: "<=", LessThan: "<", EqualTo: "="}
        for f in filters:
            if type(f) in taken and f.attribute in {(c,) for c in PUSHED}:
                self.filters.append((f.attribute[0], taken[type(f)], f.value))
            else:
                yield f


class Statements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statements"

    def schema(self) -> T.StructType:
        return T.StructType([*RAW.fields, T.StructField(DAY, T.StringType()), T.StructField(BAD, T.StringType())])

    def reader(self, schema: T.StructType) -> StatementReader:
        kind = PushingReader if self.options.get("pushdown", "").lower() == "true" else StatementReader
        return kind(schema, dict(self.options))


class StatementSource(SourceAdapter):
    """An adapter over the data source: the look-back and the resume index reach the reader as filters, where the session lets
    them (``spark.sql.python.filterPushdown.enabled``); else Spark applies them after the scan."""

    name = "statements"

    def __init__(self, path: str) -> None:
        self.path = path

    def _all(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(Statements)
        return spark.read.format(Statements.name()).option("pushdown", spark.conf.get(PUSH_DOWN)).load(self.path)

    def read(self, spark: SparkSession, as_of: str, days_back: int) -> DataFrame:
        return self.fetch(spark, as_of, days_back).rows

    def fetch(self, spark: SparkSession, as_of: str, days_back: int, start_index: int = 0) -> Fetched:
        since = (date.fromisoformat(as_of) - timedelta(days=days_back)).isoformat()
        rows = self._all(spark).where((F.col("seq") >= start_index) & (F.col(DAY) >= since)).select(*RAW.fieldNames())
        bad = self._all(spark).where(F.col(BAD).isNotNull()).select(F.concat(F.lit("row skipped: "), F.substring(BAD, 1, 80)).alias("warning"))
        return Fetched(rows, bad)


registry.register(StatementSource.name, StatementSource)
