"""Log entries as a stream that flushes by size or by time, whichever comes first.

A flush waits until ``FLUSH_ROWS`` entries are there or ``FLUSH_S`` seconds have
passed, and takes what is there, never more than ``FLUSH_ROWS``. Entries lie in the
row order of a folder of Parquet files, taken by name; files may be added behind
those. The position is a file, a row in it and the number of flushes so far, kept in the
query's checkpoint, so a query that starts again goes on from there. A trigger takes one
flush (``read_entries``), or all that are full, each row with its flush's number
(``read_flushes``). The driver reads only the files' numbers of rows; the entries are read by
tasks, a row group each.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tickloom.session import ship_by_value

# How many entries are flushed at once, and after how many seconds a smaller number is.
FLUSH_ROWS, FLUSH_S = 500, 2.0
_POLL_S = 0.05
#: Column with the number of an entry's flush, from 0.
FLUSH = "flush"


@dataclass
class _Piece(InputPartition):
    """Rows ``first`` to ``last`` (not included) of a row group; the first one is entry ``at`` of its trigger."""

    file: str
    group: int
    first: int
    last: int
    at: int
    flush: int


class _Entries(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], rows: int, seconds: float, one: bool) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.columns, self.rows, self.seconds, self.one = columns, rows, seconds, one
        self.groups: dict[str, list[int]] = {}
        self.at = {"file": "", "row": 0, "flush": 0}

    def initialOffset(self) -> dict:
        return self.at

    def _files(self) -> list[str]:
        if self.fs.get_file_info(self.path).type == pafs.FileType.File:
            return [self.path]
        found = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".parquet") and not os.path.basename(f.path).startswith(("_", ".")))

    def _groups(self, file: str) -> list[int]:
        """Rows of each row group of a file."""
        if file not in self.groups:
            with pq.ParquetFile(self.fs.open_input_file(file)) as table:
                meta = table.metadata
                self.groups[file] = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
        return self.groups[file]

    def _waiting(self, start: dict) -> list[tuple[str, int, int]]:
        """(file, first row, rows of the file) of all that comes after ``start``."""
        return [
            (file, start["row"] if file == start["file"] else 0, sum(self._groups(file)))
            for file in self._files() if file >= start["file"]
        ]

    def _after(self, start: dict, most: int, flushes: int, waiting: list[tuple[str, int, int]]) -> dict:
        """The position ``most`` entries after ``start``."""
        at, left = start, most
        for file, first, rows in waiting:
            take = min(left, rows - first)
            if take > 0:
                at, left = {"file": file, "row": first + take}, left - take
        return {**at, "flush": start.get("flush", 0) + flushes}

    def latestOffset(self) -> dict:
        until = time.monotonic() + self.seconds
        while True:
            waiting = self._waiting(self.at)
            n = sum(rows - first for _, first, rows in waiting)
            full = min(n // self.rows, 1) if self.one else n // self.rows
            if full:
                return self._after(self.at, full * self.rows, full, waiting)
            if time.monotonic() >= until:
                # A position moves only with entries, or a trigger without any would run.
                return self._after(self.at, n, 1, waiting) if n else self.at
            time.sleep(_POLL_S)

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        # Called before the next ``latestOffset``, also when a query starts again (then for an empty range).
        self.at, pieces, taken = end, [], 0
        if start == end:
            return pieces
        for file, begin, rows in self._waiting(start):
            if file > end["file"]:
                break
            stop, first = (end["row"] if file == end["file"] else rows), 0
            for group, n in enumerate(self._groups(file)):
                low, high = max(begin, first), min(stop, first + n)
                if low < high:
                    pieces.append(_Piece(file, group, low - first, high - first, taken, start.get("flush", 0)))
                    taken += high - low
                first += n
        return pieces

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        with pq.ParquetFile(self.fs.open_input_file(partition.file)) as table:
            first = 0
            for batch in table.iter_batches(row_groups=[partition.group], columns=[c for c in self.columns if c != FLUSH]):
                low, high = max(partition.first, first), min(partition.last, first + len(batch))
                if low < high:
                    yield self._shaped(batch.slice(low - first, high - low), partition, partition.at + low - partition.first)
                first += len(batch)
                if first >= partition.last:
                    break

    def _shaped(self, batch: pa.RecordBatch, partition: _Piece, at: int) -> pa.RecordBatch:
        """The columns in order, times in microseconds; ``at`` is the first row's number in its trigger."""

        def column(name: str) -> pa.Array:
            if name == FLUSH:
                numbers = pa.array(range(at, at + len(batch)), pa.int64())
                return pc.add(pc.divide(numbers, self.rows), partition.flush)
            values = batch.column(name)
            return values.cast(pa.timestamp("us", values.type.tz)) if pa.types.is_timestamp(values.type) else values

        return pa.RecordBatch.from_arrays([column(c) for c in self.columns], names=self.columns)


class EntrySource(DataSource):
    """Stream of the Parquet rows in ``path``, by triggers of ``rows`` or ``seconds``."""

    @classmethod
    def name(cls) -> str:
        return "entries"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["columns"]))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        rows, seconds = int(self.options.get("rows", FLUSH_ROWS)), float(self.options.get("seconds", FLUSH_S))
        names = schema.fieldNames()
        return _Entries(self.options["path"], names, rows, seconds, self.options["one"] == "true")


def _read(spark: SparkSession, path: str, schema: T.StructType, rows: int, seconds: float, one: bool) -> DataFrame:
    ship_by_value(__name__)
    spark.dataSource.register(EntrySource)
    uri = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"
    return (
        spark.readStream.format("entries").option("path", uri).option("columns", schema.json())
        .option("rows", rows).option("seconds", seconds).option("one", one).load()
    )


def read_entries(spark: SparkSession, path: str, schema: T.StructType, rows: int = FLUSH_ROWS, seconds: float = FLUSH_S) -> DataFrame:
    """The entries under ``path`` (a file or a folder) as a stream with a trigger for each flush."""
    return _read(spark, path, schema, rows, seconds, True)


def read_flushes(spark: SparkSession, path: str, schema: T.StructType, rows: int = FLUSH_ROWS, seconds: float = FLUSH_S) -> DataFrame:
    """The entries under ``path`` with the number of their flush (``flush``); a trigger takes all flushes that are full.

    What is less than a flush waits, and goes as one when ``seconds`` have passed. ``schema`` has no column of that name.
    """
    return _read(spark, path, T.StructType([*schema.fields, T.StructField(FLUSH, T.LongType())]), rows, seconds, False)
