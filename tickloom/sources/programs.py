"""Programs beside Spark's tasks: as a source of lines, and as a pipe that lines go through."""

from __future__ import annotations

import json
import queue
import subprocess
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom.session import ship_by_value

#: Lines in a batch, and batches that may wait on either side of a program.
LINES, BATCHES = 4_096, 16
_WAIT_S = 0.02


def _batch(lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])


def _lines_of(process: subprocess.Popen, command: str) -> Iterator[list[str]]:
    """A program's output lines, a batch at a time; a non-zero exit code is an error."""
    lines = []
    for line in process.stdout:
        lines.append(line.removesuffix(b"\n").decode())
        if len(lines) == LINES:
            yield lines
            lines = []
    if process.wait():
        raise RuntimeError(f"{command}: exit code {process.returncode}")
    if lines:
        yield lines


def _started(command: str, stdin: int) -> subprocess.Popen:
    return subprocess.Popen(command, shell=True, stdin=stdin, stdout=subprocess.PIPE)


class _Reader(DataSourceReader):
    def __init__(self, commands: list[str]) -> None:
        self.commands = commands

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.commands]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        process = _started(partition.value, subprocess.DEVNULL)
        try:
            for lines in _lines_of(process, partition.value):
                yield _batch(lines)
        finally:
            process.kill()
            process.wait()


class ProgramSource(DataSource):
    """``line``s that programs write: option ``commands`` is a JSON list, and each command is a partition of its own."""

    @classmethod
    def name(cls) -> str:
        return "program"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["commands"]))


def register(spark: SparkSession) -> None:
    ship_by_value(__name__)
    spark.dataSource.register(ProgramSource)


def piped(command: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function that sends the ``line``s of a partition through one process and gives back its output lines.

    One thread writes to the program and one reads from it; both have a bounded queue
    to this one, which alone touches the rows that come and go. A program that writes
    before it has read all thus never blocks for ever, and memory stays bounded.
    """
    ship_by_value(__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = _started(command, subprocess.PIPE)
        sent: queue.Queue = queue.Queue(BATCHES)
        came: queue.Queue = queue.Queue(BATCHES)
        over = threading.Event()

        def hand(to: queue.Queue, item) -> None:
            while not over.is_set():
                try:
                    return to.put(item, timeout=_WAIT_S)
                except queue.Full:
                    continue

        def write() -> None:
            try:
                while (lines := sent.get()) is not None:
                    process.stdin.write("".join(f"{line}\n" for line in lines).encode())
                process.stdin.close()
            except BrokenPipeError:
                # The program has had enough; what it makes of that shows in its exit code.
                while sent.get() is not None:
                    pass

        def read() -> None:
            try:
                for lines in _lines_of(process, command):
                    hand(came, lines)
                hand(came, None)
            except Exception as e:
                hand(came, e)

        threads = [threading.Thread(target=t, daemon=True) for t in (write, read)]
        for t in threads:
            t.start()

        def outcome(item) -> pa.RecordBatch:
            if isinstance(item, Exception):
                raise item
            return _batch(item)

        def offered(item) -> Iterator[pa.RecordBatch]:
            """Put a batch into the writer's queue, taking output meanwhile."""
            while True:
                try:
                    return sent.put(item, timeout=_WAIT_S)
                except queue.Full:
                    while not came.empty() and not ended:
                        if (found := came.get()) is None:
                            ended.append(True)
                        else:
                            yield outcome(found)

        ended: list[bool] = []
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from offered(batch.column("line").to_pylist())
            yield from offered(None)
            while not ended and (found := came.get()) is not None:
                yield outcome(found)
        finally:
            over.set()
            process.kill()
            process.wait()

    return run
