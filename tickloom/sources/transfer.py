"""CSV and program transfer, run-log append, number series."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import fits_broadcast
from tickloom.sources import programs

#: Rows that a file of a table partitioned by day is to hold.
ROWS_PER_FILE = 1_000_000


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Count rows as they pass by, instead of reading them a second time."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = False) -> DataFrame:
    """CSV with a given schema; a row that does not fit is an error, as is a missing path."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("header", header).csv(path)


def load_csv(spark: SparkSession, path: str, schema: str | T.StructType, target: str, header: bool = False) -> int:
    """Append a CSV to the parquet table at ``target``; returns the number of rows."""
    rows, seen = _counted(read_csv(spark, path, schema, header))
    rows.write.mode("append").parquet(target)
    return seen.get["rows"]


def export_csv(df: DataFrame, path: str, header: bool = False) -> int:
    """Write ``df`` as CSV files under a new ``path``; returns the number of rows."""
    rows, seen = _counted(df)
    rows.write.option("header", header).csv(path)
    return seen.get["rows"]


def pipe_out(df: DataFrame, command: str) -> DataFrame:
    """Feed rows as CSV lines to a program, one process per partition; its output lines come back as ``line``."""
    lines = df.select(F.to_csv(F.struct(*df.columns)).alias("line"))
    return lines.mapInArrow(programs.piped(command), "line string")


def pipe_in(lines: DataFrame, schema: str) -> DataFrame:
    """Program output lines (column ``line``) parsed as CSV rows of ``schema``; a bad line is an error."""
    parsed = F.from_csv(F.col("line"), F.lit(schema), {"mode": "FAILFAST"})
    return lines.where(F.col("line") != "").select(parsed.alias("r")).select("r.*")


def run_program(spark: SparkSession, commands: str | Sequence[str], schema: str) -> DataFrame:
    """Rows from the standard output of programs: one process, and one partition, for each command."""
    programs.register(spark)
    listed = [commands] if isinstance(commands, str) else list(commands)
    return pipe_in(spark.read.format("program").option("commands", json.dumps(listed)).load(), schema)


def keep_by_policy(log: DataFrame, policy: str) -> DataFrame:
    """Which executions are logged: 'none', 'error' (failed and not ignored), or all. Blank output becomes NULL."""
    kept = log
    if policy == "none":
        kept = log.where(F.lit(False))
    elif policy == "error":
        kept = log.where((F.col("returncode") != 0) & ~F.coalesce(F.col("ignore_error"), F.lit(False)))
    if "output" in log.columns:
        kept = kept.withColumn("output", F.nullif(F.trim("output"), F.lit("")))
    return kept


def by_day(df: DataFrame, day: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """``df`` placed so that a write partitioned by ``day`` makes files of about ``rows_per_file`` rows.

    Rows of a day are counted first: a large day is dealt over as many tasks as it
    needs files, and small days share tasks.
    """
    files = df.groupBy(day).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("__files"))
    known = files.select(F.col(day).alias("__day"), "__files")
    known = F.broadcast(known) if fits_broadcast(known) else known
    dealt = df.join(known, F.col(day).eqNullSafe(F.col("__day")))
    salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]), F.col("__files"))
    return dealt.withColumn("__salt", salt).repartition(day, "__salt").drop("__day", "__files", "__salt")


def append_run_log(log: DataFrame, target: str, policy: str = "all", rows_per_file: int = ROWS_PER_FILE) -> int:
    """Append to the run log, partitioned by day and sorted for the (chain, finish) access path."""
    placed = by_day(keep_by_policy(log, policy).withColumn("run_date", F.to_date("last_run")), "run_date", rows_per_file)
    kept, seen = _counted(placed)
    ordered = kept.sortWithinPartitions("run_date", "chain_id", "finished")
    ordered.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("run_date").parquet(target)
    return seen.get["rows"]


def compact(rows: DataFrame, target: str, day: str, order: Sequence[str] = (), rows_per_file: int = ROWS_PER_FILE) -> int:
    """Rewrite rows that lie in many small files as few per day, into a new folder; returns the number of rows."""
    placed, seen = _counted(by_day(rows, day, rows_per_file))
    placed.sortWithinPartitions(day, *order).write.option("maxRecordsPerFile", rows_per_file).partitionBy(day).parquet(target)
    return seen.get["rows"]


def series(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def id_gaps(df: DataFrame, key: str) -> DataFrame:
    """Ids between 1 and the largest one that no row has."""
    top = df.agg(F.max(key)).first()[0] or 0
    return series(df.sparkSession, 1, top, key).join(df.select(key), key, "left_anti")
