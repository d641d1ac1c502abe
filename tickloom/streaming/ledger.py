"""Counts and open starts that stay whole however late a row comes.

Both are kept by a query that hands each trigger's rows to Spark's batch
operators. Nothing waits for a watermark, so no row is ever too late to count:
counts are sums, and a trigger appends its own share of them; open starts are a
table that each trigger replaces. A trigger that is tried again after a failure
replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.binding import micros
from tickloom.operators import runlog

#: How far behind the latest finish a minute counts as closed.
LATENESS_S = 60
COUNTS = "minute timestamp_ntz, total bigint, errors bigint, ignored_errors bigint, late boolean"
EDGE = "start_id bigint, chain_id bigint, client_name string, moment timestamp, is_start boolean"


class Snapshot:
    """A table that each trigger replaces, in two folders by turns: the last one stays whole while the next is written."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def after(self, spark: SparkSession, batch_id: int | None) -> DataFrame:
        """The table as that trigger left it; empty before the first one."""
        if batch_id is None or batch_id < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/turn={batch_id % 2}")

    def replace(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/turn={batch_id % 2}")


def start(rows: DataFrame, each, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hand each trigger's rows to ``each(rows, batch id)``; by default until the input is used up."""
    return (
        rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def last_batch(query: StreamingQuery) -> int | None:
    """Number of the last trigger that had rows, of this run or an earlier one on the same checkpoint."""
    return query.lastProgress["batchId"] if query.lastProgress else None


# --- minute counts -----------------------------------------------------------


def count_minutes(log: DataFrame, base: str, lateness_s: int = LATENESS_S, trigger: dict | None = None) -> StreamingQuery:
    """Start counting the runs of a log by the minute they finished in, into ``base``.

    A trigger appends one row per minute it has rows of. The row is late if the
    minute was closed by then: if a run that finished ``lateness_s`` after its end had
    been seen by an earlier trigger. Late rows lie beside the others; ``minutes`` merges them.
    """
    seen = Snapshot(f"{base}/seen", "until bigint")

    def add(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        until = seen.after(spark, batch_id - 1).first()
        closed = until["until"] - lateness_s * 1_000_000 if until and until["until"] is not None else None
        end = micros(F.col("minute")) + 60_000_000
        share = runlog.minute_counts(rows).withColumn("late", F.lit(False) if closed is None else end <= F.lit(closed))
        share.write.mode("overwrite").parquet(f"{base}/counts/batch={batch_id}")
        newest = rows.agg(F.max(micros(F.col("finished"))).alias("newest"))
        seen.replace(newest.select(F.greatest("newest", F.lit(until["until"] if until else None).cast("bigint")).alias("until")), batch_id)

    return start(log, add, f"{base}/state", trigger)


def minutes(spark: SparkSession, base: str, closed_by: str | None = None) -> DataFrame:
    """Counts per minute, late rows merged into them: of all minutes, or of those that end by a given time.

    ``late`` says how many rows of a minute came after it had been closed.
    """
    shares = spark.read.schema(COUNTS).parquet(f"{base}/counts")
    if closed_by is not None:
        shares = shares.where(F.col("minute") + F.expr("INTERVAL 1 MINUTE") <= F.lit(closed_by).cast("timestamp_ntz"))
    return shares.groupBy("minute").agg(
        *[F.sum(c).alias(c) for c in ("total", "errors", "ignored_errors")],
        F.sum(F.when(F.col("late"), F.col("total")).otherwise(0)).alias("late"),
    )


# --- open starts -------------------------------------------------------------


def start_edges(status: DataFrame) -> DataFrame:
    """Starts and finishes among status rows, each under the id of its start."""
    is_start = F.col("start_status_id").isNull()
    return status.select(
        F.when(is_start, F.col("run_status_id")).otherwise(F.col("start_status_id")).alias("start_id"),
        "chain_id", "client_name", F.col("created_at").cast("timestamp").alias("moment"), is_start.alias("is_start"),
    )


def _unsettled(edges: DataFrame, patience_s: int) -> DataFrame:
    """Starts without a finish in time, and finishes whose start has not come yet."""
    run = Window.partitionBy("start_id")
    started = F.min(F.when(F.col("is_start"), F.col("moment"))).over(run)
    waited = micros(F.col("moment")) - micros(F.col("started"))
    in_time = F.max(~F.col("is_start") & waited.between(0, patience_s * 1_000_000)).over(run)
    marked = edges.withColumn("started", started).withColumn("settled", F.coalesce(in_time, F.lit(False)))
    left = F.when(F.col("started").isNull(), ~F.col("is_start")).otherwise(F.col("is_start") & ~F.col("settled"))
    return marked.where(left).select(*edges.columns)


def track_starts(edges: DataFrame, base: str, patience_s: int, trigger: dict | None = None) -> StreamingQuery:
    """Start keeping, in ``base``, the starts that have no finish within ``patience_s`` so far.

    A finish may come before its start or long after it. What is kept is one row per
    open start and per finish without a start, however many runs there have been.
    """
    waiting = Snapshot(f"{base}/waiting", EDGE)

    def settle(rows: DataFrame, batch_id: int) -> None:
        known = waiting.after(rows.sparkSession, batch_id - 1).unionByName(rows)
        waiting.replace(_unsettled(known, patience_s), batch_id)

    return start(edges, settle, f"{base}/state", trigger)


def dead_starts(spark: SparkSession, base: str, batch_id: int | None, patience_s: int, now: str | None = None) -> DataFrame:
    """Starts that are dead after that trigger: those open for longer than ``patience_s``, or at the end of the input all."""
    left = Snapshot(f"{base}/waiting", EDGE).after(spark, batch_id).where("is_start")
    if now is not None:
        left = left.where(micros(F.col("moment")) + patience_s * 1_000_000 < micros(F.lit(now).cast("timestamp")))
    return left.select(F.col("start_id").alias("start_status_id"), "chain_id", "client_name", F.lit("DEAD").alias("execution_status"))
