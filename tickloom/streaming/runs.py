"""Streams: run a query to the end of its input, settings for state, log ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.session import work_dir
from tickloom.sources.entries import FLUSH

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode query over all input there is, into files of the shared folder; returns them as a batch."""
    spark = stream.sparkSession
    base = work_dir(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def drain_to_end(
    rows: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], label: str, beyond_s: int
) -> DataFrame:
    """Run ``build(rows)`` over all input there is, then close what waits for a later time; the results as a batch.

    Beside its own input the query reads a folder for closing rows: empty at first,
    then with one row that has a time ``beyond_s`` past the newest one, and nothing
    else. Both runs share a checkpoint, so state and output are those of one query.
    Needs event-time state, and runs with the RocksDB state store.
    """
    spark = rows.sparkSession
    base = work_dir(spark, label)
    closing = f"{base}/closing"
    spark.createDataFrame([], rows.schema).write.parquet(closing)

    def run() -> list[str]:
        """Run to the end; the newest time and the watermark that were reached."""
        both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(closing))
        query = (
            build(both).writeStream.format("parquet").outputMode("append")
            .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        times = [p["eventTime"] for p in query.recentProgress]
        return [t[k] for t in times for k in ("max", "watermark") if k in t]

    def both_runs() -> None:
        reached = max(run(), default=None)
        if reached:
            at = F.lit(reached).cast("timestamp") + F.make_dt_interval(secs=F.lit(beyond_s))
            last = [(at if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]
            spark.range(1).select(*last).write.mode("append").parquet(closing)
            run()

    with_rocksdb(spark, both_runs, no_data_batches=True)
    return spark.read.schema(build(rows).schema).parquet(f"{base}/rows")


def with_rocksdb(spark, run, no_data_batches: bool = False):
    """Call ``run`` with the RocksDB state store, and put the settings back afterwards.

    State that expires by the clock asks for one more batch for ever, so a query that ends with its input would never end:
    it runs without batches that have no data. Event-time timers need those batches to fire at the end.
    """
    settings = {_PROVIDER: _ROCKSDB, _NO_DATA_BATCHES: str(no_data_batches).lower()}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored_log(entries: DataFrame, threshold: str) -> DataFrame:
    """Log entries (ts, client_name, pid, level, message, data) above a threshold, in stored form, with their flush if they have one."""
    level = F.col("level")
    return entries.where(text.level_kept(level, threshold)).select(
        "ts", "client_name", "pid", text.stored_level(level).alias("log_level"), "message", F.col("data").alias("message_data"),
        *[c for c in entries.columns if c == FLUSH],
    )


def ingest_log(entries: DataFrame, target: str, checkpoint: str, threshold: str = "info", trigger: dict | None = None):
    """Start appending log entries to ``target`` in small batches (every two seconds by default).

    A batch is written under its own batch id, so one that is retried after a
    failure replaces itself instead of being stored twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stored_log(batch, threshold).withColumn("log_date", F.to_date("ts")).write.mode("overwrite").partitionBy(
            "log_date"
        ).parquet(f"{target}/batch={batch_id}")

    return (
        entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"})).start()
    )


