"""Sources and sinks (S1-S5, S7). Files go to a fresh path in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans.registry import query
from tickloom.session import work_dir
from tickloom.sources import transfer
from tickloom.sources.fixtures import ctes

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query("s01_load_csv", ORDERS)
def s01(t):
    """Orders out to CSV, and loaded back into a table with a given schema."""
    orders = t.raw("orders")
    csv, table = work_dir(t.spark, "s01-csv"), work_dir(t.spark, "s01-table")
    transfer.export_csv(orders, csv)
    transfer.load_csv(t.spark, csv, orders.schema, table)
    return t.spark.read.parquet(table)


@query("s02_export_csv", "SELECT count(*) AS exported, count(*) AS lines FROM lineitem")
def s02(t):
    """Rows reported by the export against lines really written."""
    path = work_dir(t.spark, "s02-csv")
    exported = transfer.export_csv(t.raw("lineitem"), path)
    return t.spark.read.text(path).agg(F.lit(exported).cast("bigint").alias("exported"), F.count(F.lit(1)).alias("lines"))


@query("s03_pipe_out", "SELECT upper(concat(c_custkey, ',', c_mktsegment)) AS line FROM customer")
def s03(t):
    """Rows through the standard input of a program, its output as lines."""
    return transfer.pipe_out(t.raw("customer").select("c_custkey", "c_mktsegment"), "tr a-z A-Z")


@query("s04_pipe_in", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def s04(t):
    """Program output parsed back into typed rows."""
    lines = transfer.pipe_out(t.raw("orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "cat")
    return transfer.pipe_in(lines, "o_orderkey bigint, o_orderstatus string, o_custkey bigint")


@query(
    "s04_program_rows",
    "SELECT n AS l_orderkey FROM (SELECT unnest(range(1, (SELECT max(o_orderkey) FROM orders) + 1)) AS n) WHERE n NOT IN (SELECT l_orderkey FROM lineitem)",
)
def s04_program(t):
    """Rows that programs write, each counting a part of the order keys: those without a line."""
    top, parts = t.raw("orders").agg(F.max("o_orderkey")).first()[0] or 0, t.spark.sparkContext.defaultParallelism
    step = max(1, -(-top // parts))
    counted = transfer.run_program(t.spark, [f"seq {i} {min(i + step - 1, top)}" for i in range(1, top + 1, step)], "l_orderkey bigint")
    return counted.join(t.raw("lineitem"), "l_orderkey", "left_anti")


@query(
    "s05_run_log_append",
    ctes("exec_log")
    + """SELECT exec_id, chain_id, returncode, nullif(trim(params), '') AS output FROM exec_log
    WHERE returncode <> 0 AND NOT coalesce(ignore_error, false)""",
)
def s05(t):
    """Only failures that are not ignored reach the log under the 'error' policy."""
    target = work_dir(t.spark, "s05-log")
    transfer.append_run_log(t.exec_log.withColumn("output", F.concat(F.lit(" "), "params")), target, "error")
    return t.spark.read.parquet(target).select("exec_id", "chain_id", "returncode", "output")


@query(
    "s05_compacted_log",
    ctes("exec_log") + "SELECT exec_id, chain_id, CAST(last_run AS DATE) AS run_date, 1 AS files_of_day FROM exec_log",
)
def s05_compacted(t):
    """The run log, appended in four parts and compacted: all rows, one file for a day of up to a million."""
    target, compacted = work_dir(t.spark, "s05-parts"), work_dir(t.spark, "s05-compacted")
    for part in range(4):
        transfer.append_run_log(t.exec_log.where(F.col("exec_id") % 4 == part), target)
    transfer.compact(t.spark.read.parquet(target), compacted, "run_date", ["chain_id", "finished"])
    rows = t.spark.read.parquet(compacted).withColumn("file", F.input_file_name())
    files = rows.groupBy("run_date").agg(F.count_distinct("file").cast("int").alias("files_of_day"))
    return rows.join(files, "run_date").select("exec_id", "chain_id", "run_date", "files_of_day")


@query(
    "s07_series",
    "SELECT n AS l_orderkey FROM (SELECT unnest(range(1, (SELECT max(l_orderkey) FROM lineitem) + 1)) AS n) WHERE n NOT IN (SELECT l_orderkey FROM lineitem)",
)
def s07(t):
    """Order keys in the series 1..max without a single line."""
    return transfer.id_gaps(t.raw("lineitem"), "l_orderkey")
