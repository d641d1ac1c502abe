"""Job tables seen through the driver's parquet tables.

Each view is a list of SQL select expressions that mean the same in Spark and
in DuckDB, so a query and its oracle start from one text. ``Tables`` builds
them as DataFrames (column pruning and filters reach the parquet scan) and
``ctes`` gives the oracle its WITH list.

Two views differ from FIXTURES.md on purpose, to be safe for hot keys: ``task``
collapses repeated (order, line) pairs with a grouped aggregate instead of
numbering them inside a window, and ``parameter`` takes ``event_id + 1`` as its
order id. Neither needs a whole order or user in one task.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import work_dir

ANCHOR = "2024-01-15 00:00:00"

CHAIN = (
    "c_custkey AS chain_id",
    "c_name AS chain_name",
    "CASE c_custkey % 10 WHEN 0 THEN '*/15 8-17 * * 1,2,3,4,5' WHEN 1 THEN '40 */2 27 * *' WHEN 2 THEN '0 0 * * 7'"
    " WHEN 3 THEN '* * * * *' WHEN 4 THEN '@every 10 minutes' WHEN 5 THEN '@after 2 hours' WHEN 6 THEN '@reboot'"
    " WHEN 7 THEN '23 0-20/2 * * *' WHEN 8 THEN '61 0 * * *' ELSE NULL END AS run_at",
    "nullif(c_nationkey % 5, 0) AS max_instances",
    "CASE WHEN c_custkey % 6 = 0 THEN 5000 ELSE 0 END AS timeout",
    "c_custkey % 3 <> 0 AS live",
    "c_custkey % 11 = 0 AS self_destruct",
    "c_custkey % 13 = 0 AS exclusive_execution",
    "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('worker_', CAST(c_custkey % 4 AS STRING)) END AS client_name",
)
TASK_KEYS = ("l_orderkey", "l_linenumber")
# Letters are aggregated by their code: a numeric buffer keeps the hash aggregate.
TASK_AGGS = (
    "max(ascii(l_returnflag)) AS flag",
    "max(ascii(l_linestatus)) AS status",
    "min(l_partkey) AS partkey",
    "min(l_suppkey) AS suppkey",
)
TASK = (
    "l_orderkey * 10 + l_linenumber AS task_id",
    "l_orderkey AS chain_id",
    "CAST(10 * l_linenumber AS DOUBLE) AS task_order",
    "CASE chr(flag) WHEN 'A' THEN 'PROGRAM' WHEN 'R' THEN 'BUILTIN' ELSE 'SQL' END AS kind",
    "chr(status) AS command",
    "partkey % 5 = 0 AS ignore_error",
    "CASE WHEN suppkey % 4 = 0 THEN 2000 ELSE 0 END AS timeout",
    "partkey % 7 <> 0 AS live",
)
PARAMETER = (
    "user_id AS task_id",
    "event_id + 1 AS order_id",
    "CASE WHEN event_id % 9 = 0 THEN NULL ELSE props END AS value",
)
_WORKER = "concat('worker_', CAST(user_id % 4 AS STRING)) AS client_name"
RUN_START = (
    "event_id * 2 AS run_status_id",
    "CAST(NULL AS BIGINT) AS start_status_id",
    "user_id AS chain_id",
    "ts AS created_at",
    "'CHAIN_STARTED' AS execution_status",
    _WORKER,
)
RUN_FINISH = (
    "event_id * 2 + 1 AS run_status_id",
    "event_id * 2 AS start_status_id",
    "user_id AS chain_id",
    "ts AS created_at",
    "CASE event_type WHEN 'error' THEN 'CHAIN_FAILED' ELSE 'CHAIN_DONE' END AS execution_status",
    _WORKER,
)
FINISHED = "event_id % 10 <> 0"
SIGNAL = (
    "event_id",
    "ts",
    """CASE event_type WHEN 'signup' THEN 'no json at all' ELSE concat('{"ConfigID": ', CAST(user_id % 20 AS STRING), ', "Command": "',"""
    """ CASE event_type WHEN 'view' THEN 'DRIVE' WHEN 'error' THEN 'STOP' ELSE 'START' END, '", "Ts": ',"""
    """ CAST(CAST(floor(event_id / 5) AS BIGINT) AS STRING), ', "Delay": ', CAST(user_id % 3 AS STRING), '}') END AS payload""",
)
_FINISHED_SPARK = "ts + make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18,6)))"
_FINISHED_DUCK = "ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT))"


def _exec_log(finished: str) -> tuple[str, ...]:
    return (
        "event_id AS exec_id",
        "CAST(floor(event_id / 10) AS BIGINT) AS txid",
        "CAST(floor(event_id / 10) AS BIGINT) % 16 AS chain_id",
        "event_id % 160 AS task_id",
        "CAST(event_id % 10 AS DOUBLE) AS task_order",
        "ts AS last_run",
        f"{finished} AS finished",
        "CAST(round(value * 1000000) AS BIGINT) AS dur_us",
        "CASE WHEN event_type = 'error' THEN -1 ELSE 0 END AS returncode",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 = 0 END AS ignore_error",
        "CASE user_id % 3 WHEN 0 THEN 'SQL' WHEN 1 THEN 'PROGRAM' ELSE 'BUILTIN' END AS kind",
        "event_type AS command",
        "concat('worker_', CAST(CAST(floor(event_id / 10) AS BIGINT) % 4 AS STRING)) AS client_name",
        "props AS params",
    )


def _select(exprs, source: str, where: str = "") -> str:
    return f"SELECT {', '.join(exprs)} FROM {source}{where}"


_CTES = {
    "chain": _select(CHAIN, "customer"),
    "task": _select(
        TASK, f"(SELECT {', '.join(TASK_KEYS + TASK_AGGS)} FROM lineitem GROUP BY {', '.join(TASK_KEYS)})"
    ),
    "parameter": _select(PARAMETER, "events"),
    "run_status": _select(RUN_START, "events") + " UNION ALL " + _select(RUN_FINISH, "events", f" WHERE {FINISHED}"),
    "signal": _select(SIGNAL, "events"),
    "exec_log": _select(_exec_log(_FINISHED_DUCK), "events"),
}


def view_sql(name: str) -> str:
    """The oracle's text of one view."""
    return _CTES[name]


def ctes(*names: str, **extra: str) -> str:
    """``WITH`` list for an oracle: the named views, then further CTEs in order."""
    parts = [f"{n} AS ({_CTES[n]})" for n in names] + [f"{n} AS ({body})" for n, body in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """The driver tables of one directory and the job views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir)

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def stream(self, name: str, files_per_trigger: int | None = None) -> DataFrame:
        """The table as a file stream. The glob matches a single file and a directory alike."""
        reader = self.spark.readStream.schema(self.raw(name).schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(self.path(name) + "*")

    def arrivals(self, name: str, slice_of: str, order: Sequence[int]) -> DataFrame:
        """The table as a stream whose rows come slice by slice: those of ``order[0]`` in the first trigger, and so on.

        ``slice_of`` is an SQL expression for the number of a row's slice.
        """
        path = work_dir(self.spark, f"{name}-arrivals")
        rows = self.raw(name).withColumn("__slice", F.expr(slice_of))
        files = []
        for number in order:
            part = rows.where(F.col("__slice") == number).drop("__slice")
            part.write.mode("append").parquet(path)
            files.append(len(self.spark.read.schema(part.schema).parquet(path).inputFiles()))
        per_trigger = max(1, -(-files[-1] // len(order)))
        return self.spark.readStream.schema(self.raw(name).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)

    @property
    def chain(self) -> DataFrame:
        return self.raw("customer").selectExpr(*CHAIN)

    @property
    def task(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy(*TASK_KEYS).agg(*[F.expr(a) for a in TASK_AGGS])
        return lines.selectExpr(*TASK)

    @property
    def parameter(self) -> DataFrame:
        return self.raw("events").selectExpr(*PARAMETER)

    @property
    def exec_log(self) -> DataFrame:
        return exec_log_of(self.raw("events"))

    @property
    def run_status(self) -> DataFrame:
        return run_status_of(self.raw("events"))

    @property
    def signal(self) -> DataFrame:
        return self.raw("events").selectExpr(*SIGNAL)


def exec_log_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_exec_log(_FINISHED_SPARK))


def run_status_of(events: DataFrame) -> DataFrame:
    starts = events.selectExpr(*RUN_START)
    return starts.unionByName(events.where(FINISHED).selectExpr(*RUN_FINISH))
