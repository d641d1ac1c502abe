"""Run-log analytics: filters, aggregates, windows and top-k (A, F10-F15, J11, L2, W3-W6, W9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import runlog
from tickloom.plans.registry import at, query
from tickloom.sources.fixtures import ANCHOR, ctes, view_sql

CLIENTS = ("worker_1", "worker_2")
START, END = "2024-01-08 00:00:00", "2024-01-22 00:00:00"
IN_RANGE = f"last_run BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND client_name IN ('worker_1', 'worker_2')"
BAD = "returncode <> 0 AND NOT coalesce(ignore_error, false)"

SESSIONS = "SELECT s_suppkey AS client_pid, s_suppkey + 1000 AS server_pid, concat('worker_', CAST(s_nationkey AS STRING)) AS client_name FROM supplier"

RUNS = {
    "agg": f"""SELECT chain_id, txid, min(client_name) AS client_name, min(last_run) AS started,
        max(finished) AS last_finished, min(task_order) FILTER ({BAD}) AS failed_order,
        arg_min(finished, task_order) FILTER ({BAD}) AS bad_finished FROM exec_log GROUP BY chain_id, txid""",
    "r": """SELECT chain_id, txid, client_name, started, coalesce(bad_finished, last_finished) AS finished, failed_order,
        CASE WHEN failed_order IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS outcome FROM agg""",
}
SPANS = {
    "sp": """SELECT chain_id, txid, min(client_name) AS client_name, min(last_run) AS started, max(finished) AS finished
        FROM exec_log GROUP BY chain_id, txid""",
}


def ranged(t):
    return runlog.in_range(t.exec_log, at(START), at(END), CLIENTS)


def sessions(t):
    return t.raw("supplier").selectExpr(
        "s_suppkey AS client_pid", "s_suppkey + 1000 AS server_pid",
        "concat('worker_', CAST(s_nationkey AS STRING)) AS client_name",
    )


@query("a01_total_chains", ctes("chain") + "SELECT count(*) AS n FROM chain")
def a01(t):
    return runlog.row_count(t.chain)


@query(
    "a02_enabled_chains",
    ctes("chain") + "SELECT count(*) AS n FROM chain WHERE live AND client_name IS NULL OR client_name IN ('worker_1', 'worker_2')",
)
def a02(t):
    return runlog.enabled_chains(t.chain, CLIENTS)


@query("a03_task_executions", ctes("exec_log") + f"SELECT count(*) AS n FROM exec_log WHERE {IN_RANGE}")
def a03(t):
    return runlog.row_count(ranged(t))


@query("a04_task_errors", ctes("exec_log") + f"SELECT count(*) AS n FROM exec_log WHERE {IN_RANGE} AND {BAD}")
def a04(t):
    return runlog.row_count(ranged(t).where(runlog.is_error()))


@query(
    "a05_avg_duration",
    ctes("exec_log")
    + f"""SELECT round(CAST(sum(epoch_us(finished) - epoch_us(last_run)) AS DOUBLE) / count(*) / 1e6, 6) AS avg_seconds
    FROM exec_log WHERE {IN_RANGE} AND returncode = 0""",
)
def a05(t):
    return runlog.average_duration(ranged(t))


@query("a06_schedulers_running", ctes(sess=SESSIONS) + "SELECT count(DISTINCT client_name) AS n FROM sess")
def a06(t):
    return runlog.distinct_count(sessions(t), "client_name")


@query("a07_client_picker", ctes("exec_log") + "SELECT DISTINCT client_name FROM exec_log")
def a07(t):
    return runlog.distinct_values(t.exec_log, "client_name")


MINUTES_SQL = (
    ctes("exec_log")
    + f"""SELECT date_trunc('minute', finished) AS minute, count(*) AS total, count(*) FILTER ({BAD}) AS errors,
    count(*) FILTER (returncode <> 0 AND ignore_error) AS ignored_errors FROM exec_log GROUP BY 1"""
)


@query("a08_minute_counts", MINUTES_SQL)
def a08(t):
    return runlog.minute_counts(t.exec_log)


@query(
    "a09_run_report",
    ctes("exec_log")
    + """SELECT chain_id, txid, count(*) FILTER (returncode = 0) AS success, count(*) FILTER (returncode <> 0) AS fail,
    count(*) AS total, round(100.0 * CAST(count(*) FILTER (returncode = 0) AS DOUBLE) / greatest(count(*), 1), 6) AS ratio
    FROM exec_log GROUP BY chain_id, txid""",
)
def a09(t):
    return runlog.run_report(t.exec_log)


@query("a14_chain_started", ctes("exec_log", **RUNS) + "SELECT client_name, count(*) AS n FROM r GROUP BY 1")
def a14(t):
    return runlog.started_by_client(runlog.chain_runs(t.exec_log))


@query(
    "a15_chain_completed",
    ctes("exec_log", **RUNS) + "SELECT client_name, count(*) AS n FROM r WHERE outcome = 'COMPLETED' GROUP BY 1",
)
def a15(t):
    return runlog.outcome_by_client(runlog.chain_runs(t.exec_log), "COMPLETED")


@query(
    "a16_chain_failed",
    ctes("exec_log", **RUNS) + "SELECT client_name, count(*) AS n FROM r WHERE outcome = 'FAILED' GROUP BY 1",
)
def a16(t):
    return runlog.outcome_by_client(runlog.chain_runs(t.exec_log), "FAILED")


@query(
    "a17_task_executed",
    ctes("exec_log")
    + """SELECT client_name, kind, count(*) AS n FROM (SELECT DISTINCT client_name, kind, chain_id, txid, task_id, task_order
    FROM exec_log) GROUP BY 1, 2""",
)
def a17(t):
    return runlog.executed_by_kind(t.exec_log)


@query(
    "a18_duration_histogram",
    ctes("exec_log", **RUNS)
    + """SELECT client_name, CAST(CASE WHEN us <= 1000 THEN 0 WHEN us <= 10000 THEN 1 WHEN us <= 100000 THEN 2 WHEN us <= 500000 THEN 3
    WHEN us <= 1000000 THEN 4 WHEN us <= 5000000 THEN 5 WHEN us <= 10000000 THEN 6 WHEN us <= 30000000 THEN 7
    WHEN us <= 60000000 THEN 8 WHEN us <= 120000000 THEN 9 WHEN us <= 300000000 THEN 10 ELSE 11 END AS INT) AS bucket,
    count(*) AS n, CAST(sum(us) AS BIGINT) AS sum_us
    FROM (SELECT client_name, epoch_us(finished) - epoch_us(started) AS us FROM r WHERE outcome = 'COMPLETED') GROUP BY 1, 2""",
)
def a18(t):
    return runlog.duration_histogram(runlog.chain_runs(t.exec_log))


@query(
    "a18_step_histogram",
    ctes("exec_log")
    + """SELECT client_name, CAST(CASE WHEN us <= 1000 THEN 0 WHEN us <= 10000 THEN 1 WHEN us <= 100000 THEN 2 WHEN us <= 500000 THEN 3
    WHEN us <= 1000000 THEN 4 WHEN us <= 5000000 THEN 5 WHEN us <= 10000000 THEN 6 WHEN us <= 30000000 THEN 7
    WHEN us <= 60000000 THEN 8 WHEN us <= 120000000 THEN 9 WHEN us <= 300000000 THEN 10 ELSE 11 END AS INT) AS bucket,
    count(*) AS n, CAST(sum(us) AS BIGINT) AS sum_us
    FROM (SELECT client_name, dur_us AS us FROM exec_log WHERE returncode = 0) GROUP BY 1, 2""",
)
def a18_steps(t):
    """The same buckets over one-step runs, which reach the small bounds as well."""
    steps = t.exec_log.select(
        "client_name", F.col("last_run").alias("started"), "finished",
        F.when(F.col("returncode") == 0, "COMPLETED").otherwise("FAILED").alias("outcome"),
    )
    return runlog.duration_histogram(steps)


@query(
    "a19_weekly_report",
    """SELECT TIMESTAMP '1998-10-12' AS report_week, round(sum(o_totalprice), 2) AS total_sales, count(*) AS total_orders
    FROM orders WHERE o_orderdate >= TIMESTAMP '1998-10-05' AND o_orderdate < TIMESTAMP '1998-10-12'""",
)
def a19(t):
    """Sum and count of the calendar week before the one that holds 'today'."""
    this_week = F.date_trunc("week", at("1998-10-14 00:00:00")).cast("timestamp_ntz")
    last_week = (this_week - F.expr("INTERVAL 7 DAYS")).cast("timestamp_ntz")
    day = F.col("o_orderdate")
    return (
        t.raw("orders").where((day >= last_week) & (day < this_week))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("total_sales"), F.count(F.lit(1)).alias("total_orders"))
        .select(this_week.alias("report_week"), "total_sales", "total_orders")
    )


@query("a20_status_flag", ctes(sess=SESSIONS) + "SELECT CASE WHEN count(*) > 0 THEN 'OK' ELSE 'FAIL' END AS status FROM sess")
def a20(t):
    return sessions(t).agg(F.when(F.count(F.lit(1)) > 0, "OK").otherwise("FAIL").alias("status"))


@query(
    "a21_load_audit",
    """SELECT 'order load' AS process_name, DATE '2024-01-15' AS process_date, count(*) AS rows_processed, 'SUCCESS' AS status
    FROM orders WHERE o_totalprice > 0""",
)
def a21(t):
    return t.raw("orders").where("o_totalprice > 0").agg(F.count(F.lit(1)).alias("rows_processed")).select(
        F.lit("order load").alias("process_name"), F.to_date(at(ANCHOR)).alias("process_date"),
        "rows_processed", F.lit("SUCCESS").alias("status"),
    )


@query(
    "a22_retry_statistics",
    ctes("exec_log")
    + f"""SELECT chain_id, client_name, count(*) AS retries, max(finished) AS last_failure FROM exec_log WHERE returncode <> 0
    AND finished BETWEEN TIMESTAMP '{ANCHOR}' - INTERVAL 7 DAY AND TIMESTAMP '{ANCHOR}' - INTERVAL 10 SECOND GROUP BY 1, 2""",
)
def a22(t):
    return runlog.retry_statistics(t.exec_log, at(ANCHOR), 7 * 86_400, 10)


@query(
    "f10_timeout_breaches",
    ctes("chain", "exec_log")
    + """SELECT exec_id, chain_id, dur_us, limit_ms FROM exec_log JOIN (SELECT chain_id, coalesce(nullif(timeout, 0), 60000) AS limit_ms
    FROM chain) c USING (chain_id) WHERE dur_us > limit_ms * 1000""",
)
def f10(t):
    return runlog.timeout_breaches(t.exec_log, t.chain, global_ms=60_000)


@query(
    "f11_level_map",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'INFO'
    WHEN 'signup' THEN 'PANIC' ELSE 'UNKNOWN' END AS log_level, event_type IN ('error', 'view', 'signup') AS kept FROM events""",
)
def f11(t):
    """Event types stand for logger levels: click = debug, view = warning, signup = fatal, purchase = none known."""
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "error").when(kind == "click", "debug").when(kind == "view", "warning")
        .when(kind == "signup", "fatal").otherwise("42")
    )
    return t.raw("events").select(
        "event_id", text.stored_level(level).alias("log_level"), text.level_kept(level, "info").alias("kept")
    )


@query(
    "f12_ident_label",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR)
    ELSE concat(CAST(c_custkey AS VARCHAR), '|', c_name) END AS label FROM customer""",
)
def f12(t):
    name = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))
    return t.raw("customer").select("c_custkey", text.ident(F.col("c_custkey"), name).alias("label"))


@query("f13_range_and_client", ctes("exec_log") + f"SELECT exec_id, last_run, client_name FROM exec_log WHERE {IN_RANGE}")
def f13(t):
    return ranged(t).select("exec_id", "last_run", "client_name")


@query(
    "f14_clean_rows",
    "SELECT o_orderkey, o_custkey, upper(trim(o_orderpriority)) AS priority, round(o_totalprice, 2) AS amount FROM orders WHERE o_totalprice > 0",
)
def f14(t):
    return t.raw("orders").where("o_totalprice > 0").select(
        "o_orderkey", "o_custkey", F.upper(F.trim("o_orderpriority")).alias("priority"), F.round("o_totalprice", 2).alias("amount")
    )


@query("f15_recent_slice", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' - INTERVAL 1 DAY")
def f15(t):
    """Rows since the day before 'today', refused if there are none."""
    today = at("2001-07-01 00:00:00")
    recent = t.raw("orders").where(F.col("o_orderdate") >= (today - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz"))
    return text.require_rows(recent, "no data extracted for processing")


@query(
    "l02_latest_errors",
    ctes("exec_log")
    + """SELECT CAST(round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(finished)) / 1e6) AS BIGINT) AS finished_ago, last_run AS started_on,
    exec_id, client_name, chain_id, task_id, command, returncode FROM exec_log
    WHERE returncode <> 0 AND NOT ignore_error ORDER BY finished DESC, exec_id DESC LIMIT 50""",
)
def l02(t):
    return runlog.latest_errors(t.exec_log, at("2024-01-31 00:00:00"))


@query(
    "w03_retry_backoff",
    ctes(
        "exec_log",
        f="""SELECT exec_id, chain_id, client_name, epoch_us(finished) AS moment FROM exec_log WHERE returncode <> 0""",
        g="""SELECT *, count(*) OVER w AS retries, max(moment) OVER w AS last_at FROM f
        WINDOW w AS (PARTITION BY chain_id, client_name ORDER BY moment RANGE BETWEEN 86400000000 PRECEDING AND 10000000 PRECEDING)""",
    )
    + """SELECT exec_id, chain_id, client_name, retries, CASE WHEN retries < 3 THEN coalesce(2 * (moment - last_at), 10000000) END AS delay_us FROM g""",
)
def w03(t):
    return runlog.retry_backoff(t.exec_log, max_retries=3, min_wait_s=10, max_duration_s=86_400)


@query(
    "w04_chain_outcome",
    ctes("exec_log", **RUNS) + "SELECT chain_id, txid, client_name, started, finished, failed_order, outcome FROM r",
)
def w04(t):
    return runlog.chain_runs(t.exec_log)


@query(
    "w04_step_status",
    ctes("exec_log", **RUNS)
    + """SELECT e.chain_id, e.txid, task_order, exec_id, CASE WHEN task_order > failed_order THEN 'skipped'
    WHEN returncode <> 0 AND NOT coalesce(ignore_error, false) THEN 'failed' WHEN returncode <> 0 THEN 'ignored' ELSE 'ok' END AS status
    FROM exec_log e JOIN r ON r.chain_id = e.chain_id AND r.txid = e.txid AND r.client_name IS NOT DISTINCT FROM e.client_name""",
)
def w04_steps(t):
    return runlog.step_status(t.exec_log)


EDGES = {
    "edge": """SELECT chain_id, started AS moment, 1 AS d FROM x WHERE finished > started
        UNION ALL SELECT chain_id, finished, -1 FROM x WHERE finished > started""",
    "net": "SELECT chain_id, moment, sum(d) AS d FROM edge GROUP BY 1, 2",
    "prof": "SELECT chain_id, moment, CAST(sum(d) OVER (PARTITION BY chain_id ORDER BY moment) AS BIGINT) AS running FROM net",
}
STEP_SPANS = {"x": "SELECT chain_id, last_run AS started, finished FROM exec_log"}


def step_spans(t):
    return t.exec_log.select("chain_id", F.col("last_run").alias("started"), "finished")


@query("w05_concurrency_profile", ctes("exec_log", **STEP_SPANS, **EDGES) + "SELECT chain_id, moment, running FROM prof")
def w05(t):
    return runlog.concurrency_profile(step_spans(t))


@query("w05_peak", ctes("exec_log", **STEP_SPANS, **EDGES) + "SELECT chain_id, max(running) AS peak FROM prof GROUP BY 1")
def w05_peak(t):
    return runlog.peak_concurrency(step_spans(t))


# The sequential fold itself, one attempt per chain and step; the state is a list of unfinished admitted runs.
ADMISSION_SQL = """WITH RECURSIVE attempt AS (
    SELECT e.chain_id, exec_id, e.client_name AS c, epoch_us(last_run) AS s, epoch_us(finished) AS f, coalesce(max_instances, 16) AS cap,
     row_number() OVER (PARTITION BY e.chain_id ORDER BY last_run, exec_id) AS rn
    FROM ({exec_log}) e JOIN ({chain}) k ON k.chain_id = e.chain_id),
  fold AS (
    SELECT DISTINCT chain_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS exec_id, CAST(NULL AS BOOLEAN) AS admitted,
     CAST([] AS STRUCT(f BIGINT, c VARCHAR, h BOOLEAN)[]) AS st FROM attempt
    UNION ALL
    SELECT chain_id, rn, exec_id, ok, CASE WHEN ok THEN list_append(live, {{'f': f, 'c': c, 'h': true}}) ELSE live END FROM (
      SELECT *, cap IS NULL OR len(list_filter(live, lambda e: e.h)) < cap AS ok FROM (
        SELECT a.*, list_transform(list_filter(p.st, lambda e: e.f > a.s), lambda e: {{'f': e.f, 'c': e.c,
          'h': e.h AND NOT list_contains(list_transform(list_filter(p.st, lambda d: d.f <= a.s), lambda d: d.c), e.c)}}) AS live
        FROM fold p JOIN attempt a ON a.chain_id = p.chain_id AND a.rn = p.rn + 1)))
  SELECT chain_id, exec_id AS {name}, admitted FROM fold WHERE rn > 0"""


def admission_oracle(name: str) -> str:
    return ADMISSION_SQL.format(name=name, exec_log=view_sql("exec_log"), chain=view_sql("chain"))


@query("w06_admission", admission_oracle("txid"))
def w06(t):
    """Every log row is a start attempt; limits come from the chain table."""
    attempts = t.exec_log.select(
        "chain_id", F.col("exec_id").alias("txid"), "client_name", F.col("last_run").alias("started"), "finished"
    )
    return runlog.admission(attempts, t.chain)


@query(
    "w09_last_runs",
    ctes("exec_log", n="SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY finished DESC, exec_id DESC) AS rn FROM exec_log")
    + "SELECT chain_id, exec_id, finished, CAST(rn AS INT) AS rn FROM n WHERE rn <= 5",
)
def w09(t):
    return runlog.last_runs(t.exec_log, 5).select("chain_id", "exec_id", "finished", "rn")


@query(
    "j11_exclusive_overlaps",
    ctes("chain", "exec_log", **SPANS)
    + """SELECT a.chain_id, a.txid, a.client_name, count(b.txid) AS n_overlaps FROM sp a JOIN chain c ON c.chain_id = a.chain_id AND c.exclusive_execution
    LEFT JOIN sp b ON b.client_name = a.client_name AND b.started < a.finished AND a.started < b.finished
     AND NOT (b.chain_id = a.chain_id AND b.txid = a.txid) GROUP BY 1, 2, 3""",
)
def j11(t):
    return runlog.exclusive_overlaps(runlog.run_spans(t.exec_log), t.chain)
