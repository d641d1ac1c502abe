"""Schedule calculus (C1-C14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import cron as C
from tickloom.functions import sqlfunctions
from tickloom.operators import runlog, schedule
from tickloom.plans.registry import at, query
from tickloom.sources.fixtures import ANCHOR, ctes

CLIENT = "worker_1"

STORED_SQL = (
    r"regexp_matches({0}, '^(((\d+,)+\d+|(\d+(/|-)\d+)|(\*(/|-)\d+)|\d+|\*) +){{4}}"
    r"(((\d+,)+\d+|(\d+(/|-)\d+)|(\*(/|-)\d+)|\d+|\*) ?)$')"
)

# The oracle parses cron text relationally: one row per (text, field, value).
CRON = {
    "cron_text": "SELECT DISTINCT run_at FROM chain WHERE run_at IS NOT NULL",
    "cron_item": r"""SELECT run_at, field, lo, hi, unnest(string_split(txt, ',')) AS item FROM (
        SELECT run_at, field, string_split_regex(run_at, '\s+')[field] AS txt,
               [0,0,1,1,0][field] AS lo, [59,23,31,12,7][field] AS hi
        FROM cron_text, (SELECT unnest([1,2,3,4,5]) AS field))""",
    "cron_bound": """SELECT run_at, field, lo, hi,
        CASE WHEN item[1] = '*' THEN lo ELSE TRY_CAST(split_part(split_part(item,'/',1),'-',1) AS BIGINT) END AS a,
        CASE WHEN contains(item,'-') THEN TRY_CAST(split_part(split_part(item,'/',1),'-',2) AS BIGINT)
             WHEN item[1] = '*' OR contains(item,'/') THEN hi ELSE TRY_CAST(item AS BIGINT) END AS z,
        CASE WHEN contains(item,'/') THEN TRY_CAST(split_part(item,'/',2) AS BIGINT) ELSE 1 END AS s FROM cron_item""",
    "cron_bad": "SELECT DISTINCT run_at FROM cron_bound WHERE a IS NULL OR z IS NULL OR s IS NULL OR s = 0"
    " OR (a <= z AND (a < lo OR a + ((z - a) // s) * s > hi))",
    "cron_value": """SELECT DISTINCT run_at, ['mins','hours','days','months','dow'][field] AS field, val FROM (
        SELECT run_at, field, unnest(range(a, z + 1, s)) AS val FROM cron_bound
        WHERE run_at NOT IN (SELECT run_at FROM cron_bad))""",
    "cron_ok": "SELECT run_at FROM cron_value GROUP BY run_at HAVING count(DISTINCT field) = 5",
    "v": "SELECT * FROM cron_value WHERE run_at IN (SELECT run_at FROM cron_ok)",
}


def day_ctes(first: str, last: str) -> dict[str, str]:
    """Days of each text between two dates; 7 never equals a Sunday here."""
    return {
        "day": f"""SELECT DISTINCT m.run_at, d.d AS day
        FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY)) AS DATE) AS d) d
        JOIN v m ON m.field = 'months' AND m.val = month(d.d)
        JOIN v q ON q.run_at = m.run_at AND q.field = 'days' AND q.val = day(d.d)
        JOIN v w ON w.run_at = m.run_at AND w.field = 'dow' AND w.val = dayofweek(d.d)""",
        "tod": """SELECT h.run_at, h.val * 60 + m.val AS minute_of_day FROM v h JOIN v m ON h.run_at = m.run_at
        WHERE h.field = 'hours' AND m.field = 'mins'""",
        "run": "SELECT day.run_at, CAST(day AS TIMESTAMP) + to_minutes(CAST(minute_of_day AS BIGINT)) AS run_ts"
        " FROM day JOIN tod ON day.run_at = tod.run_at",
    }


@query("c01_cron_fields", ctes("chain", **CRON) + "SELECT run_at, field, CAST(val AS INT) AS value FROM v")
def c01(t):
    return schedule.cron_field_rows(t.chain)


_CLASS_SQL = """CASE WHEN run_at = '@reboot' THEN 'reboot' WHEN run_at[1:6] = '@every' THEN 'every'
    WHEN run_at[1:6] = '@after' THEN 'after' ELSE 'cron' END"""


@query(
    "c02_cron_valid",
    ctes("chain", **CRON)
    + f"""SELECT run_at, reason IS NULL AS valid, reason FROM (SELECT run_at,
    CASE WHEN {_CLASS_SQL} <> 'cron' THEN NULL WHEN NOT {STORED_SQL.format('run_at')} THEN 'pattern'
         WHEN run_at NOT IN (SELECT run_at FROM cron_ok) THEN 'range' END AS reason FROM cron_text)""",
)
def c02(t):
    return schedule.schedule_check(t.chain)


_HIT = """SELECT e.event_id, m.run_at FROM events e
    JOIN v m ON m.field = 'mins' AND m.val = minute(e.ts)
    JOIN v h ON h.run_at = m.run_at AND h.field = 'hours' AND h.val = hour(e.ts)
    JOIN v d ON d.run_at = m.run_at AND d.field = 'days' AND d.val = day(e.ts)
    JOIN v o ON o.run_at = m.run_at AND o.field = 'months' AND o.val = month(e.ts)
    WHERE EXISTS (SELECT 1 FROM v w WHERE w.run_at = m.run_at AND w.field = 'dow' AND w.val IN (dayofweek(e.ts), isodow(e.ts)))
      AND """ + STORED_SQL.format("m.run_at")


@query(
    "c03_cron_match",
    ctes("chain", **CRON, hit=_HIT, n="SELECT run_at, count(*) AS n FROM hit GROUP BY run_at")
    + """SELECT chain_id, n AS n_matches FROM chain JOIN n USING (run_at)
    UNION ALL SELECT chain_id, (SELECT count(*) FROM events) FROM chain WHERE run_at IS NULL""",
)
def c03(t):
    """Flagship: how many events hit each schedule."""
    return schedule.match_counts(t.raw("events").select("ts"), t.chain, "ts")


@query("c03_cron_match_rows", ctes("chain", **CRON, hit=_HIT) + "SELECT event_id, run_at AS schedule FROM hit")
def c03_rows(t):
    """Every event with every schedule text it hits."""
    return schedule.match_texts(t.raw("events").select("event_id", "ts"), t.chain, "ts").select("event_id", "schedule")


@query(
    "c04_cron_months",
    ctes("chain", **CRON)
    + """SELECT v.run_at, CAST(m AS DATE) AS month_start FROM v JOIN
    (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2025-01-01', INTERVAL 1 MONTH)) AS m) g
    ON v.val = month(m) WHERE v.field = 'months'""",
)
def c04(t):
    return schedule.months_of(t.chain, at(ANCHOR))


@query("c05_cron_days", ctes("chain", **CRON, **day_ctes("2024-01-01", "2025-01-31")) + "SELECT run_at, day FROM day")
def c05(t):
    return schedule.days_of(t.chain, at(ANCHOR))


@query(
    "c06_cron_times",
    ctes("chain", **CRON, **day_ctes("2024-01-01", "2025-01-31"))
    + "SELECT run_at, CAST(minute_of_day AS INT) AS minute_of_day FROM tod",
)
def c06(t):
    return schedule.times_of(t.chain)


@query(
    "c07_cron_runs",
    ctes("chain", **CRON, **day_ctes("2024-01-15", "2025-01-31"))
    + f"SELECT run_at, run_ts FROM run WHERE run_ts > TIMESTAMP '{ANCHOR}'",
)
def c07(t):
    """Run instants up to the horizon, per schedule text."""
    return schedule.cron_runs(t.chain, at(ANCHOR))


@query(
    "c08_next_run",
    ctes(
        "chain", **CRON, **day_ctes("2024-01-01", "2025-01-31"),
        nx=f"SELECT run_at, min(run_ts) AS next_run FROM run WHERE run_ts > TIMESTAMP '{ANCHOR}'"
        f" AND {STORED_SQL.format('run_at')} GROUP BY run_at",
    )
    + "SELECT chain_id, next_run FROM chain LEFT JOIN nx USING (run_at)",
)
def c08(t):
    return schedule.next_runs(t.chain, at(ANCHOR))


_SECONDS_SQL = "CASE run_at WHEN '@every 10 minutes' THEN 600 WHEN '@after 2 hours' THEN 7200 END"


@query(
    "c09_schedule_class",
    ctes("chain") + f"SELECT chain_id, {_CLASS_SQL} AS schedule_class, CAST({_SECONDS_SQL} AS BIGINT) AS interval_seconds FROM chain",
)
def c09(t):
    return schedule.classes(t.chain)


@query(
    "c10_every_ticks",
    ctes("chain")
    + f"""SELECT chain_id, unnest(generate_series(TIMESTAMP '{ANCHOR}', TIMESTAMP '2024-01-16', INTERVAL 10 MINUTE)) AS tick
    FROM chain WHERE run_at = '@every 10 minutes'""",
)
def c10(t):
    """Starts of every @every chain over the coming day."""
    return schedule.every_ticks(t.chain, at(ANCHOR), at("2024-01-16 00:00:00"))


@query(
    "c11_after_ticks",
    ctes(
        "chain", "exec_log",
        r="SELECT chain_id, txid, min(last_run) AS started, max(finished) AS finished FROM exec_log GROUP BY ALL",
        p="SELECT r.*, lag(r.finished) OVER (PARTITION BY chain_id ORDER BY started, txid) + INTERVAL 2 HOUR AS expected"
        " FROM r JOIN chain USING (chain_id) WHERE run_at = '@after 2 hours'",
    )
    + """SELECT chain_id, txid, started, expected, epoch_us(started) - epoch_us(expected) AS drift_us FROM p
    WHERE expected IS NOT NULL""",
)
def c11(t):
    return schedule.after_drift(runlog.run_spans(t.exec_log), t.chain)


@query(
    "c12_flags_to_cron",
    """WITH b AS (SELECT p_partkey, unnest(range(0, 6)) AS i, p_size FROM part)
    SELECT p_partkey, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER ((p_size >> i) & 1 = 1), '*') AS from_zero,
     coalesce(string_agg(CAST(i + 1 AS VARCHAR), ',' ORDER BY i) FILTER ((p_size >> i) & 1 = 1), '*') AS from_one
    FROM b GROUP BY p_partkey""",
)
def c12(t):
    flags = F.array(*[F.col("p_size").bitwiseAND(1 << i) != 0 for i in range(6)])
    return t.raw("part").select(
        "p_partkey", C.flags_to_cron(flags).alias("from_zero"), C.flags_to_cron(flags, 1).alias("from_one")
    )


@query(
    "c13_missed_runs",
    ctes(
        "chain", "exec_log", **CRON, **day_ctes("2024-01-15", "2024-01-16"),
        started="SELECT DISTINCT chain_id, date_trunc('minute', last_run) AS run_ts FROM exec_log",
    )
    + f"""SELECT chain_id, run_ts FROM chain JOIN run USING (run_at)
    WHERE run_ts > TIMESTAMP '{ANCHOR}' AND run_ts <= TIMESTAMP '2024-01-16'
      AND NOT EXISTS (SELECT 1 FROM started s WHERE s.chain_id = chain.chain_id AND s.run_ts = run.run_ts)""",
)
def c13(t):
    """Missed instants of the coming day, one by one."""
    return schedule.missed_runs(t.chain, t.exec_log, at(ANCHOR), at("2024-01-16 00:00:00"))


@query(
    "c13_missed_gaps",
    ctes(
        "chain", "exec_log", **CRON, **day_ctes("2023-12-31", "2024-02-01"),
        started="SELECT DISTINCT chain_id, date_trunc('minute', last_run) AS run_ts FROM exec_log",
        x=f"""SELECT c.chain_id, r.run_ts, s.run_ts IS NULL AS missed, row_number() OVER (PARTITION BY c.chain_id ORDER BY r.run_ts) AS n
        FROM chain c JOIN run r USING (run_at) LEFT JOIN started s ON s.chain_id = c.chain_id AND s.run_ts = r.run_ts
        WHERE r.run_ts > TIMESTAMP '2023-12-31 23:59:00' AND r.run_ts <= TIMESTAMP '2024-02-01'""",
        i="SELECT *, n - row_number() OVER (PARTITION BY chain_id ORDER BY n) AS stretch FROM x WHERE missed",
    )
    + "SELECT chain_id, min(run_ts) AS first_missed, max(run_ts) AS last_missed, count(*) AS missed FROM i GROUP BY chain_id, stretch",
)
def c13_gaps(t):
    """All misses of the whole log, as stretches of instants one after the other."""
    return schedule.missed_gaps(t.chain, t.exec_log, at("2023-12-31 23:59:00"), at("2024-02-01 00:00:00"))


@query(
    "c13_missed_counts",
    ctes(
        "chain", "exec_log", **CRON, **day_ctes("2023-12-31", "2024-02-01"),
        started="SELECT DISTINCT chain_id, date_trunc('minute', last_run) AS run_ts FROM exec_log",
    )
    + f"""SELECT chain_id, count(*) AS expected, count(s.run_ts) AS met, count(*) - count(s.run_ts) AS missed
    FROM chain JOIN run USING (run_at) LEFT JOIN started s USING (chain_id, run_ts)
    WHERE run_ts > TIMESTAMP '2023-12-31 23:59:00' AND run_ts <= TIMESTAMP '2024-02-01' GROUP BY chain_id""",
)
def c13_counts(t):
    """Expected, met and missed runs of every cron chain over the whole log."""
    return schedule.missed_run_counts(t.chain, t.exec_log, at("2023-12-31 23:59:00"), at("2024-02-01 00:00:00"))


@query(
    "c14_due_now",
    ctes("chain", **CRON, **day_ctes("2024-01-15", "2024-01-15"))
    + f"""SELECT chain_id, chain_name, self_destruct, exclusive_execution, coalesce(max_instances, 16) AS max_instances,
    coalesce(timeout, 0) AS timeout, '' AS on_error FROM chain WHERE live AND (client_name = '{CLIENT}' OR client_name IS NULL)
    AND (run_at IS NULL OR run_at IN (SELECT run_at FROM run WHERE run_ts = TIMESTAMP '{ANCHOR}' AND {STORED_SQL.format('run_at')}))""",
)
def c14(t):
    return schedule.due_now(t.chain, CLIENT, at(ANCHOR))


# --- the same from SQL text --------------------------------------------------


def _sql(t, text: str, **frames):
    sqlfunctions.register(t.spark)
    return t.spark.sql(text, **frames)


@query(
    "c07_cron_runs_sql",
    ctes("chain", **CRON, **day_ctes("2024-01-15", "2025-01-31"))
    + f"SELECT run_at, run_ts FROM run WHERE run_ts > TIMESTAMP '{ANCHOR}'",
)
def c07_sql(t):
    """cron_runs() as a table function under LATERAL."""
    return _sql(
        t,
        f"""SELECT c.run_at, r.run_ts FROM (SELECT DISTINCT run_at FROM {{chain}} WHERE run_at IS NOT NULL) c,
        LATERAL cron_runs(TIMESTAMP_NTZ'{ANCHOR}', c.run_at) r""",
        chain=t.chain,
    )


@query(
    "c08_next_run_sql",
    ctes(
        "chain", **CRON, **day_ctes("2024-01-01", "2025-01-31"),
        nx=f"SELECT run_at, min(run_ts) AS next_run FROM run WHERE run_ts > TIMESTAMP '{ANCHOR}' GROUP BY run_at",
    )
    + "SELECT run_at, next_run, run_at NOT IN (SELECT run_at FROM cron_text WHERE run_at[1] = '@' OR run_at IN"
    " (SELECT run_at FROM cron_ok)) AS broken FROM cron_text LEFT JOIN nx USING (run_at)",
)
def c08_sql(t):
    """next_run() and cron_fields() as scalar functions; here any text that parses has a next run."""
    return _sql(
        t,
        f"""SELECT run_at, next_run(run_at, TIMESTAMP_NTZ'{ANCHOR}') AS next_run,
        cron_fields(run_at) IS NULL AND NOT startswith(run_at, '@') AS broken FROM
        (SELECT DISTINCT run_at FROM {{chain}} WHERE run_at IS NOT NULL)""",
        chain=t.chain,
    )


@query(
    "c03_in_time_sql",
    ctes("chain", **CRON, hit=_HIT) + "SELECT count(*) AS n FROM hit",
)
def c03_sql(t):
    """is_cron_in_time() tested on the calendar minutes of the event table, after an equi join on the minute of the day."""
    minutes = t.raw("events").groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    timed = schedule.times_of(t.chain)
    return _sql(
        t,
        """SELECT coalesce(sum(n), 0) AS n FROM {minutes} m JOIN {timed} c ON hour(m.at) * 60 + minute(m.at) = c.minute_of_day
        WHERE is_cron_in_time(c.run_at, m.at)""",
        minutes=minutes, timed=timed,
    )


@query(
    "c14_due_now_sql",
    ctes("chain", **CRON, **day_ctes("2024-01-15", "2024-01-15"))
    + f"""SELECT chain_id FROM chain WHERE live AND (client_name = '{CLIENT}' OR client_name IS NULL) AND (run_at IS NULL OR run_at IN (SELECT run_at FROM run
    WHERE run_ts = TIMESTAMP '{ANCHOR}' AND {STORED_SQL.format('run_at')}))""",
)
def c14_sql(t):
    """The due test written as one WHERE clause; the guard keeps '@' schedules out."""
    return _sql(
        t,
        f"""SELECT chain_id FROM {{chain}} WHERE live AND (client_name = '{CLIENT}' OR client_name IS NULL)
        AND NOT coalesce(startswith(run_at, '@'), false)
        AND is_cron_in_time(run_at, TIMESTAMP_NTZ'{ANCHOR}')""",
        chain=t.chain,
    )
