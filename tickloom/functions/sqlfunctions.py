"""The schedule functions for SQL text: ``register(spark)`` makes them temporary functions of the session.

They are SQL functions, so Catalyst inlines them into the query that calls
them; the set-returning ones are used in FROM, also with LATERAL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tickloom.functions import cron as C
from tickloom.functions import intervals

_FIELDS_TYPE = "STRUCT<" + ", ".join(f"{name}: ARRAY<INT>" for name, _, _ in C.FIELDS) + ">"

_IN_TIME = f"""
run_at IS NULL OR CASE WHEN run_at RLIKE r'{C.STORED}' THEN transform(array(cron_fields(run_at)), f -> coalesce(
    array_contains(f.months, month(ts))
    AND (array_contains(f.dow, dayofweek(ts) - 1) OR array_contains(f.dow, weekday(ts) + 1))
    AND array_contains(f.days, day(ts)) AND array_contains(f.hours, hour(ts)) AND array_contains(f.mins, minute(ts)),
    false))[0] ELSE false END"""

# Days and minutes of one schedule; the first instant after from_ts is today's next minute or the next day's first.
_NEXT_RUN = """
transform(transform(array(cron_fields(run_at)), f -> CASE WHEN f IS NOT NULL THEN named_struct(
    'days', filter(sequence(trunc(from_ts, 'MM'), last_day(add_months(trunc(from_ts, 'MM'), 12))),
        d -> d >= to_date(from_ts) AND array_contains(f.months, month(d)) AND array_contains(f.days, day(d))
             AND array_contains(f.dow, dayofweek(d) - 1)),
    'times', flatten(transform(f.hours, h -> transform(f.mins, m -> h * 60 + m)))) END),
  s -> CASE
    WHEN get(s.days, 0) = to_date(from_ts) AND exists(s.times, m -> m > hour(from_ts) * 60 + minute(from_ts))
    THEN to_timestamp_ntz(CAST(to_date(from_ts) AS STRING)) + make_dt_interval(0, 0,
         filter(s.times, m -> m > hour(from_ts) * 60 + minute(from_ts))[0], 0)
    ELSE to_timestamp_ntz(CAST(get(filter(s.days, d -> d > to_date(from_ts)), 0) AS STRING))
         + make_dt_interval(0, 0, get(s.times, 0), 0) END)[0]"""

# Name and signature, what it returns, body. Order matters: later ones call earlier ones.
FUNCTIONS = (
    ("interval_seconds(txt STRING)", "DOUBLE", f"transform(array(lower(trim(txt))), x -> {intervals.SECONDS_SQL})[0]"),
    (
        "cron_fields(cron STRING)",
        _FIELDS_TYPE,
        rf"transform(array(transform(array(split(cron, r'\s+')), x -> {C.FIELDS_SQL})[0]), x -> {C.NAMED_SQL})[0]",
    ),
    (
        "cron_valid(cron STRING)",
        "BOOLEAN",
        f"""CASE WHEN cron IS NULL THEN NULL WHEN cron = '@reboot' THEN true
        WHEN substr(cron, 1, 6) IN ('@every', '@after') THEN interval_seconds(substr(cron, 7)) IS NOT NULL
        WHEN NOT cron RLIKE r'{C.STORED}' THEN false ELSE cron_fields(cron) IS NOT NULL END""",
    ),
    ("is_cron_in_time(run_at STRING, ts TIMESTAMP_NTZ)", "BOOLEAN", _IN_TIME),
    ("next_run(run_at STRING, from_ts TIMESTAMP_NTZ)", "TIMESTAMP_NTZ", _NEXT_RUN),
    (
        "cron_months(from_ts TIMESTAMP_NTZ, allowed_months ARRAY<INT>)",
        "TABLE(month_start DATE)",
        """SELECT m FROM (SELECT explode(sequence(trunc(from_ts, 'MM'), add_months(trunc(from_ts, 'MM'), 12), INTERVAL 1 MONTH)) AS m)
        WHERE array_contains(allowed_months, month(m))""",
    ),
    (
        "cron_days(from_ts TIMESTAMP_NTZ, allowed_months ARRAY<INT>, allowed_days ARRAY<INT>, allowed_week_days ARRAY<INT>)",
        "TABLE(run_day DATE)",
        """SELECT d FROM (SELECT explode(sequence(trunc(from_ts, 'MM'), last_day(add_months(trunc(from_ts, 'MM'), 12)))) AS d)
        WHERE array_contains(allowed_months, month(d)) AND array_contains(allowed_days, day(d))
          AND array_contains(allowed_week_days, dayofweek(d) - 1)""",
    ),
    (
        "cron_times(allowed_hours ARRAY<INT>, allowed_minutes ARRAY<INT>)",
        "TABLE(minute_of_day INT)",
        "SELECT h * 60 + m FROM (SELECT h, explode(allowed_minutes) AS m FROM (SELECT explode(allowed_hours) AS h))",
    ),
    (
        "cron_runs(from_ts TIMESTAMP_NTZ, cron STRING)",
        "TABLE(run_ts TIMESTAMP_NTZ)",
        """SELECT run_ts FROM (
            SELECT to_timestamp_ntz(CAST(d AS STRING)) + make_dt_interval(0, h, m, 0) AS run_ts FROM (
              SELECT d, h, explode(f.mins) AS m FROM (
                SELECT d, f, explode(f.hours) AS h FROM (
                  SELECT f, explode(filter(
                      sequence(trunc(from_ts, 'MM'), last_day(add_months(trunc(from_ts, 'MM'), 12))),
                      d -> array_contains(f.months, month(d)) AND array_contains(f.days, day(d))
                           AND array_contains(f.dow, dayofweek(d) - 1))) AS d
                  FROM (SELECT cron_fields(cron) AS f)))))
        WHERE run_ts > from_ts""",
    ),
)


def register(spark: SparkSession) -> None:
    """Create (or replace) the temporary functions."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
