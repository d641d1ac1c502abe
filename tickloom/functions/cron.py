"""Cron text as Column expressions.

Everything here is a narrow expression over one string column: no shuffle, no
Python worker. A schedule table is parsed where it lies.  Parsing is fail-soft:
text that cannot be parsed gives NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.binding import let, let_sql
from tickloom.functions.intervals import interval_seconds

# The five cron fields with their allowed ranges.
FIELDS = (
    ("mins", 0, 59),
    ("hours", 0, 23),
    ("days", 1, 31),
    ("months", 1, 12),
    ("dow", 0, 7),
)

# Fixed value: shapes a comma-separated item may take: n, n-m, n/s, n-m/s, *, */s.
# A chain such as 1-2-9/3 is read as 1-2/3; without a step it is an error.
ITEM = (
    r"^(?:[*]+(?:/[0-9]+)?"
    r"|[0-9]+(?:-[0-9]+)?(?:/[0-9]+)?"
    r"|[0-9]+-[0-9]+(?:-[0-9]+)+/[0-9]+)$"
)

# Fixed value: what a *stored* schedule must look like. Narrower than ITEM:
# lists hold plain numbers only, and a range with a step is refused.
_PIECE = r"((\d+,)+\d+|(\d+(/|-)\d+)|(\*(/|-)\d+)|\d+|\*)"
STORED = rf"^({_PIECE} +){{4}}({_PIECE} ?)\z"


# Numbers one item of field f stands for; NULL when it is malformed or out of range.
# The last number really reached decides the range check, and bounds the array.
_ITEM_SQL = f"""
CASE WHEN item RLIKE r'{ITEM}' THEN transform(array(named_struct(
    'a', CASE WHEN startswith(item, '*') THEN f.low ELSE try_cast(split_part(split_part(item, '/', 1), '-', 1) AS INT) END,
    'z', CASE WHEN contains(item, '-') THEN try_cast(split_part(split_part(item, '/', 1), '-', 2) AS INT)
              WHEN startswith(item, '*') OR contains(item, '/') THEN f.high ELSE try_cast(item AS INT) END,
    's', CASE WHEN contains(item, '/') THEN try_cast(split_part(item, '/', 2) AS INT) ELSE 1 END)),
  b -> CASE WHEN b.a IS NULL OR b.z IS NULL OR b.s IS NULL OR b.s <= 0 THEN NULL
            WHEN b.z < b.a THEN CAST(array() AS ARRAY<INT>)
            WHEN b.a < f.low OR b.a + ((b.z - b.a) div b.s) * b.s > f.high THEN NULL
            ELSE sequence(b.a, CAST(b.a + ((b.z - b.a) div b.s) * b.s AS INT), b.s) END)[0] END"""

_PARTS_SQL = ", ".join(
    f"named_struct('text', get(x, {i}), 'low', {low}, 'high', {high})" for i, (_, low, high) in enumerate(FIELDS)
)

# flatten() is NULL as soon as one item is NULL: one bad item spoils its field.
FIELDS_SQL = f"""
transform(array({_PARTS_SQL}),
    f -> sort_array(array_distinct(flatten(transform(split(f.text, ','), item -> {_ITEM_SQL})))))"""

NAMED_SQL = f"""
CASE WHEN forall(x, v -> coalesce(size(v) > 0, false))
THEN named_struct({", ".join(f"'{name}', x[{i}]" for i, (name, _, _) in enumerate(FIELDS))}) END"""

MASKS_SQL = "named_struct({})".format(
    ", ".join(f"'{name}', aggregate(x.{name}, 0L, (acc, v) -> acc | shiftleft(1L, v))" for name, _, _ in FIELDS)
)


def cron_fields(cron: Column) -> Column:
    """Struct of five sorted distinct int arrays, or NULL if ``cron`` does not parse.

    Only the first five whitespace-separated fields are read. An empty range
    inside a list adds nothing; a field with no number left is an error.
    """
    return let_sql(let_sql(F.split(cron, r"\s+"), FIELDS_SQL), NAMED_SQL)


def field_masks(fields: Column) -> Column:
    """Parsed fields as 64-bit sets, so a membership test is one shift and one AND."""
    return let_sql(fields, MASKS_SQL)


def cron_masks(cron: Column) -> Column:
    """``cron`` straight to bit sets; NULL if it does not parse."""
    return let_sql(cron_fields(cron), f"CASE WHEN x IS NOT NULL THEN {MASKS_SQL} END")


def in_mask(mask: Column, bit: Column) -> Column:
    return F.call_function("shiftright", mask, bit).bitwiseAND(F.lit(1).cast("bigint")) == 1


def dow0(ts: Column) -> Column:
    """Day of week, Sunday = 0."""
    return F.dayofweek(ts) - 1


def dow_matches(mask: Column, ts: Column) -> Column:
    """Sunday may be written 0 or 7 when a timestamp is tested against a schedule."""
    day = dow0(ts)
    return in_mask(mask, day) | ((day == 0) & in_mask(mask, F.lit(7)))


def is_interval_schedule(schedule: Column) -> Column:
    return F.substring(schedule, 1, 6).isin("@every", "@after")


def cron_problem(schedule: Column) -> Column:
    """Why ``schedule`` may not be stored: 'interval', 'pattern', 'range', or NULL if it may."""
    return (
        F.when(schedule.isNull() | (schedule == "@reboot"), None)
        .when(
            is_interval_schedule(schedule),
            F.when(interval_seconds(F.substring(schedule, 7, 2147483647)).isNull(), "interval"),
        )
        .when(~schedule.rlike(STORED), "pattern")
        .when(cron_fields(schedule).isNull(), "range")
    )


def cron_valid(schedule: Column) -> Column:
    """May ``schedule`` be stored? NULL in, NULL out."""
    return F.when(schedule.isNotNull(), cron_problem(schedule).isNull())


def is_cron_in_time(schedule: Column, ts: Column, stored: bool = True) -> Column:
    """Does ``ts`` hit ``schedule``? All five fields must agree; NULL schedule always hits.

    With ``stored`` only text that may be stored as a schedule can match.
    """
    usable = schedule.rlike(STORED) if stored else F.lit(True)
    hit = let(
        F.when(usable, cron_masks(schedule)),
        lambda m: m.isNotNull()
        & in_mask(m["months"], F.month(ts))
        & dow_matches(m["dow"], ts)
        & in_mask(m["days"], F.dayofmonth(ts))
        & in_mask(m["hours"], F.hour(ts))
        & in_mask(m["mins"], F.minute(ts)),
    )
    return F.when(schedule.isNull(), F.lit(True)).otherwise(F.coalesce(hit, F.lit(False)))


def cron_months(from_ts: Column, months: Column) -> Column:
    """Allowed month starts (dates) of the thirteen months from ``from_ts`` to a year later."""
    start = F.trunc(from_ts, "month")
    return F.filter(
        F.sequence(start, F.add_months(start, 12), F.expr("INTERVAL 1 MONTH")),
        lambda m: F.array_contains(months, F.month(m)),
    )


def cron_days(from_ts: Column, months: Column, days: Column, dow: Column, sunday_seven: bool = False) -> Column:
    """Allowed days (dates) of those months; day of month and day of week must both agree.

    Here 7 is not Sunday unless ``sunday_seven`` is set.
    """
    start = F.trunc(from_ts, "month")

    def allowed(d: Column) -> Column:
        weekday = F.array_contains(dow, dow0(d))
        if sunday_seven:
            weekday = weekday | ((dow0(d) == 0) & F.array_contains(dow, 7))
        return F.array_contains(months, F.month(d)) & F.array_contains(days, F.dayofmonth(d)) & weekday

    return F.filter(F.sequence(start, F.last_day(F.add_months(start, 12))), allowed)


def cron_times(hours: Column, mins: Column) -> Column:
    """Sorted minutes of the day (at most 1440)."""
    return F.flatten(F.transform(hours, lambda h: F.transform(mins, lambda m: h * 60 + m)))


def at_minute(day: Column, minute_of_day: Column) -> Column:
    return F.to_timestamp_ntz(day.cast("string")) + F.make_dt_interval(F.lit(0), F.lit(0), minute_of_day, F.lit(0))


def next_cron_run(cron: Column, from_ts: Column, sunday_seven: bool = False) -> Column:
    """First instant strictly after ``from_ts``, found without listing the instants in between."""
    minute_now = F.hour(from_ts) * 60 + F.minute(from_ts)

    def search(s: Column) -> Column:
        days = cron_days(from_ts, s["months"], s["days"], s["dow"], sunday_seven)
        today = F.to_date(from_ts)
        later_today = F.filter(cron_times(s["hours"], s["mins"]), lambda m: m > minute_now)
        first_later = F.try_element_at(F.filter(days, lambda d: d > today), F.lit(1))
        return F.when(
            F.array_contains(days, today) & (F.size(later_today) > 0), at_minute(today, later_today[0])
        ).when(first_later.isNotNull(), at_minute(first_later, s["hours"][0] * 60 + s["mins"][0]))

    return let(cron_fields(cron), lambda s: F.when(s.isNotNull(), search(s)))


def flags_to_cron(flags: Column, start: int = 0) -> Column:
    """Positions of the set flags as a comma list counted from ``start``; '*' if none is set."""
    numbers = F.transform(flags, lambda flag, i: F.when(flag, (i + start).cast("string")))
    return F.coalesce(F.nullif(F.array_join(F.array_compact(numbers), ","), F.lit("")), F.lit("*"))


def schedule_class(schedule: Column) -> Column:
    """'reboot', 'every', 'after' or 'cron'."""
    return (
        F.when(schedule == "@reboot", "reboot")
        .when(F.substring(schedule, 1, 6) == "@every", "every")
        .when(F.substring(schedule, 1, 6) == "@after", "after")
        .otherwise("cron")
    )


def schedule_seconds(schedule: Column) -> Column:
    """Whole seconds of an @every / @after schedule, NULL for any other."""
    return F.when(
        is_interval_schedule(schedule),
        F.round(interval_seconds(F.substring(schedule, 7, 2147483647))).cast("bigint"),
    )
