"""Interval text ('1 day 02:00', '10 sec', 'PT5M') to seconds, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.binding import let_sql

# Unit spellings and their length in seconds. Months and years are
# counted apart: twelve months are 365.25 days, a single month is 30 days.
SECOND_UNITS = (
    (("us", "usec", "usecs", "microsecond", "microseconds"), "0.000001"),
    (("ms", "msec", "msecs", "millisecond", "milliseconds"), "0.001"),
    (("s", "sec", "secs", "second", "seconds"), "1"),
    (("m", "min", "mins", "minute", "minutes"), "60"),
    (("h", "hr", "hrs", "hour", "hours"), "3600"),
    (("d", "day", "days"), "86400"),
    (("w", "week", "weeks"), "604800"),
)
MONTH_UNITS = (
    (("mon", "mons", "month", "months"), "1"),
    (("y", "yr", "yrs", "year", "years"), "12"),
    (("decade", "decades"), "120"),
    (("c", "century", "centuries"), "1200"),
)
MONTH_SECONDS = 2592000.0
YEAR_SECONDS = 31557600.0

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)"
_UNIT = "|".join(u for names, _ in SECOND_UNITS + MONTH_UNITS for u in names)
_TERM = rf"({_NUMBER})\s*({_UNIT})\b"
_CLOCK = r"([+-]?)(\d+):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?"
_WHOLE = rf"^@?\s*(?:{_TERM}\s*)*(?:{_CLOCK}\s*|{_NUMBER}\s*)?(?:ago\s*)?\z"
_BARE = rf"(?:^|\s)({_NUMBER})\s*(?:ago\s*)?\z"
_ISO = (
    rf"^p(?=.)(?:({_NUMBER})y)?(?:({_NUMBER})m)?(?:({_NUMBER})w)?(?:({_NUMBER})d)?"
    rf"(?:t(?=.)(?:({_NUMBER})h)?(?:({_NUMBER})m)?(?:({_NUMBER})s)?)?\z"
)




def _sizes(table) -> str:
    return "map({})".format(", ".join(f"'{name}', {size}D" for names, size in table for name in names))


def _total(table) -> str:
    return (
        f"aggregate(zip_with(regexp_extract_all(x, r'{_TERM}', 1), regexp_extract_all(x, r'{_TERM}', 2),"
        f" (n, u) -> CAST(n AS DOUBLE) * coalesce(try_element_at({_sizes(table)}, u), 0D)), 0D, (acc, v) -> acc + v)"
    )


def _months(months: str) -> str:
    """Months to seconds: whole years at their length, what is left at a month's."""
    return (
        f"transform(array({months}), m -> sign(m) * floor(abs(m) / 12) * {YEAR_SECONDS}D"
        f" + (m - sign(m) * floor(abs(m) / 12) * 12) * {MONTH_SECONDS}D)[0]"
    )


def _group(pattern: str, group: int) -> str:
    return f"coalesce(try_cast(regexp_extract(x, r'{pattern}', {group}) AS DOUBLE), 0D)"


_PLAIN_SQL = f"""
CASE WHEN endswith(x, 'ago') THEN -1D ELSE 1D END * (
    {_total(SECOND_UNITS)} + {_months(_total(MONTH_UNITS))}
    + CASE WHEN regexp_extract(x, r'{_CLOCK}', 1) = '-' THEN -1D ELSE 1D END
      * ({_group(_CLOCK, 2)} * 3600 + {_group(_CLOCK, 3)} * 60 + {_group(_CLOCK, 4)})
    + {_group(_BARE, 1)})"""

_ISO_SQL = (
    _months(f"{_group(_ISO, 1)} * 12 + {_group(_ISO, 2)}")
    + f" + {_group(_ISO, 3)} * 604800 + {_group(_ISO, 4)} * 86400"
    + f" + {_group(_ISO, 5)} * 3600 + {_group(_ISO, 6)} * 60 + {_group(_ISO, 7)}"
)


SECONDS_SQL = (
    f"CASE WHEN x RLIKE r'{_ISO}' THEN {_ISO_SQL}"
    f" WHEN x RLIKE r'{_WHOLE}' AND x RLIKE r'[0-9]' THEN {_PLAIN_SQL} END"
)


def interval_seconds(text: Column) -> Column:
    """Length in seconds as a double; NULL when the text is no interval.

    A bare number at the end counts as seconds. NULL in, NULL out.
    """
    return let_sql(F.lower(F.trim(text)), SECONDS_SQL)
