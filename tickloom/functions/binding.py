"""Small helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once so that ``body`` can mention it several times."""
    return F.transform(F.array(value), body)[0]


def let_sql(value: Column, body: str) -> Column:
    """Like ``let`` with the body as SQL text over ``x``: one call instead of one per operator."""
    return F.call_function("transform", F.array(value), F.expr(f"x -> {body}"))[0]


def micros(ts: Column) -> Column:
    """Timestamp as integer microseconds, the unit of every duration in this library."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")
