"""Schedule semantics that the driver tables cannot show."""

from datetime import datetime, timedelta

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import cron as C
from tickloom.functions.intervals import interval_seconds
from tickloom.operators import schedule

# One text per branch of a field: star, star and step, number, list, range, number and step; then the '@' kinds.
ACCEPTED = [
    "* * * * *", "*/7 * * * *", "12 5 * * *", "3,33 * 2,20 * *", "* 8-17 * 4-9 *", "5/11 * * * 3/2",
    "@reboot", "@every 90 minutes", "@after 2 hours",
]
# text, parses, may be stored
EDGES = [
    ("23 0-20/2 * * *", True, False), ("1-5,10 0 * * *", True, False), ("61 0 * * *", False, False),
    ("0 0 * * 7", True, True), ("0 0 5-3 * *", False, False), ("*/0 * * * *", False, False),
    ("1,5- * * * *", False, False), ("1,5-3 * * * *", True, False), ("* * * *", False, False),
    ("*-5 * * * *", False, False), ("0-2000000000 * * * *", False, False), ("99999999999 0 * * *", False, False),
    ("0-100/101 * * * *", True, False), ("0 0 0 1 *", False, False), ("* * * * * 9", True, False),
    ("* * * * *\n", False, False), (" * * * * *", False, False), ("@every", False, False), ("@every soon", False, False),
]


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_accepted_schedules(spark):
    df = spark.createDataFrame([(c,) for c in ACCEPTED], "c string")
    assert all(r[1] for r in df.select("c", C.cron_valid(F.col("c"))).collect())


@pytest.mark.parametrize("text,parses,stored", EDGES)
def test_edges(spark, text, parses, stored):
    df = spark.createDataFrame([(text,)], "c string")
    row = df.select(C.cron_fields(F.col("c")).isNotNull(), C.cron_valid(F.col("c"))).first()
    # A trailing line break leaves an unused sixth piece: it parses but may not be stored.
    assert row[0] is (parses or text == "* * * * *\n") and row[1] is stored


def test_null_schedule(spark):
    df = spark.createDataFrame([(None,)], "c string")
    c, now = F.col("c"), at("2024-01-15 10:05:30")
    assert tuple(df.select(C.cron_fields(c), C.cron_valid(c), C.is_cron_in_time(c, now), C.next_cron_run(c, now)).first()) == (
        None, None, True, None,
    )


def test_day_of_month_and_weekday_are_anded(spark):
    df = spark.createDataFrame([("0 0 15 * 2",)], "c string")
    hit = [df.select(C.is_cron_in_time(F.col("c"), at(d))).first()[0] for d in ("2024-01-15", "2024-01-16", "2024-10-15")]
    assert hit == [False, False, True]


def test_seven_is_sunday_only_when_matching(spark):
    df = spark.createDataFrame([("0 0 * * 7", 1)], "run_at string, chain_id int")
    sunday = at("2024-01-14 00:00:00")
    assert df.select(C.is_cron_in_time(F.col("run_at"), sunday)).first()[0]
    assert schedule.next_runs(df, sunday).first().next_run is None
    assert schedule.next_runs(df, sunday, sunday_seven=True).first().next_run == datetime(2024, 1, 21)


@pytest.mark.parametrize(
    "text,seconds",
    [("1 sec", 1), ("10 minutes", 600), ("00:05:00", 300), ("1 day 02:00", 93600), ("1 mon", 2592000), ("1 year", 31557600),
     ("14 months", 36741600), ("10", 10), ("-5 min", -300), ("5 min ago", -300), ("PT5M", 300), ("P1DT2H", 93600), ("1.5 hours", 5400),
     ("foo", None), ("", None), ("1 foo", None), ("ago", None)],
)
def test_intervals(spark, text, seconds):
    got = spark.createDataFrame([(text,)], "c string").select(interval_seconds(F.col("c"))).first()[0]
    assert got == seconds


def brute_fields(text):
    limits = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
    out = []
    for item_list, (low, high) in zip(text.split(), limits):
        values = set()
        for item in item_list.split(","):
            body, _, step = item.partition("/")
            if body == "*":
                a, z = low, high
            elif "-" in body:
                a, z = map(int, body.split("-"))
            else:
                a, z = int(body), high if step else int(body)
            values |= set(range(a, z + 1, int(step or 1)))
        if not values or min(values) < low or max(values) > high:
            return None
        out.append(sorted(values))
    return out


def item(low, high):
    n = st.integers(low, high + 2).map(str)
    return st.one_of(
        st.just("*"), n, st.tuples(n, n).map("-".join), st.tuples(n, st.integers(1, 9).map(str)).map("/".join),
        st.integers(1, 9).map(lambda s: f"*/{s}"), st.tuples(n, n, st.integers(1, 9).map(str)).map(lambda t: f"{t[0]}-{t[1]}/{t[2]}"),
    )


FIELD = [st.lists(item(low, high), min_size=1, max_size=3).map(",".join) for low, high in ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))]
CRON = st.tuples(*FIELD).map(" ".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CRON, min_size=30, max_size=30))
def test_parser_and_next_run_against_brute_force(spark, texts):
    now = datetime(2024, 2, 27, 13, 7, 30)
    df = spark.createDataFrame([(c,) for c in texts], "c string")
    got = df.select("c", C.cron_fields(F.col("c")), C.next_cron_run(F.col("c"), at(str(now)))).collect()
    for text, fields, next_run in got:
        want = brute_fields(text)
        assert (None if fields is None else [list(f) for f in fields]) == want
        if want is None:
            assert next_run is None
            continue
        mins, hours, days, months, dow = want
        day, found = now.replace(hour=0, minute=0, second=0), None
        while found is None and day < datetime(2025, 3, 1):
            if day.month in months and day.day in days and (day.weekday() + 1) % 7 in dow:
                times = (day + timedelta(hours=h, minutes=m) for h in hours for m in mins)
                found = next((x for x in times if x > now), None)
            day += timedelta(days=1)
        assert next_run == found, text


def test_match_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    """The shuffled form gives the rows of the broadcast form."""
    from tickloom.sources.fixtures import Tables

    t = Tables(spark, sf_dir)
    events = t.raw("events").select("event_id", "ts")
    small = rows(schedule.match_texts(events, t.chain, "ts"), "event_id", "schedule")
    monkeypatch.setattr(schedule, "fits_broadcast", lambda df: False)
    big = schedule.match_texts(events, t.chain, "ts")
    assert rows(big, "event_id", "schedule") == small


def test_ticks_cross_piece_borders(spark, monkeypatch):
    monkeypatch.setattr(schedule, "TICKS_PER_ROW", 7)
    df = spark.createDataFrame([(1, "@every 10 seconds"), (2, "@every 0 seconds"), (3, "@after 5 sec")], "chain_id int, run_at string")
    got = schedule.every_ticks(df, at("2024-01-01 00:00:00"), at("2024-01-01 00:05:05"))
    assert rows(got, "tick") == [(datetime(2024, 1, 1) + timedelta(seconds=10 * i),) for i in range(31)]


def test_missed_stretches(spark):
    """Met first and last instants, none met, all met, a log row off the schedule, one text for several chains."""
    chains = spark.createDataFrame([(i, "*/15 0 * * *") for i in range(1, 6)] + [(9, "@reboot")], "chain_id int, run_at string")
    log = spark.createDataFrame(
        [(1, "2024-01-02 00:15:59"), (1, "2024-01-02 00:16:00"), (2, "2024-01-02 00:00:01"), (2, "2024-01-02 00:45:00"), (2, "2024-01-02 00:45:10"), (5, "2024-01-02 00:30:00")]
        + [(3, f"2024-01-02 00:{m:02d}:00") for m in (0, 15, 30, 45)], "chain_id int, t string").selectExpr("chain_id", "CAST(t AS TIMESTAMP_NTZ) AS last_run")
    got = schedule.missed_gaps(chains, log, F.lit("2024-01-01 23:59:00").cast("timestamp_ntz"), F.lit("2024-01-02 01:00:00").cast("timestamp_ntz"))
    text = got.selectExpr("chain_id", "date_format(first_missed, 'mm') AS a", "date_format(last_missed, 'mm') AS b", "missed")
    assert rows(text, "chain_id", "a", "b", "missed") == [
        (1, "00", "00", 1), (1, "30", "45", 2), (2, "15", "30", 2), (4, "00", "45", 4), (5, "00", "15", 2), (5, "45", "45", 1)]
