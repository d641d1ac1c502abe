"""Schedule tables against time: matches, run instants, next, due, missed and drifting runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import cron as C
from tickloom.functions.binding import from_micros, micros
from tickloom.operators import blocked
from tickloom.operators.jobs import live_chains
from tickloom.session import cut_lineage, fits_broadcast

TICKS_PER_ROW = 10_000
MINUTE_US = 60_000_000


def distinct_schedules(schedules: DataFrame, run_at: str = "run_at") -> DataFrame:
    """Distinct schedule texts: large schedule tables repeat few texts, so work once per text."""
    return schedules.select(run_at).where(F.col(run_at).isNotNull()).distinct()


def parsed_schedules(schedules: DataFrame, run_at: str = "run_at") -> DataFrame:
    """Distinct texts that parse, with their fields ``f``.

    The one-element explode drops unparsable texts and keeps the optimizer from
    copying the parse into every later use of ``f``.
    """
    fields = F.array_compact(F.array(C.cron_fields(F.col(run_at))))
    return distinct_schedules(schedules, run_at).select(run_at, F.explode(fields).alias("f"))


def cron_field_rows(schedules: DataFrame, run_at: str = "run_at") -> DataFrame:
    """One row per (schedule text, field, value) of every text that parses."""
    named = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(f"f.{n}").alias("vals")) for n, _, _ in C.FIELDS]
    )
    return (
        parsed_schedules(schedules, run_at)
        .select(run_at, F.explode(named).alias("x"))
        .select(run_at, F.col("x.field").alias("field"), F.explode("x.vals").alias("value"))
    )


def schedule_check(schedules: DataFrame, run_at: str = "run_at") -> DataFrame:
    """Verdict and reason per distinct schedule text."""
    problem = C.cron_problem(F.col(run_at))
    return (
        distinct_schedules(schedules, run_at)
        .select(run_at, problem.alias("reason"))
        .select(run_at, F.col("reason").isNull().alias("valid"), "reason")
    )


def _expanded(schedules: DataFrame, run_at: str, stored: bool, by_day: bool) -> DataFrame:
    """Schedule texts on the equi-join key: minute of day, and day of month when ``by_day``."""
    usable = F.col(run_at).rlike(C.STORED) if stored else F.lit(True)
    masks = F.explode(F.array(C.field_masks(F.col("f")))).alias("m")
    parsed = parsed_schedules(schedules.where(usable), run_at).select(F.col(run_at).alias("schedule"), "f", masks)
    cols = ["schedule", "days_mask", "months_mask", "dow_mask", "minute_of_day"]
    d = parsed.select(
        "schedule",
        F.col("f.days").alias("day_list"),
        F.col("m.days").alias("days_mask"),
        F.col("m.months").alias("months_mask"),
        F.col("m.dow").alias("dow_mask"),
        F.explode(C.cron_times(F.col("f.hours"), F.col("f.mins"))).alias("minute_of_day"),
    )
    if by_day:
        return d.select(*cols, F.explode("day_list").alias("day_of_month"))
    return d.select(*cols)


def match_texts(events: DataFrame, schedules: DataFrame, ts: str, run_at: str = "run_at", stored: bool = True) -> DataFrame:
    """Every event row with every schedule text it hits (column ``schedule``).

    The theta condition becomes an equi join on the minute of the day; day,
    month and weekday are bit tests on the joined row. While the expanded texts
    fit a checked bound they are broadcast and the events never move; beyond it
    the join shuffles on (day of month, minute of day), which spreads a busy
    minute over 31 keys and leaves the rest to adaptive skew splitting.
    """
    t = F.col(ts)
    small = fits_broadcast(_expanded(schedules, run_at, stored, by_day=False))
    texts = _expanded(schedules, run_at, stored, by_day=not small)
    keyed = events.withColumn("minute_of_day", F.hour(t) * 60 + F.minute(t))
    if small:
        joined = keyed.join(F.broadcast(texts), "minute_of_day")
    else:
        joined = keyed.withColumn("day_of_month", F.dayofmonth(t)).join(texts, ["minute_of_day", "day_of_month"])
    hit = (
        C.in_mask(F.col("days_mask"), F.dayofmonth(t))
        & C.in_mask(F.col("months_mask"), F.month(t))
        & C.dow_matches(F.col("dow_mask"), t)
    )
    return joined.where(hit).select(*[F.col(c) for c in events.columns], "schedule")


def match_counts(
    events: DataFrame, schedules: DataFrame, ts: str, key: str = "chain_id", run_at: str = "run_at", stored: bool = True
) -> DataFrame:
    """Number of events hitting each schedule row; a NULL schedule is hit by every event.

    Events shrink to one row per calendar minute before anything is joined, so
    the shuffle carries minutes, not events, and no event is ever paired with
    the schedule rows that share a text.
    """
    minutes = events.groupBy(F.date_trunc("minute", F.col(ts)).cast("timestamp_ntz").alias("at")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_text = match_texts(minutes, schedules, "at", run_at, stored).groupBy("schedule").agg(F.sum("n").alias("n"))
    total = events.where(F.col(ts).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    fixed = schedules.where(F.col(run_at).isNotNull()).select(key, F.col(run_at).alias("schedule"))
    always = schedules.where(F.col(run_at).isNull()).select(key, total.scalar().alias("n_matches"))
    return (
        fixed.join(per_text, "schedule")
        .select(key, F.col("n").alias("n_matches"))
        .unionByName(always.where(F.col("n_matches") > 0))
    )


def months_of(schedules: DataFrame, from_ts: Column, run_at: str = "run_at") -> DataFrame:
    f = parsed_schedules(schedules, run_at)
    return f.select(run_at, F.explode(C.cron_months(from_ts, F.col("f.months"))).alias("month_start"))


def days_of(schedules: DataFrame, from_ts: Column, run_at: str = "run_at", sunday_seven: bool = False) -> DataFrame:
    f = parsed_schedules(schedules, run_at)
    days = C.cron_days(from_ts, F.col("f.months"), F.col("f.days"), F.col("f.dow"), sunday_seven)
    return f.select(run_at, F.explode(days).alias("day"))


def times_of(schedules: DataFrame, run_at: str = "run_at") -> DataFrame:
    f = parsed_schedules(schedules, run_at)
    return f.select(run_at, F.explode(C.cron_times(F.col("f.hours"), F.col("f.mins"))).alias("minute_of_day"))


def cron_runs(
    schedules: DataFrame,
    from_ts: Column,
    until: Column | None = None,
    run_at: str = "run_at",
    sunday_seven: bool = False,
) -> DataFrame:
    """Every run instant strictly after ``from_ts`` of each distinct schedule text.

    The horizon is whole months, up to and including the month a year ahead;
    ``until`` (inclusive) cuts it, and cuts days before times are expanded.
    """
    f = parsed_schedules(schedules, run_at)
    days = C.cron_days(from_ts, F.col("f.months"), F.col("f.days"), F.col("f.dow"), sunday_seven)
    first, last = F.to_date(from_ts), None if until is None else F.to_date(until)
    days = F.filter(days, lambda d: (d >= first) if last is None else (d >= first) & (d <= last))
    runs = (
        f.select(run_at, "f", F.explode(days).alias("day"))
        .select(run_at, "day", F.explode(C.cron_times(F.col("f.hours"), F.col("f.mins"))).alias("m"))
        .select(run_at, C.at_minute(F.col("day"), F.col("m")).alias("run_ts"))
        .where(F.col("run_ts") > from_ts)
    )
    return runs if until is None else runs.where(F.col("run_ts") <= until)


def next_runs(schedules: DataFrame, now: Column, key: str = "chain_id", run_at: str = "run_at", sunday_seven: bool = False) -> DataFrame:
    """Next run per schedule row, NULL when there is none or the text may not be stored.

    Searched once per distinct text; the join back has one row per text on its side.
    """
    texts = distinct_schedules(schedules.where(F.col(run_at).rlike(C.STORED)), run_at)
    found = texts.select(F.col(run_at), C.next_cron_run(F.col(run_at), now, sunday_seven).alias("next_run"))
    return schedules.select(key, run_at).join(found, run_at, "left").select(key, "next_run")


def classes(schedules: DataFrame, key: str = "chain_id", run_at: str = "run_at") -> DataFrame:
    s = F.col(run_at)
    return schedules.select(
        key, C.schedule_class(s).alias("schedule_class"), C.schedule_seconds(s).alias("interval_seconds")
    )


def every_ticks(schedules: DataFrame, anchor: Column, horizon: Column, key: str = "chain_id", run_at: str = "run_at") -> DataFrame:
    """Starts of @every schedules: the previous *start* plus the interval, anchor included.

    Ticks are generated in bounded pieces, so a short interval over a long
    horizon never builds one huge array.
    """
    span = (micros(horizon) - micros(anchor)).cast("bigint")
    step = F.col("interval_seconds") * 1_000_000
    d = (
        schedules.where(C.schedule_class(F.col(run_at)) == "every")
        .select(key, C.schedule_seconds(F.col(run_at)).alias("interval_seconds"))
        .where(F.col("interval_seconds") > 0)
        .withColumn("last_tick", F.floor(span / step))
        .where(F.col("last_tick") >= 0)
    )
    pieces = d.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last_tick") / TICKS_PER_ROW))))
    start = F.col("piece") * TICKS_PER_ROW
    ticks = F.sequence(start, F.least(start + TICKS_PER_ROW - 1, F.col("last_tick")))
    return pieces.select(key, "interval_seconds", F.explode(ticks).alias("i")).select(
        key, from_micros(micros(anchor) + F.col("i") * F.col("interval_seconds") * 1_000_000).alias("tick")
    )


def after_drift(runs: DataFrame, schedules: DataFrame, key: str = "chain_id") -> DataFrame:
    """Actual against expected start of @after schedules: previous *finish* plus the interval.

    ``runs`` has one row per run: key, run id ``txid``, ``started``, ``finished``.
    """
    waits = classes(schedules, key).where("schedule_class = 'after'").select(key, "interval_seconds")
    mine = blocked.placed(runs.join(waits, key), [key], ["started", "txid"])
    with_prev = blocked.previous(mine, [key], F.col("__at"), ["started", "txid"], {"prev_finished": F.col("finished")})
    expected = micros(F.col("prev_finished")) + F.col("interval_seconds") * 1_000_000
    return with_prev.where(F.col("prev_finished").isNotNull()).select(
        key,
        "txid",
        "started",
        from_micros(expected).alias("expected"),
        (micros(F.col("started")) - expected).alias("drift_us"),
    )


def due_now(schedules: DataFrame, client: str, now: Column, run_at: str = "run_at") -> DataFrame:
    """Live, client-eligible chains whose cron schedule hits ``now``; '@' schedules never do."""
    usual = schedules.where(~F.coalesce(F.col(run_at).startswith("@"), F.lit(False)))
    texts = distinct_schedules(usual, run_at)
    due = texts.where(C.is_cron_in_time(F.col(run_at), now))
    always = usual.where(F.col(run_at).isNull())
    return live_chains(always.unionByName(usual.join(due, run_at, "left_semi").select(*usual.columns)), client)


def missed_runs(
    schedules: DataFrame, log: DataFrame, from_ts: Column, until: Column, key: str = "chain_id", run_at: str = "run_at"
) -> DataFrame:
    """Expected instants without a logged start in the same minute."""
    expected = schedules.select(key, run_at).join(cron_runs(schedules, from_ts, until, run_at), run_at).select(key, "run_ts")
    started = log.select(
        F.col(key), F.date_trunc("minute", F.col("last_run")).cast("timestamp_ntz").alias("run_ts")
    ).distinct()
    return expected.join(started, [key, "run_ts"], "left_anti")


def missed_gaps(
    schedules: DataFrame, log: DataFrame, from_ts: Column, until: Column, key: str = "chain_id", run_at: str = "run_at"
) -> DataFrame:
    """Stretches of expected instants without a logged start: first and last of each, and how many.

    Instants are numbered once per schedule text. A chain's stretches lie between the numbers of those it met, so
    the rows are as many as met instants and chains, not as expected instants.
    """
    along = Window.partitionBy(run_at).orderBy("run_ts")
    numbered = cut_lineage(cron_runs(schedules, from_ts, until, run_at).withColumn("n", F.row_number().over(along)))
    minute = F.date_trunc("minute", F.col("last_run")).cast("timestamp_ntz")
    met = (
        log.select(key, minute.alias("run_ts")).distinct().join(schedules.select(key, run_at), key)
        .join(numbered, [run_at, "run_ts"]).select(key, run_at, "n")
    )
    ends = numbered.groupBy(run_at).agg((F.max("n") + 1).alias("n"))
    marks = met.unionByName(schedules.select(key, run_at).join(ends, run_at))
    # A chain has one mark per met minute at most.
    before = F.lag("n", 1, 0).over(Window.partitionBy(key).orderBy("n"))
    gaps = marks.withColumn("before", before).where("n - before > 1").select(
        key, run_at, (F.col("before") + 1).alias("first_n"), (F.col("n") - 1).alias("last_n"), (F.col("n") - F.col("before") - 1).cast("bigint").alias("missed")
    )
    for end in ("first", "last"):
        instants = numbered.select(run_at, F.col("n").alias(f"{end}_n"), F.col("run_ts").alias(f"{end}_missed"))
        gaps = gaps.join(instants, [run_at, f"{end}_n"])
    return gaps.select(key, "first_missed", "last_missed", "missed")


def missed_run_counts(
    schedules: DataFrame, log: DataFrame, from_ts: Column, until: Column, key: str = "chain_id", run_at: str = "run_at"
) -> DataFrame:
    """Expected, met and missed runs per chain, without listing instants per chain.

    Expected instants are counted once per schedule text; a chain's hits come
    from its logged minutes, each tested against its own text in place.
    """
    per_text = cron_runs(schedules, from_ts, until, run_at).groupBy(run_at).agg(F.count(F.lit(1)).alias("expected"))
    minute = F.date_trunc("minute", F.col("last_run")).cast("timestamp_ntz")
    texts = parsed_schedules(schedules, run_at).select(run_at, F.explode(F.array(C.field_masks(F.col("f")))).alias("m"))
    logged = (
        log.select(key, minute.alias("at"))
        .where((F.col("at") > from_ts) & (F.col("at") <= until))
        .distinct()
        .join(schedules.select(key, run_at), key)
        .join(texts, run_at)
    )
    at, m = F.col("at"), F.col("m")
    hit = (
        C.in_mask(m["months"], F.month(at))
        & C.in_mask(m["dow"], C.dow0(at))
        & C.in_mask(m["days"], F.dayofmonth(at))
        & C.in_mask(m["hours"], F.hour(at))
        & C.in_mask(m["mins"], F.minute(at))
    )
    met = logged.where(hit).groupBy(key).agg(F.count(F.lit(1)).alias("met"))
    return (
        schedules.select(key, run_at)
        .join(per_text, run_at)
        .join(met, key, "left")
        .select(
            key,
            "expected",
            F.coalesce("met", F.lit(0)).alias("met"),
            (F.col("expected") - F.coalesce("met", F.lit(0))).alias("missed"),
        )
    )
