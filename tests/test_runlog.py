"""Run-log operators against hand rows and brute force."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.operators import blocked, runlog

T0 = datetime(2024, 1, 1)


def test_outcomes(spark):
    log = spark.createDataFrame(
        [
            # all ok / ignored failure then ok / hard failure in the middle / failure with unknown ignore flag
            (1, 1, 10.0, 0, False), (1, 1, 20.0, 0, False),
            (1, 2, 10.0, -1, True), (1, 2, 20.0, 0, False),
            (1, 3, 10.0, 0, False), (1, 3, 20.0, -1, False), (1, 3, 30.0, 0, False),
            (1, 4, 10.0, -1, None),
        ],
        "chain_id bigint, txid bigint, task_order double, returncode int, ignore_error boolean",
    ).withColumns(
        {
            "client_name": F.lit("w"), "exec_id": F.col("txid") * 100 + F.col("task_order").cast("bigint"),
            "last_run": F.lit(T0), "finished": F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("task_order").cast("int")),
        }
    )
    got = {r.txid: (r.outcome, r.failed_order) for r in runlog.chain_runs(log).collect()}
    assert got == {1: ("COMPLETED", None), 2: ("COMPLETED", None), 3: ("FAILED", 20.0), 4: ("FAILED", 10.0)}
    steps = {(r.txid, r.task_order): r.status for r in runlog.step_status(log).collect()}
    assert steps[(3, 30.0)] == "skipped" and steps[(2, 10.0)] == "ignored" and steps[(4, 10.0)] == "failed"
    assert runlog.row_count(log.where(runlog.is_error())).first().n == 2


def test_retry_bounds_are_inclusive(spark):
    times = [0, 10, 20, 310, 1000]
    log = spark.createDataFrame(
        [(i, 1, "w", T0 + timedelta(seconds=s), -1) for i, s in enumerate(times)],
        "exec_id int, chain_id int, client_name string, finished timestamp, returncode int",
    )
    got = {r.exec_id: (r.retries, r.delay_us) for r in runlog.retry_backoff(log, 3, 10, 300).collect()}
    # at 310: 10 and 20 are in [10, 300]; at 1000 nothing is left
    assert got == {0: (0, 10_000_000), 1: (1, 20_000_000), 2: (2, 20_000_000), 3: (2, 580_000_000), 4: (0, 10_000_000)}
    stats = runlog.retry_statistics(log, F.lit(T0 + timedelta(seconds=310)), 300, 10).first()
    assert stats.retries == 2 and stats.last_failure == T0 + timedelta(seconds=20)


def brute_admission(runs, caps, clear_all):
    active, out = {}, {}
    edges = sorted(
        [(s, 1, i, c, w) for i, c, w, s, f in runs] + [(f, 0, i, c, w) for i, c, w, s, f in runs], key=lambda e: e[:3]
    )
    for _, is_start, i, chain, client in edges:
        mine = active.setdefault(chain, {})
        if is_start:
            ok = caps[chain] is None or sum(h for _, h in mine.values()) < caps[chain]
            if ok:
                mine[i] = (client, True)
            out[i] = ok
        elif i in mine:
            del mine[i]
            if clear_all:
                for k, (w, h) in mine.items():
                    mine[k] = (w, h and w != client)
    return out


def hot_runs(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        chain = rng.choice([0, 0, 0, 1, 2, 3])
        start = rng.randrange(0, 40_000)
        out.append((i, chain, f"w{rng.randrange(3)}", start, start + rng.randrange(1, 900)))
    return out


@pytest.mark.parametrize("clear_all", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_admission_against_brute_force(spark, seed, clear_all):
    data, caps = hot_runs(seed), {0: 3, 1: 1, 2: None, 3: 0}
    runs = spark.createDataFrame(
        [(c, i, w, T0 + timedelta(seconds=s), T0 + timedelta(seconds=f)) for i, c, w, s, f in data],
        "chain_id bigint, txid bigint, client_name string, started timestamp, finished timestamp",
    )
    limits = spark.createDataFrame(list(caps.items()), "chain_id bigint, max_instances int")
    got = {r.txid: r.admitted for r in runlog.admission(runs, limits, clear_all, None, block_rows=9).collect()}
    assert got == brute_admission(data, caps, clear_all)


@pytest.mark.parametrize("blocks", [64, 256])
def test_admission_rounds_grow_with_the_logarithm_of_the_blocks(spark, monkeypatch, blocks):
    """Two clients by turns keep both places: what the first block leaves decides all others."""
    data = [(i, 1, f"w{i % 2}", 60 * i, 60 * i + 125 + 7 * (i % 3)) for i in range(4 * blocks)]
    runs = spark.createDataFrame(
        [(c, i, w, T0 + timedelta(seconds=s), T0 + timedelta(seconds=f)) for i, c, w, s, f in data],
        "chain_id bigint, txid bigint, client_name string, started timestamp, finished timestamp",
    )
    limits = spark.createDataFrame([(1, 2)], "chain_id bigint, max_instances int")
    rounds = []
    count = runlog.cut_and_count
    monkeypatch.setattr(runlog, "cut_and_count", lambda *a: rounds.append(1) or count(*a))
    got = {r.txid: r.admitted for r in runlog.admission(runs, limits, False, None, block_rows=4).collect()}
    assert got == brute_admission(data, {1: 2}, False)
    assert len(rounds) <= blocks.bit_length()


def test_concurrency_and_overlaps_against_brute_force(spark):
    data = hot_runs(7, 300)
    runs = spark.createDataFrame(
        [(c, i, w, T0 + timedelta(seconds=s), T0 + timedelta(seconds=f)) for i, c, w, s, f in data],
        "chain_id bigint, txid bigint, client_name string, started timestamp, finished timestamp",
    )
    exclusive = spark.createDataFrame([(0, True), (1, False), (2, True)], "chain_id bigint, exclusive_execution boolean")
    got = {r.txid: r.n_overlaps for r in runlog.exclusive_overlaps(runs, exclusive).collect()}
    want = {
        i: sum(1 for j, _, w2, s2, f2 in data if j != i and w2 == w and s2 < f and s < f2)
        for i, c, w, s, f in data if c in (0, 2)
    }
    assert got == want
    peaks = dict(rows(runlog.peak_concurrency(runs), "chain_id", "peak"))
    for chain in (0, 1, 2, 3):
        mine = [(s, f) for _, c, _, s, f in data if c == chain]
        assert peaks[chain] == max(sum(1 for s2, f2 in mine if s2 <= s < f2) for s, _ in mine)


def test_a_hot_key_and_hour_is_cut_by_rows(spark):
    """90 % of the rows in one key and hour: no block holds much more than its share, and the figures are the plain ones.

    So few rows would be one block; adaptive execution is kept from putting small ones together.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _hot_key_and_hour(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _hot_key_and_hour(spark):
    rng = random.Random(11)
    log = [(i, 1, "w", T0 + timedelta(seconds=rng.uniform(0, 3_600)), -1) for i in range(9_000)]
    log += [(9_000 + i, rng.choice([1, 2, 3]), "w", T0 + timedelta(hours=rng.uniform(-20, 20)), -1) for i in range(1_000)]
    df = spark.createDataFrame(log, "exec_id int, chain_id int, client_name string, finished timestamp, returncode int").repartition(6)
    sizes = [r["count"] for r in blocked.placed(df, ["chain_id"], ["finished"]).groupBy("chain_id", "__at").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 2 * 10_000 / 8
    got = {r.exec_id: r.retries for r in runlog.retry_backoff(df, 5, 2, 30).collect()}
    times = {}
    for i, chain, _, at, _ in log:
        times.setdefault(chain, []).append(at)
    for line in times.values():
        line.sort()
    for i, chain, _, at, _ in rng.sample(log, 500):
        line = times[chain]
        assert got[i] == bisect.bisect_right(line, at - timedelta(seconds=2)) - bisect.bisect_left(line, at - timedelta(seconds=30))


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "b", None]), i, rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    block = F.floor(F.col("o") / 40)
    sums = blocked.running_sum(df, ["k"], block, [F.col("o")], F.col("v"), "s")
    lags = blocked.previous(df, ["k"], block, ["o"], {"p": F.col("v")})
    order = blocked.global_row_number(df, [F.col("v"), F.col("o")], "n")
    want_sum, want_lag, totals, last = {}, {}, {}, {}
    for k, o, v in sorted(data, key=lambda r: r[1]):
        totals[k] = totals.get(k, 0) + v
        want_sum[o], want_lag[o] = totals[k], last.get(k)
        last[k] = v
    assert dict(rows(sums, "o", "s")) == want_sum
    assert dict(rows(lags, "o", "p")) == want_lag
    ranked = sorted(data, key=lambda r: (r[2], r[1]))
    assert dict(rows(order, "o", "n")) == {r[1]: i + 1 for i, r in enumerate(ranked)}
