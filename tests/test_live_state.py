"""Live counts, open starts and admission: whatever the order in which rows come, as in the batch form."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.operators import runlog
from tickloom.session import work_dir
from tickloom.streaming import admission, ledger, runs

T0 = datetime(2024, 1, 1)
LOG = "exec_id bigint, chain_id bigint, client_name string, last_run timestamp, finished timestamp, returncode int, ignore_error boolean"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def in_files(spark, parts, schema, label):
    """A stream that gets one of ``parts`` per trigger."""
    folder = work_dir(spark, label)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def log_rows(seed, n=400):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        start = draw.randrange(0, 36_000)
        out.append((i, draw.choice([0, 0, 0, 1, 2, 9]), draw.choice(["a", "b", None]), at(start), at(start + draw.choice([0, 1, 30, 600, 900])),
                    draw.choice([0, 0, -1]), draw.choice([True, False, None])))
    return out


def scattered(data, seed, parts=3):
    shuffled = random.Random(seed).sample(data, len(data))
    return [shuffled[i::parts] for i in range(parts)]


def test_minute_counts_keep_every_row(spark):
    data, base = log_rows(1), work_dir(spark, "test-counts")
    ledger.count_minutes(in_files(spark, scattered(data, 4), LOG, "test-log"), base).awaitTermination()
    whole = spark.createDataFrame(data, LOG)
    columns = ["minute", "total", "errors", "ignored_errors"]
    assert rows(ledger.minutes(spark, base), *columns) == rows(runlog.minute_counts(whole), *columns)
    closed = ledger.minutes(spark, base, "2024-01-01 05:00:00")
    assert rows(closed, *columns) == rows(runlog.minute_counts(whole).where("minute <= '2024-01-01 04:59:00'"), *columns)


def test_late_rows_are_told_apart_and_merged(spark):
    """The row of 00:20 comes after 01:10 has been seen; that of 01:09 is behind, but its minute is still open."""
    one = lambda i, s, rc=0: (i, 1, "a", at(s), at(s), rc, False)
    parts = [[one(1, 1200)], [one(2, 4200)], [one(3, 1210, -1), one(4, 4140)], [one(5, 5400)], [one(6, 1200)]]
    base = work_dir(spark, "test-late")
    ledger.count_minutes(in_files(spark, parts, LOG, "test-log"), base).awaitTermination()
    got = {(r.minute - T0).total_seconds() / 60: (r.total, r.errors, r.late) for r in ledger.minutes(spark, base).collect()}
    assert got == {20: (3, 1, 2), 69: (1, 0, 0), 70: (1, 0, 0), 90: (1, 0, 0)}


def test_counts_of_no_rows(spark):
    base = work_dir(spark, "test-none")
    query = ledger.count_minutes(in_files(spark, [[]], LOG, "test-log"), base)
    query.awaitTermination()
    assert ledger.dead_starts(spark, work_dir(spark, "test-none"), None, 600).count() == 0


STATUS = "run_status_id bigint, start_status_id bigint, chain_id bigint, created_at timestamp, client_name string"


@pytest.mark.parametrize("seed", [1, 2])
def test_dead_starts_in_any_order(spark, seed):
    draw, data, dead = random.Random(seed), [], set()
    for i in range(200):
        start = draw.randrange(0, 50_000)
        data.append((2 * i, None, i % 7, at(start), "a"))
        waits = draw.choice([[], [0], [600], [601], [-1], [4_000, 30], [700, 800]])
        data += [(1000 + len(data), 2 * i, i % 7, at(start + w), "a") for w in waits]
        if not any(0 <= w <= 600 for w in waits):
            dead.add((2 * i, start))
    data.append((9_999, 8_888, 1, at(5), "a"))  # the finish of a start that is not there
    base = work_dir(spark, "test-dead")
    query = ledger.track_starts(ledger.start_edges(in_files(spark, scattered(data, seed, 4), STATUS, "test-status")), base, 600)
    query.awaitTermination()
    last = ledger.last_batch(query)
    assert {r[0] for r in ledger.dead_starts(spark, base, last, 600).collect()} == {i for i, _ in dead}
    now = ledger.dead_starts(spark, base, last, 600, now=str(at(20_000)))
    assert {r[0] for r in now.collect()} == {i for i, s in dead if s + 600 < 20_000}


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame([(0, 3), (1, 1), (2, None), (9, 0)], "chain_id bigint, max_instances int")


def batch_decisions(data, limits, clear_all=True):
    attempts = data.select("chain_id", F.col("exec_id").alias("txid"), "client_name", F.col("last_run").alias("started"), "finished")
    return runlog.admission(attempts, limits, clear_all)


@pytest.mark.parametrize("clear_all", [True, False])
def test_live_admission_in_any_order(spark, limits, clear_all):
    """Files whose rows are of any time, and a watermark that waits for all of them: the decisions of the batch form."""
    data = log_rows(3)
    edges = admission.run_edges(in_files(spark, scattered(data, 5), LOG, "test-log"), limits)
    got = admission.decided_to_the_end(edges, "test-any", lateness_s=40_000, slot_s=3_600, clear_all=clear_all)
    assert rows(got, "run_id", "admitted") == rows(batch_decisions(spark.createDataFrame(data, LOG), limits, clear_all), "txid", "admitted")


def test_a_start_does_not_see_later_finishes(spark):
    """One place; the second run starts while the first one has not finished, though its finish is known by then."""
    one = spark.createDataFrame([(1, 1)], "chain_id bigint, max_instances int")
    run = lambda i, s, f: (i, 1, "a", at(s), at(f), 0, False)
    edges = admission.run_edges(in_files(spark, [[run(1, 0, 1800)], [run(2, 600, 1200)], [run(3, 1800, 1900)]], LOG, "test-log"), one)
    got = admission.decided_to_the_end(edges, "test-later", lateness_s=60, slot_s=60)
    assert rows(got, "run_id", "admitted") == [(1, True), (2, False), (3, True)]


def test_decisions_come_with_the_watermark_and_late_starts_are_listed(spark, limits):
    """In order, all but the last slots are decided before the end; a start beyond the lateness is listed, not lost."""
    data = sorted(log_rows(8), key=lambda r: r[3])
    parts = [data[:150], data[150:300], data[300:]]
    late = [(900, 0, "a", at(1), at(2), 0, False)]
    edges = admission.run_edges(in_files(spark, [*parts, late], LOG, "test-log"), limits)
    early = runs.with_rocksdb(spark, lambda: runs.drain(admission.live_admission(edges, 60, 600), "test-early"), no_data_batches=True)
    assert early.count() >= 300
    ended = admission.decided_to_the_end(edges, "test-ended", lateness_s=60, slot_s=600)
    assert rows(ended, "run_id", "admitted") == rows(batch_decisions(spark.createDataFrame(data, LOG), limits), "txid", "admitted")
    all_edges = admission.run_edges(spark.createDataFrame(data + late, LOG), limits)
    assert rows(admission.undecided(all_edges, ended), "chain_id", "run_id") == [(0, 900)]
