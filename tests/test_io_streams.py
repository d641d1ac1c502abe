"""Files, pipes and streams on small hand rows."""

import json
import tempfile
import time
import types
from datetime import timedelta

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.functions import jsonfn
from tickloom.functions.cron import flags_to_cron
from tickloom.session import work_dir
from tickloom.sources import transfer
from tickloom.sources.entries import read_entries, read_flushes
from tickloom.streaming import runs, signals

MESSAGES = [
    ('{"ConfigID": 71, "Command": "START", "Ts": 5002, "Delay": 45}', None),
    ('{"ConfigID": 70, "Command": "STOP", "Ts": 5000}', None),
    ('{"ConfigID": 70, "Command": "STOP", "Ts": 5000, "Delay": 0}', None),  # equal to the second
    ('{"ConfigID": 71, "Command": "START", "Ts": 5002}', None),  # the first without its delay
    ('{"ConfigID": 72, "Command": "START", "Ts": 1500}', None),  # nearly an hour late
    ('{"configid": 74, "COMMAND": "STOP", "ts": 1600, "dElAy": null}', None),
    ('{"ConfigID": 5, "configid": "x", "Command": "STOP"}', "json"),  # one spelling of the wrong type
    ('{"ConfigID": -9, "Command": "STOP", "Ts": 5003}', "chain"),
    ('{"ConfigID": 73, "Command": "PAUSE", "Ts": 5003}', "command"),
    ('{"ConfigID": 73, "Ts": 5003}', "command"),
    ("{unquoted", "json"),
    ('{"ConfigID": 73, "Command": "STOP", "Ts": "noon"}', "json"),
    ('"STOP"', "json"),
    ("7", "json"),
]
HANDLED = [(70, "STOP", 5000, 0), (71, "START", 5002, 0), (71, "START", 5002, 45), (72, "START", 1500, 0), (74, "STOP", 1600, 0)]


def test_signals_batch(spark):
    parsed = signals.parse_signals(spark.createDataFrame([(m,) for m, _ in MESSAGES], "payload string").coalesce(1))
    assert [r.reason for r in parsed.collect()] == [reason for _, reason in MESSAGES]
    assert rows(signals.dedup_signals(signals.accepted(parsed)), *signals.SIGNAL_KEY) == HANDLED
    assert signals.rejected(parsed).count() == 8


@pytest.mark.parametrize("order", [range(len(MESSAGES)), [4, 8, 2, 12, 0, 10, 3, 13, 1, 11, 5, 9, 6, 7]])
def test_signals_over_several_triggers(spark, order):
    """However files fall into triggers, each signal comes out once, late ones too: what the batch gives."""
    folder = work_dir(spark, "test-signals")
    for i in order:
        spark.createDataFrame([(i, MESSAGES[i][0])], "i int, payload string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("i int, payload string").option("maxFilesPerTrigger", 3).parquet(folder)
    fresh = signals.dedup_signals(signals.accepted(signals.parse_signals(stream)))
    got = runs.with_rocksdb(spark, lambda: runs.drain(fresh, "test-dedup"))
    assert rows(got, *signals.SIGNAL_KEY) == HANDLED


def test_signals_are_forgotten(spark):
    """A signal that comes once more is handled again only when it is no longer remembered."""
    def handled(remembered, pause):
        folder, base = work_dir(spark, "test-signals"), work_dir(spark, "test-forget")
        for _ in range(2):
            spark.createDataFrame([(MESSAGES[1][0],)], "payload string").coalesce(1).write.mode("append").parquet(folder)
            stream = signals.parse_signals(spark.readStream.schema("payload string").parquet(folder))
            query = (
                signals.dedup_signals(signals.accepted(stream), remembered).writeStream.format("parquet")
                .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            )
            query.awaitTermination()
            time.sleep(pause)
        return spark.read.parquet(f"{base}/rows").count()

    assert runs.with_rocksdb(spark, lambda: handled(timedelta(milliseconds=500), 2)) == 2
    assert runs.with_rocksdb(spark, lambda: handled(timedelta(hours=1), 0)) == 1


class _List:
    """A list state that counts what is asked of it."""

    def __init__(self):
        self.values, self.calls = [], 0

    def exists(self):
        self.calls += 1
        return bool(self.values)

    def get(self):
        self.calls += 1
        return iter(self.values)

    def appendValue(self, value):
        self.calls += 1
        self.values.append(value)


def test_state_is_asked_once_for_many_signals():
    """A part's signals of a trigger are handled together, whatever their number; those of earlier triggers stay out, nulls too."""
    state = _List()
    unseen = signals._Unseen(timedelta(minutes=1))
    unseen.init(types.SimpleNamespace(getListState=lambda *_: state))

    def trigger(*signals_):
        frame = pd.DataFrame(signals_, columns=signals.SIGNAL_KEY, dtype=object)
        state.calls = 0
        return [tuple(r) for out in unseen.handleInputRows((0,), iter([frame[:2], frame[2:]]), None) for r in out.itertuples(index=False)]

    first = [(str(i), "START", str(2**60 + i), "0") for i in range(3_000)]
    assert trigger(*first, first[7], first[0]) == first and state.calls <= 3
    assert trigger(first[5], (None, "STOP", "1", None), first[0], (None, "STOP", "1", None)) == [(None, "STOP", "1", None)]
    assert trigger(first[9], (None, "STOP", "1", None)) == [] and state.calls <= 3


def test_starts_wait_for_their_time_and_are_cancelled(spark):
    """Over three triggers of one query: due at once, cancelled before, while waiting and after, and fired by the clock."""
    folder, base = work_dir(spark, "test-delay"), work_dir(spark, "test-delay-state")
    schema, now = "config_id long, command string, signal_ts long, delay long", int(time.time())
    stream = lambda: signals.delayed_starts(spark.readStream.schema(schema).parquet(folder))

    def trigger(*came):
        spark.createDataFrame(list(came), schema).coalesce(1).write.mode("append").parquet(folder)
        runs.with_rocksdb(spark, lambda: stream().writeStream.format("parquet").option("path", f"{base}/rows").option(
            "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination())
        return set(rows(spark.read.schema("config_id long, signal_ts long, effective_ts long").parquet(f"{base}/rows"), "config_id", "signal_ts", "effective_ts"))

    first = trigger(
        (1, "START", 100, 5), (1, "STOP", 106, 0), (2, "START", 100, 5), (2, "STOP", 105, 0), (3, "START", 100, 0), (3, "STOP", 100, 0),
        (4, "START", now, 3_600), (5, "START", now, 12), (5, "START", now, 3_600), (6, "STOP", 200, 0), (8, "STOP", 90, 0),
    )
    assert first == {(1, 100, 105)}
    # The STOP of 4 comes while it waits, that of 6 came before; 7 has no STOP of its own.
    second = trigger((4, "STOP", now + 5, 0), (6, "START", 195, 9), (7, "START", 195, 9), (8, "START", 100, 0))
    assert second - first == {(7, 195, 204), (8, 100, 100)}
    time.sleep(max(0, now + 13 - time.time()))
    assert trigger((9, "START", 1, 0)) - second == {(9, 1, 1), (5, now, now + 12)}


def test_resolve_commands(spark):
    df = spark.createDataFrame([(1, "START", 5, 2), (1, "STOP", 9, 0), (2, "STOP", 1, 0), (2, "START", 3, 4)], "config_id long, command string, signal_ts long, delay long")
    assert rows(signals.resolve_commands(df), "config_id", "command", "effective_ts") == [(1, "STOP", 9), (2, "START", 7)]


def test_csv_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="tickloom-test-")
    with open(f"{folder}/in.csv", "w") as f:
        f.write("40,pear\n41,fig\n")
    assert transfer.load_csv(spark, f"{folder}/in.csv", "id int, fruit string", f"{folder}/table") == 2
    assert rows(spark.read.parquet(f"{folder}/table"), "id", "fruit") == [(40, "pear"), (41, "fig")]
    assert transfer.export_csv(transfer.series(spark, 1, 5), f"{folder}/out") == 5
    with pytest.raises(Exception):
        transfer.load_csv(spark, f"{folder}/none.csv", "id int", f"{folder}/table2")
    with pytest.raises(Exception):
        transfer.read_csv(spark, f"{folder}/in.csv", "id int, fruit int").collect()


def test_programs(spark):
    assert rows(transfer.run_program(spark, "printf '1,a\\n2,b\\n'", "n int, s string"), "n", "s") == [(1, "a"), (2, "b")]
    with pytest.raises(Exception):
        transfer.pipe_out(transfer.series(spark, 1, 5), "false").collect()


def test_programs_as_a_source(spark):
    """One process and one partition for each command; a bad exit code or a bad line fails the read."""
    rows_of = transfer.run_program(spark, ["seq 1 5000", "printf '7000\\n'", "true"], "n int")
    assert rows_of.rdd.getNumPartitions() == 3
    assert rows(rows_of, "n") == sorted([(i,) for i in [*range(1, 5001), 7000]], key=repr)
    for bad in (["seq 1 3", "exit 3"], ["echo word"]):
        with pytest.raises(Exception):
            transfer.run_program(spark, bad, "n int").collect()


@pytest.mark.parametrize("command", ["cat", "sort -n", "awk '{print; print; print}'", "head -n 1", "cat >/dev/null", "yes | head -n 300000"])
def test_pipes_do_not_block(spark, command):
    """Programs that write before, while and after they read, much more or less than they read, or stop reading."""
    out = transfer.pipe_out(transfer.series(spark, 1, 60_000).coalesce(1), command).agg(F.count("*"), F.min("line")).first()
    want = {"cat": 60_000, "sort -n": 60_000, "awk '{print; print; print}'": 180_000, "head -n 1": 1, "cat >/dev/null": 0}
    assert out[0] == want.get(command, 300_000)


def test_log_is_compacted_by_measured_rows(spark):
    """A hot day gets several files of about the same size, small days one each, and no row is lost."""
    log = spark.range(9_000).selectExpr("id AS exec_id", "IF(id < 8000, DATE'2024-01-01', DATE'2024-01-02' + CAST(id % 4 AS INT)) AS run_date").repartition(20)
    target = work_dir(spark, "test-compact")
    assert transfer.compact(log, target, "run_date", ["exec_id"], rows_per_file=2_000) == 9_000
    sizes = spark.read.parquet(target).groupBy("run_date", F.input_file_name()).count().collect()
    assert sum(r["count"] for r in sizes) == 9_000
    hot = [r["count"] for r in sizes if r.run_date.day == 1]
    assert 2 <= len(hot) <= 4 and max(hot) <= 4_500 and len(sizes) - len(hot) == 4


def test_entries_flush_by_size_or_time_and_go_on(spark):
    """A backlog goes by size, a rest after the time; a second run takes what has been added, nothing twice."""
    folder, base = work_dir(spark, "test-entries"), work_dir(spark, "test-entries-out")
    schema = spark.range(0).schema

    def add(first, n, name):
        spark.range(first, first + n).coalesce(1).write.parquet(f"{folder}-{name}")
        import glob
        import os
        import shutil
        os.makedirs(folder, exist_ok=True)
        shutil.copy(glob.glob(f"{folder}-{name}/*.parquet")[0], f"{folder}/{name}.parquet")

    def run():
        sizes = []
        stream = read_entries(spark, folder, schema, rows=40, seconds=0.3)
        query = stream.writeStream.foreachBatch(lambda b, i: (sizes.append(b.count()), b.write.mode("overwrite").parquet(f"{base}/batch={i}"))).option("checkpointLocation", f"{base}-state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sizes

    add(0, 90, "a")
    assert run() == [40, 40, 10]
    add(90, 25, "b")
    add(115, 50, "c")
    assert run() == [40, 35]
    assert sorted(r.id for r in spark.read.parquet(base).collect()) == list(range(165))


def test_full_flushes_share_a_trigger(spark):
    """All flushes that are full go in one trigger, numbered on over files, row groups, triggers and runs; a rest goes after the time."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    folder, base = work_dir(spark, "test-flushes"), work_dir(spark, "test-flushes-out")
    os.makedirs(folder)

    def run():
        sizes = []
        stream = read_flushes(spark, folder, spark.range(0).schema, rows=4, seconds=0.3)
        query = stream.writeStream.foreachBatch(lambda b, i: (sizes.append(b.count()), b.write.mode("overwrite").parquet(f"{base}/batch={i}"))).option("checkpointLocation", f"{base}-state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sizes

    pq.write_table(pa.table({"id": list(range(7))}), f"{folder}/a.parquet", row_group_size=3)
    pq.write_table(pa.table({"id": list(range(7, 15))}), f"{folder}/b.parquet", row_group_size=5)
    assert run() == [12, 3]
    pq.write_table(pa.table({"id": list(range(15, 25))}), f"{folder}/c.parquet")
    assert run() == [8, 2]
    want = [(i, i // 4) for i in range(15)] + [(i, 4 + (i - 15) // 4) for i in range(15, 25)]
    assert rows(spark.read.parquet(base), "id", "flush") == sorted(want, key=repr)


def test_log_policy(spark):
    log = spark.createDataFrame([(0, False, " x "), (-1, True, ""), (-1, False, "  "), (-1, None, "y")], "returncode int, ignore_error boolean, output string")
    assert transfer.keep_by_policy(log, "none").count() == 0
    assert rows(transfer.keep_by_policy(log, "error"), "output") == [("y",), (None,)]
    assert rows(transfer.keep_by_policy(log, "all"), "output") == [("x",), ("y",), (None,), (None,)]


def test_json_values(spark):
    doc = '{"pairs":[{"name":"cGVhcg==","colour":"Z3JlZW4="}]}'
    df = spark.createDataFrame([(doc,)], "d string").select(F.explode(jsonfn.elements(F.col("d"), "$.pairs")).alias("e"))
    pair = df.select(*[jsonfn.decoded(F.try_variant_get("e", f"$.{k}", "string")).alias(k) for k in ("name", "colour")])
    assert rows(pair, "name", "colour") == [("pear", "green")]
    kinds = spark.createDataFrame([(x,) for x in ('{"a":1}', "[1]", '"s"', "1.5", "true", "null", "oops")], "d string").coalesce(1)
    assert [r[0] for r in kinds.select(jsonfn.kind(F.col("d"))).collect()] == ["object", "array", "string", "number", "boolean", "null", None]
    signal = spark.range(1).select(jsonfn.start_signal(F.lit(3), F.lit("1970-01-01 00:00:09").cast("timestamp"), F.lit(None).cast("int")))
    assert json.loads(signal.first()[0]) == {"ConfigID": 3, "Command": "START", "Ts": 9, "Delay": 0}


def test_flags(spark):
    df = spark.createDataFrame([([True, False, True],), ([False, False],)], "f array<boolean>").coalesce(1)
    assert [tuple(r) for r in df.select(flags_to_cron(F.col("f")), flags_to_cron(F.col("f"), 1)).collect()] == [("0,2", "1,3"), ("*", "*")]
