"""Run-log analytics: dashboard figures, outcomes, retries, concurrency, admission."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.binding import micros
from tickloom.operators import blocked
from tickloom.operators.jobs import DEFAULT_MAX_INSTANCES
from tickloom.session import cut_and_count, cut_lineage, fits_broadcast, ship_by_value

ship_by_value(__name__)

# Upper bounds of the duration histogram in seconds (inclusive).
DURATION_BOUNDS = (0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)

# Start attempts that are folded one after the other before any state is compared.
BLOCK_ROWS = 500_000


def in_range(log: DataFrame, start: Column, end: Column, clients: Sequence[str], ts: str = "last_run") -> DataFrame:
    """Rows of a time range (both ends included) and a set of clients; pushed to the scan."""
    return log.where(F.col(ts).between(start, end) & F.col("client_name").isin(*clients))


def is_error() -> Column:
    """A failed step counts unless it is ignored; an unknown ignore flag does not excuse it."""
    return (F.col("returncode") != 0) & ~F.coalesce(F.col("ignore_error"), F.lit(False))


# --- single figures ----------------------------------------------------------


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def enabled_chains(chains: DataFrame, clients: Sequence[str]) -> DataFrame:
    """live and no client, *or* a named client: AND binds first, so paused chains of a client count."""
    named = F.col("client_name").isin(*clients)
    return row_count(chains.where((F.col("live") & F.col("client_name").isNull()) | named))


def average_duration(log: DataFrame) -> DataFrame:
    """Mean duration of successful steps in seconds, from an exact integer sum."""
    us = micros(F.col("finished")) - micros(F.col("last_run"))
    return log.where("returncode = 0").agg(
        F.round(F.sum(us) / F.nullif(F.count(F.lit(1)), F.lit(0)) / F.lit(1e6), 6).alias("avg_seconds")
    )


def distinct_count(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def minute_counts(log: DataFrame, ts: str = "finished") -> DataFrame:
    """Per minute: all runs, errors, ignored errors. Works on a batch and on a watermarked stream."""
    failed = F.col("returncode") != 0
    return (
        log.groupBy(F.window(ts, "1 minute").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(is_error()).alias("errors"),
            F.count_if(failed & F.col("ignore_error")).alias("ignored_errors"),
        )
        .select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "total", "errors", "ignored_errors")
    )


def run_report(log: DataFrame) -> DataFrame:
    """Success, failures, total and success ratio per chain and run."""
    return (
        log.groupBy("chain_id", "txid")
        .agg(
            F.count_if(F.col("returncode") == 0).alias("success"),
            F.count_if(F.col("returncode") != 0).alias("fail"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("ratio", F.round(F.lit(100.0) * F.col("success") / F.greatest(F.col("total"), F.lit(1)), 6))
    )


def latest_errors(log: DataFrame, now: Column, n: int = 50) -> DataFrame:
    """The ``n`` latest errors with their age. Unlike the error count, an unknown ignore flag drops the row."""
    return (
        log.where((F.col("returncode") != 0) & ~F.col("ignore_error"))
        .orderBy(F.col("finished").desc(), F.col("exec_id").desc())
        .limit(n)
        .select(
            F.round((micros(now) - micros(F.col("finished"))) / F.lit(1e6)).cast("bigint").alias("finished_ago"),
            F.col("last_run").alias("started_on"),
            "exec_id", "client_name", "chain_id", "task_id", "command", "returncode",
        )
    )


def last_runs(log: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` log rows per chain. The rank filter also runs before the shuffle, per input task."""
    w = Window.partitionBy("chain_id").orderBy(F.col("finished").desc(), F.col("exec_id").desc())
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


# --- outcomes and counters ---------------------------------------------------


def chain_runs(log: DataFrame) -> DataFrame:
    """One row per run: start, finish, the step that failed it, and the outcome.

    A run fails at its first failed step that is not ignored; steps after that
    one never ran, so they do not move the finish. A run belongs to one client,
    so the client is part of the key: every aggregate then has a fixed-width
    buffer and the plan stays a hash aggregate.
    """
    bad_order = F.when(is_error(), F.col("task_order"))
    return (
        log.groupBy("chain_id", "txid", "client_name")
        .agg(
            F.min("last_run").alias("started"),
            F.max("finished").alias("last_finished"),
            F.min(bad_order).alias("failed_order"),
            F.min_by("finished", bad_order).alias("bad_finished"),
        )
        .select(
            "chain_id", "txid", "client_name", "started",
            F.when(F.col("failed_order").isNull(), F.col("last_finished")).otherwise(F.col("bad_finished")).alias("finished"),
            "failed_order",
            F.when(F.col("failed_order").isNull(), "COMPLETED").otherwise("FAILED").alias("outcome"),
        )
    )


def step_status(log: DataFrame) -> DataFrame:
    """ok / ignored / failed / skipped for each step of each run."""
    runs = chain_runs(log).select("chain_id", "txid", F.col("client_name").alias("__client"), "failed_order")
    order, failed = F.col("task_order"), F.col("failed_order")
    status = (
        F.when(order > failed, "skipped")
        .when(is_error(), "failed")
        .when(F.col("returncode") != 0, "ignored")
        .otherwise("ok")
    )
    return log.join(runs.withColumnsRenamed({"chain_id": "__chain", "txid": "__txid"}), F.expr(
        "chain_id = __chain AND txid = __txid AND client_name <=> __client")).select("chain_id", "txid", "task_order", "exec_id", status.alias("status"))


def started_by_client(runs: DataFrame) -> DataFrame:
    return runs.groupBy("client_name").agg(F.count(F.lit(1)).alias("n"))


def outcome_by_client(runs: DataFrame, outcome: str) -> DataFrame:
    return started_by_client(runs.where(F.col("outcome") == outcome))


def executed_by_kind(log: DataFrame) -> DataFrame:
    """Tasks executed by client and kind; several parameter rows of one task are one execution."""
    once = log.select("client_name", "kind", "chain_id", "txid", "task_id", "task_order").distinct()
    return once.groupBy("client_name", "kind").agg(F.count(F.lit(1)).alias("n"))


def duration_histogram(runs: DataFrame) -> DataFrame:
    """Completed runs per client and duration bucket; the last bucket is open."""
    us = micros(F.col("finished")) - micros(F.col("started"))
    bucket = F.lit(len(DURATION_BOUNDS))
    for i in reversed(range(len(DURATION_BOUNDS))):
        bucket = F.when(F.col("us") <= round(DURATION_BOUNDS[i] * 1_000_000), i).otherwise(bucket)
    return (
        runs.where("outcome = 'COMPLETED'")
        .select("client_name", us.alias("us"))
        .groupBy("client_name", bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("sum_us"))
    )


def timeout_breaches(log: DataFrame, limits: DataFrame, global_ms: int = 0, key: str = "chain_id") -> DataFrame:
    """Log rows longer than their own limit, or the global one where theirs is 0; 0 is no limit."""
    limit = F.coalesce(F.nullif(F.col("timeout"), F.lit(0)), F.lit(global_ms or None).cast("int"))
    return (
        log.join(limits.select(key, limit.alias("limit_ms")), key)
        .where((F.col("limit_ms") > 0) & (F.col("dur_us") > F.col("limit_ms") * F.lit(1000).cast("bigint")))
        .select("exec_id", key, "dur_us", "limit_ms")
    )


# --- retries -----------------------------------------------------------------


def retry_statistics(log: DataFrame, now: Column, max_duration_s: int, min_wait_s: int) -> DataFrame:
    """Failures per chain and client in [now - max_duration, now - min_wait]: count and latest finish."""
    at = micros(F.col("finished"))
    recent = at.between(micros(now) - max_duration_s * 1_000_000, micros(now) - min_wait_s * 1_000_000)
    return (
        log.where((F.col("returncode") != 0) & recent)
        .groupBy("chain_id", "client_name")
        .agg(F.count(F.lit(1)).alias("retries"), F.max("finished").alias("last_failure"))
    )


def retry_backoff(log: DataFrame, max_retries: int, min_wait_s: int, max_duration_s: int) -> DataFrame:
    """Retry decision at each failure: how many failures lie in its window, and the delay to wait.

    No retry (NULL delay) once the window holds ``max_retries`` failures; else
    twice the time since the last one, or ``min_wait_s`` if there is none.
    A failure is a mark on the time line of its chain and client, and asks at the two
    ends of its window how many marks lie before and which is the last: running figures
    over blocks of equal size, so that a hot chain or hour spreads.
    """
    reach, wait = max_duration_s * 1_000_000, min_wait_s * 1_000_000
    failures = log.where("returncode <> 0").select("exec_id", "chain_id", "client_name", micros(F.col("finished")).alias("moment"))
    # At one instant: what the window's start leaves out (0), marks (1), what its end takes in (2).
    points = F.explode(
        F.array(
            F.struct((F.col("moment") - reach).alias("us"), F.lit(0).alias("step")),
            F.struct(F.col("moment").alias("us"), F.lit(1).alias("step")),
            F.struct((F.col("moment") - wait).alias("us"), F.lit(2).alias("step")),
        )
    )
    keys = ["chain_id", "client_name"]
    line = blocked.placed(failures.select("exec_id", *keys, "moment", points.alias("p")).select("exec_id", *keys, "moment", "p.us", "p.step"), keys, ["us", "step"])
    is_mark = F.col("step") == 1
    found = blocked.running_sums_and_last(
        line, keys, F.col("__at"), [F.col("us"), F.col("step")], {"upto": is_mark.cast("bigint")}, ("last_at", F.when(is_mark, F.col("us")))
    )
    upto = {step: F.max(F.when(F.col("step") == step, F.col("upto"))) for step in (0, 2)}
    asked = found.where(~is_mark).groupBy("exec_id", *keys, "moment").agg(
        (upto[2] - upto[0]).alias("retries"), F.max(F.when(F.col("step") == 2, F.col("last_at"))).alias("last_at")
    )
    last = F.when(F.col("retries") > 0, F.col("last_at"))
    return asked.select(
        "exec_id", *keys, "retries",
        F.when(F.col("retries") < max_retries, F.coalesce(2 * (F.col("moment") - last), F.lit(wait))).cast("bigint").alias("delay_us"),
    )


# --- concurrency -------------------------------------------------------------


def concurrency_profile(runs: DataFrame, key: str = "chain_id") -> DataFrame:
    """Running instances per key after each instant at which one starts or finishes.

    Intervals are half-open: a finish and a start at one instant cancel out.
    """
    edges = runs.where(F.col("finished") > F.col("started")).select(
        key,
        F.explode(
            F.array(
                F.struct(F.col("started").alias("moment"), F.lit(1).cast("bigint").alias("d")),
                F.struct(F.col("finished").alias("moment"), F.lit(-1).cast("bigint").alias("d")),
            )
        ).alias("e"),
    )
    net = edges.groupBy(key, F.col("e.moment").alias("moment")).agg(F.sum("e.d").alias("d"))
    line = blocked.placed(net, [key], ["moment"])
    return blocked.running_sum(line, [key], F.col("__at"), [F.col("moment")], F.col("d"), "running").drop("d", "__at")


def peak_concurrency(runs: DataFrame, key: str = "chain_id") -> DataFrame:
    return concurrency_profile(runs, key).groupBy(key).agg(F.max("running").alias("peak"))


def exclusive_overlaps(runs: DataFrame, exclusive: DataFrame, lock: str = "client_name") -> DataFrame:
    """For each exclusive run, how many other runs of the same scheduler overlap it (0 = lock kept).

    Overlaps are counted, not paired up: runs that started before my finish,
    less runs that had finished by my start, less myself. Both counts are
    running sums over the time-ordered starts and finishes, so the work is
    sorting, however many runs pile up, and no run is joined to another.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    edges = (
        runs.where(F.col("finished") > F.col("started"))
        .join(exclusive.select("chain_id", "exclusive_execution"), "chain_id", "left")
        .select(
            "chain_id", "txid", lock, F.coalesce("exclusive_execution", F.lit(False)).alias("mine"),
            F.explode(
                F.array(
                    F.struct(micros(F.col("started")).alias("us"), one.alias("start")),
                    F.struct(micros(F.col("finished")).alias("us"), zero.alias("start")),
                )
            ).alias("e"),
        )
        .select("chain_id", "txid", lock, "mine", "e.us", "e.start")
    )
    line, start = blocked.placed(edges, [lock], ["us"]), F.col("start")
    counted = blocked.running_sums_upto(
        line, [lock], F.col("__at"), F.col("us"), {"started_before": (start, -1), "finished_upto": (one - start, 0)}
    )
    before_finish = F.max(F.when(start == 0, F.col("started_before")))
    by_start = F.max(F.when(start == 1, F.col("finished_upto")))
    return (
        counted.where("mine").groupBy("chain_id", "txid", lock).agg((before_finish - by_start - 1).alias("n_overlaps"))
    )


# --- admission ---------------------------------------------------------------


_STATE = "array<struct<f:bigint,c:string,h:boolean>>"
_FOLDED = f"chain_id bigint, block bigint, entry {_STATE}, exit {_STATE}"
_ARROW_STATE = pa.list_(pa.struct([("f", pa.int64()), ("c", pa.string()), ("h", pa.bool_())]))


class _Places:
    """Places of one chain: runs that have been admitted and not finished, and how many places each client holds."""

    def __init__(self, state: Iterable[dict], limit: int, clear_all: bool):
        self.limit, self.clear_all = limit, clear_all
        self.held = Counter(e["c"] for e in state if e["h"])
        self.used = self.held.total()
        # A run holds its place while its client has not been cleared since.
        self.cleared = Counter()
        self.running = [(e["f"], e["c"], 0 if e["h"] else -1) for e in state]
        heapq.heapify(self.running)

    def finish_upto(self, now: int) -> None:
        while self.running and self.running[0][0] <= now:
            _, client, since = heapq.heappop(self.running)
            if self.clear_all:
                self.used -= self.held.pop(client, 0)
                self.cleared[client] += 1
            elif since == self.cleared[client]:
                self.held[client] -= 1
                self.used -= 1

    def attempt(self, start: int, finish: int, client: str) -> bool:
        self.finish_upto(start)
        if self.used >= self.limit:
            return False
        heapq.heappush(self.running, (finish, client, self.cleared[client]))
        self.held[client] += 1
        self.used += 1
        return True

    def state(self) -> list[dict]:
        return [{"f": f, "c": c, "h": since == self.cleared[c]} for f, c, since in sorted(self.running, key=lambda r: (r[0], r[1], r[2] != self.cleared[r[1]]))]


def _fold(batches: Iterable[pa.RecordBatch], clear_all: bool, want_flags: bool):
    """Fold sorted block headers and attempts, block after block, in the memory of one batch.

    A block marked ``first`` starts from its ``carried`` state. Another one goes on
    from the state that the block before it leaves; if that is the entry it was
    folded from before, it and those after it need nothing, up to one marked
    ``dirty``. Yields flags, or entry and exit of what was folded.
    """
    block, places, skipping = None, None, False

    def ended() -> list[tuple]:
        if block is None or skipping:
            return []
        if block["next_s"] is not None:
            places.finish_upto(block["next_s"])
        return [(block["chain_id"], block["block"], block["from"], places.state())]

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * (3 if want_flags else 4)
        last = [pa.bool_()] if want_flags else [_ARROW_STATE, _ARROW_STATE]
        names = ["chain_id", "txid", "admitted"] if want_flags else ["chain_id", "block", "entry", "exit"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *last])], names=names)

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["header"]:
                done = ended()
                if not want_flags:
                    out += done
                state = done[0][3] if done else None
                if r["first"] or (r["dirty"] and state is None):
                    state = r["carried"]
                skipping = state is None or (not r["first"] and not (r["dirty"] and not done) and state == r["entry"])
                block = r
                if not skipping:
                    block["from"], places = state, _Places(state, r["cap"], clear_all)
            elif not skipping:
                admitted = places.attempt(r["s"], r["f"], r["client_name"])
                if want_flags:
                    out.append((r["chain_id"], r["txid"], admitted))
        yield table(out)
    if not want_flags:
        yield table(ended())


def _in_row_blocks(attempts: DataFrame, block_rows: int) -> tuple[DataFrame, bool]:
    """``attempts`` with a ``block`` that grows along a chain, cut after about ``block_rows`` rows; and whether any chain has two.

    Rows are counted by minute, so a block is larger only if one minute is.
    """
    minute = F.floor(F.col("s") / F.lit(60_000_000))
    along = Window.partitionBy("chain_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = attempts.groupBy("chain_id", minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    upto = cut_lineage(counted.select("chain_id", "minute", F.floor((F.sum("n").over(along) - F.col("n")) / block_rows).alias("block")))
    if not (upto.agg(F.max("block")).first()[0] or 0):
        return attempts.withColumn("block", F.lit(0).cast("bigint")), False
    places = F.broadcast(upto) if fits_broadcast(upto) else upto
    return attempts.withColumn("minute", minute).join(places, ["chain_id", "minute"]).drop("minute"), True


def admission(
    runs: DataFrame,
    limits: DataFrame,
    clear_all: bool = True,
    default_limit: int | None = DEFAULT_MAX_INSTANCES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Which start attempts are admitted under ``max_instances`` (``admitted`` flag per run).

    Admission is greedy in start order, and a refused run takes no slot. With
    ``clear_all`` the first finish of a chain on a client frees every slot of
    that chain and client. A missing limit is ``default_limit``; None as that admits all.

    The fold is sequential per chain, yet no chain is put into one task at first:
    its blocks, cut by row count, are folded in parallel from an assumed entry
    state. Then come rounds of windows of 2, 4, 8 ... blocks. Within a window the
    blocks are folded on from the first whose entry is not what the block before
    leaves, as far as states differ from those assumed before; after that the
    window is right given its entry. Rounds end when every block follows from the
    one before: after a few, as states forget fast, and at the latest when a window
    spans the chain, so their number is the logarithm of the blocks. Only windows
    with something to mend are read. Blocks are streamed, never held in memory.
    """
    limit = F.coalesce(F.col("max_instances").cast("int"), F.lit(default_limit).cast("int"))
    base = cut_lineage(
        runs.join(limits.select("chain_id", limit.alias("cap")), "chain_id").select(
            F.col("chain_id").cast("bigint"), F.col("txid").cast("bigint"), F.coalesce("client_name", F.lit("")).alias("client_name"),
            micros(F.col("started")).alias("s"), micros(F.col("finished")).alias("f"), "cap",
        )
    )
    capped, several = _in_row_blocks(base.where(F.col("cap").isNotNull()), block_rows)
    if several:
        capped = cut_lineage(capped)
    chain_order = Window.partitionBy("chain_id").orderBy("block")
    empty, keys = F.array().cast(_STATE), ["chain_id", "block"]
    blocks = (
        capped.groupBy(*keys).agg(F.min("s").alias("first_s"), F.first("cap").alias("cap"))
        .withColumns({"next_s": F.lead("first_s").over(chain_order), "at": F.row_number().over(chain_order) - 1})
        .drop("first_s").withColumns({"entry": empty, "exit": empty, "carried": empty, "dirty": F.lit(True)})
    )

    def folded(headers: DataFrame, want_flags: bool) -> DataFrame:
        """Fold the blocks of ``headers``, those of one ``window`` in order."""
        # Both sides come from the same table: fresh column identities keep the two apart.
        heads = headers.select(*[F.col(c).alias(c) for c in headers.columns])
        rows = capped if want_flags and not several else capped.join(heads.select(*keys, "window"), keys)
        if "window" not in rows.columns:
            rows = rows.withColumn("window", F.col("block"))
        both = heads.withColumn("header", F.lit(True)).unionByName(
            rows.drop("cap").withColumn("header", F.lit(False)), allowMissingColumns=True
        )
        placed = both.repartition("chain_id", "window").sortWithinPartitions("chain_id", "block", F.desc("header"), "s", "txid")
        schema = "chain_id bigint, txid bigint, admitted boolean" if want_flags else _FOLDED
        return placed.mapInArrow(lambda batches: _fold(batches, clear_all, want_flags), schema)

    width = 1
    while several:
        window = F.floor(F.col("at") / width)
        first_dirty = F.min(F.when(F.col("dirty"), F.col("at"))).over(Window.partitionBy("chain_id", "window"))
        todo = blocks.withColumn("window", window).withColumn("from_at", first_dirty).where("at >= from_at")
        new = folded(todo.withColumn("first", F.col("at") == F.col("from_at")).drop("from_at", "exit"), False)
        known = blocks.drop("carried", "dirty").join(new.select(*keys, F.col("entry").alias("e"), F.col("exit").alias("x")), keys, "left").select(
            *keys, "cap", "next_s", "at", F.coalesce("e", "entry").alias("entry"), F.coalesce("x", "exit").alias("exit")
        )
        carried = F.coalesce(F.lag("exit").over(chain_order), empty)
        blocks, left = cut_and_count(
            known.withColumn("carried", carried).withColumn("dirty", F.col("carried") != F.col("entry")), F.col("dirty")
        )
        if not left:
            break
        width *= 2
    flagged = folded(blocks.withColumns({"window": F.col("block"), "first": F.lit(True)}).drop("exit"), True)
    free = base.where(F.col("cap").isNull()).select("chain_id", "txid", F.lit(True).alias("admitted"))
    return flagged.unionByName(free)


def run_spans(log: DataFrame) -> DataFrame:
    """Runs by their wall-clock span, whatever their outcome."""
    return log.groupBy("chain_id", "txid", "client_name").agg(
        F.min("last_run").alias("started"), F.max("finished").alias("finished")
    )
