"""Admission on a stream, in the order of event time.

Starts and finishes wait as keyed state, in time slots, until the watermark has
passed their slot; a timer then decides the slot's starts in order. So a finish
counts only for starts after it, whichever comes in first, and the decisions are
those of the batch operator if no row is later than the watermark allows. The
slots in use of each client are a counter; runs are looked up by id.

Rows that are later than that are not decided; ``undecided`` lists their starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.binding import micros
from tickloom.operators.jobs import DEFAULT_MAX_INSTANCES
from tickloom.session import ship_by_value
from tickloom.streaming import runs

ship_by_value(__name__)

#: Width of a slot: decisions come at most this much later than the watermark.
SLOT_S = 600
LATENESS_S = 600
DECISION = "chain_id bigint, run_id bigint, admitted boolean"
_FINISH, _START, _AT_ONCE = 0, 1, 2


def run_edges(log: DataFrame, limits: DataFrame) -> DataFrame:
    """Start and finish of each log row, with the limit of its chain (NULL = the default).

    A run that takes no time finishes right after its own start, not before it.
    """
    finish = F.greatest("last_run", "finished")
    kind = F.when(F.col("finished") > F.col("last_run"), F.lit(_FINISH)).otherwise(F.lit(_AT_ONCE))
    edge = F.explode(
        F.array(
            F.struct(F.col("last_run").alias("moment"), F.lit(_START).alias("kind")),
            F.struct(finish.alias("moment"), kind.alias("kind")),
        )
    )
    caps = limits.select("chain_id", F.coalesce("max_instances", F.lit(DEFAULT_MAX_INSTANCES)).cast("int").alias("cap"))
    edges = log.select(
        "chain_id", F.col("exec_id").alias("run_id"), F.coalesce("client_name", F.lit("")).alias("client_name"), edge.alias("e")
    ).select(
        "chain_id", "run_id", "client_name", F.col("e.moment").cast("timestamp").alias("moment"), F.col("e.kind").alias("kind")
    )
    return edges.join(caps, "chain_id")


class _Admission(StatefulProcessor):
    """State of one chain: edges that wait by slot, runs that hold or held a place, places taken by each client."""

    def __init__(self, slot_s: int, clear_all: bool) -> None:
        self.slot_us, self.clear_all = slot_s * 1_000_000, clear_all

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState(
            "waiting", "slot bigint", "at array<bigint>, kind array<int>, run array<bigint>, client array<string>, cap array<int>"
        )
        self.open = handle.getValueState("open", "slots array<bigint>")
        self.running = handle.getMapState("running", "run_id bigint", "client string")
        self.taken = handle.getMapState("taken", "client string", "places bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A row without a chain only moves the time on.
        fresh = [r for r in rows if key[0] is not None and not pd.isna(key[0])]
        if fresh:
            batch = pd.concat(fresh)
            slots = set(self.open.get()[0]) if self.open.exists() else set()
            for slot, part in batch.groupby(batch["us"] // self.slot_us):
                slot = int(slot)
                values = [part[c].tolist() for c in ("us", "kind", "run_id", "client_name", "cap")]
                if slot in slots:
                    values = [list(old) + new for old, new in zip(self.waiting.getValue((slot,)), values)]
                else:
                    self.handle.registerTimer(-(-(slot + 1) * self.slot_us // 1000))
                self.waiting.updateValue((slot,), tuple(values))
                slots.add(slot)
            self.open.update((sorted(slots),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due_us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        slots = list(self.open.get()[0]) if self.open.exists() else []
        due = [s for s in slots if (s + 1) * self.slot_us <= due_us]
        if due:
            running = {k[0]: v[0] for k, v in self.running.iterator()}
            taken = {k[0]: v[0] for k, v in self.taken.iterator()}
            before = dict(running), dict(taken)
            decided: list[tuple[int, bool]] = []
            for slot in due:
                decided += self._decide(self.waiting.getValue((slot,)), running, taken)
                self.waiting.removeKey((slot,))
            for state, old, new in ((self.running, before[0], running), (self.taken, before[1], taken)):
                for k in old.keys() - new.keys():
                    state.removeKey((k,))
                for k, v in new.items():
                    if old.get(k) != v:
                        state.updateValue((k,), (v,))
            self.open.update(([s for s in slots if s not in due],))
            yield pd.DataFrame([(int(key[0]), *d) for d in decided], columns=["chain_id", "run_id", "admitted"])

    def _decide(self, edges, running: dict[int, str], taken: dict[str, int]) -> Iterator[tuple[int, bool]]:
        """Starts of one slot, in order. At one instant finishes come first, then starts by id."""
        places = sum(taken.values())
        for _, kind, run, client, cap in sorted(zip(*edges), key=lambda e: (e[0], e[1] != _FINISH, e[2], e[1])):
            if kind == _START:
                admitted = places < cap
                if admitted:
                    running[run] = client
                    taken[client] = taken.get(client, 0) + 1
                    places += 1
                yield run, admitted
            elif run in running:
                del running[run]
                had = taken.pop(client, 0)
                left = 0 if self.clear_all else max(0, had - 1)
                places -= had - left
                if left:
                    taken[client] = left

    def close(self) -> None:
        pass


def live_admission(edges: DataFrame, lateness_s: int = LATENESS_S, slot_s: int = SLOT_S, clear_all: bool = True) -> DataFrame:
    """Admission decision per start of a stream of edges, once the watermark has passed its slot.

    The watermark follows the latest edge by ``lateness_s``. Needs the RocksDB state store.
    """
    timed = edges.withColumn("us", micros(F.col("moment"))).withWatermark("moment", f"{lateness_s} seconds")
    return timed.groupBy("chain_id").transformWithStateInPandas(
        statefulProcessor=_Admission(slot_s, clear_all), outputStructType=DECISION, outputMode="append", timeMode="eventTime"
    )


def decided_to_the_end(edges: DataFrame, label: str, lateness_s: int = LATENESS_S, slot_s: int = SLOT_S, clear_all: bool = True) -> DataFrame:
    """Decisions for all input there is, the last slots included."""
    return runs.drain_to_end(edges, "moment", lambda e: live_admission(e, lateness_s, slot_s, clear_all), label, lateness_s + 2 * slot_s)


def undecided(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Starts among (batch) edges that came too late to be decided."""
    starts = edges.where(F.col("kind") == _START)
    return starts.join(decisions, ["chain_id", "run_id"], "left_anti").select("chain_id", "run_id", "client_name", "moment")
