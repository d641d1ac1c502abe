"""Control signals: parse, deduplicate, delay, resolve. Every step works on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.session import ship_by_value

ship_by_value(__name__)

# How long a handled signal is remembered, and the commands there are.
SIGNAL_TTL = timedelta(seconds=60)
COMMANDS = ("START", "STOP")
SIGNAL_KEY = ["config_id", "command", "signal_ts", "delay"]
#: State of the signals handled is kept in so many parts, by the hash of a signal.
PARTS = 1_024


def parse_signals(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Add config_id, command, signal_ts, delay and ``reason`` (NULL = accepted).

    'json': no JSON object, or a member of the wrong type. 'command': not a known
    command. 'chain': no positive chain id. Absent members are 0 or ''. Member names
    are taken in any case; of several spellings the last in code-point order counts,
    but all must have the right type.
    """
    doc = F.try_variant_get(F.try_parse_json(F.col(payload)), "$", "map<string,variant>")

    def spelled(name: str) -> Column:
        """Kinds and values of the members of that name that are not null."""
        entries = F.filter(F.map_entries("__doc"), lambda e: F.lower(e["key"]) == name.lower())
        kinds = F.transform(entries, lambda e: F.struct(F.schema_of_variant(e["value"]).alias("kind"), e["value"].alias("value")))
        return F.filter(kinds, lambda m: m["kind"] != "VOID")

    def wrong(name: str, kind: str) -> Column:
        return F.coalesce(F.exists(spelled(name), lambda m: m["kind"] != kind), F.lit(False))

    def last(name: str, kind: str) -> Column:
        return F.try_variant_get(F.try_element_at(spelled(name), F.lit(-1))["value"], "$", kind)

    def whole(name: str) -> Column:
        return F.coalesce(last(name, "bigint"), F.lit(0).cast("bigint"))

    parsed = messages.withColumn("__doc", doc)
    bad = F.col("__doc").isNull() | wrong("Command", "STRING")
    for name in ("ConfigID", "Ts", "Delay"):
        bad = bad | wrong(name, "BIGINT")
    command = F.coalesce(last("Command", "string"), F.lit(""))
    return parsed.withColumns(
        {
            "config_id": whole("ConfigID"),
            "command": command,
            "signal_ts": whole("Ts"),
            "delay": whole("Delay"),
            "reason": F.when(bad, "json")
            .when(~command.isin(*COMMANDS), "command")
            .when(whole("ConfigID") <= 0, "chain"),
        }
    ).drop("__doc")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())


def _packed(frame: pd.DataFrame) -> bytes:
    batch, out = pa.RecordBatch.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write(batch)
    return out.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value)).read_pandas()


class _Unseen(StatefulProcessor):
    """State of a part of the signals: a table for each trigger of those first handled in it, which expires by itself."""

    def __init__(self, remembered: timedelta) -> None:
        self.remembered_ms = int(remembered.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handled = handle.getListState("handled", "signals binary", self.remembered_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat([frame[SIGNAL_KEY].drop_duplicates() for frame in rows]).drop_duplicates()
        if self.handled.exists():
            before = pd.concat([_unpacked(value) for (value,) in self.handled.get()])
            both = came.merge(before, "left", SIGNAL_KEY, indicator="known")
            came = both.loc[both["known"] == "left_only", SIGNAL_KEY]
        if len(came):
            self.handled.appendValue((_packed(came),))
            yield came

    def close(self) -> None:
        pass


def dedup_signals(signals: DataFrame, remembered: timedelta = SIGNAL_TTL) -> DataFrame:
    """The four members of each signal, once for all that are equal in them while it is remembered.

    What counts is when a signal comes in, not the time it bears: none is ever too
    late. A handled signal is forgotten after ``remembered``, and handled again if
    it comes once more. A batch comes in at one moment. On a stream the state lies in
    parts by the signal's hash, so a chain that gets a third of all signals spreads
    out; a trigger meets a part's signals all at once. It needs the RocksDB state store.
    """
    if not signals.isStreaming:
        return signals.select(*SIGNAL_KEY).distinct()
    # As text: pandas would turn a column of integers with a null into floats.
    text = signals.select(*[F.col(c).cast("string").alias(c) for c in SIGNAL_KEY])
    fresh = text.withColumn("__part", F.pmod(F.xxhash64(*SIGNAL_KEY), F.lit(PARTS))).groupBy("__part").transformWithStateInPandas(
        statefulProcessor=_Unseen(remembered),
        outputStructType="config_id string, command string, signal_ts string, delay string",
        outputMode="append",
        timeMode="processingTime",
    )
    return fresh.select(*[F.col(c).cast("string" if c == "command" else "bigint").alias(c) for c in SIGNAL_KEY])


class _DelayedStarts(StatefulProcessor):
    """State of one chain: starts that wait for their time, and the STOP times that are still remembered."""

    def __init__(self, remembered: timedelta) -> None:
        self.remembered_ms = int(remembered.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "signal_ts bigint, effective_ts bigint", "n int")
        self.stops = handle.getListState("stops", "times binary", self.remembered_ms)

    def _started(self, key, starts) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), ts, at) for ts, at in sorted(starts)], columns=["config_id", "signal_ts", "effective_ts"])

    def _stops(self, came: np.ndarray) -> np.ndarray:
        """The STOP times that came now, which are remembered from here on, and those still remembered, in order."""
        parts = [came]
        if self.stops.exists():
            parts += [np.frombuffer(bytes(value), np.int64) for (value,) in self.stops.get()]
        if len(came):
            self.stops.appendValue((came.tobytes(),))
        return np.unique(np.concatenate(parts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        signals = pd.concat([frame[["command", "signal_ts", "delay"]].drop_duplicates() for frame in rows])
        stops = self._stops(np.unique(signals.loc[signals["command"] == "STOP", "signal_ts"].to_numpy(np.int64)))
        came = signals.loc[signals["command"] == "START", ["signal_ts", "delay"]].astype("int64")
        came["effective_ts"] = came["signal_ts"] + came["delay"]
        if ((came["effective_ts"] < came["signal_ts"]) != (came["delay"] < 0)).any():
            raise OverflowError(f"a delay of chain {key[0]} ends beyond the times there are")
        fresh = came[["signal_ts", "effective_ts"]].drop_duplicates().sort_values(["signal_ts", "effective_ts"])

        def stopped(ts: np.ndarray, at: np.ndarray) -> np.ndarray:
            after = np.searchsorted(stops, ts)
            return (after < len(stops)) & (np.append(stops, 0)[after] <= at)

        waiting = {(k[0], k[1]) for k in self.waiting.keys()}
        held = np.array(sorted(waiting), np.int64).reshape(-1, 2)
        for start in held[stopped(*held.T)].tolist():
            self.waiting.removeKey(tuple(start))
        fresh = fresh[~stopped(fresh["signal_ts"].to_numpy(), fresh["effective_ts"].to_numpy())]
        is_due = fresh["effective_ts"] <= timerValues.getCurrentProcessingTimeInMs() // 1000
        due = fresh[is_due]
        if waiting:
            due = due[[start not in waiting for start in due.itertuples(index=False, name=None)]]
        for start in set(fresh[~is_due].itertuples(index=False, name=None)) - waiting:
            self.waiting.updateValue(start, (1,))
            self.handle.registerTimer(start[1] * 1000)
        if len(due):
            yield due.assign(config_id=int(key[0]))[["config_id", "signal_ts", "effective_ts"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = [(k[0], k[1]) for k in self.waiting.keys() if k[1] * 1000 <= expiredTimerInfo.getExpiryTimeInMs()]
        for start in due:
            self.waiting.removeKey(start)
        if due:
            yield self._started(key, due)

    def close(self) -> None:
        pass


def delayed_starts(signals: DataFrame, remembered: timedelta = SIGNAL_TTL) -> DataFrame:
    """The starts that take place: (config_id, signal_ts, effective_ts) of each START when its time has come.

    A START waits as state, with a timer of the clock, for ``delay`` seconds after
    the time it bears; one whose time is past starts at once. A STOP of the chain
    that bears a time from the START's to its effective one cancels it if it comes
    in before the start: in the same trigger, in a later one while the START waits, or
    in an earlier one that is not longer ago than ``remembered``. Equal STARTs are one.
    Needs the RocksDB state store.
    """
    return signals.groupBy("config_id").transformWithStateInPandas(
        statefulProcessor=_DelayedStarts(remembered),
        outputStructType="config_id bigint, signal_ts bigint, effective_ts bigint",
        outputMode="append",
        timeMode="processingTime",
    )


def effective_start(signals: DataFrame) -> DataFrame:
    return signals.withColumn("effective_ts", F.col("signal_ts") + F.col("delay"))


def resolve_commands(signals: DataFrame) -> DataFrame:
    """The last command per chain decides; at equal time a STOP wins over a START."""
    last = F.max_by(F.struct("command", "effective_ts"), F.struct("signal_ts", "command", "effective_ts"))
    return (
        effective_start(signals)
        .groupBy("config_id")
        .agg(last.alias("l"), F.count(F.lit(1)).alias("signals"))
        .select("config_id", F.col("l.command").alias("command"), F.col("l.effective_ts").alias("effective_ts"), "signals")
    )
