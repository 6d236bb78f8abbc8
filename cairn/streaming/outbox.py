"""The outbox, leases and the observation log as Structured Streaming queries; the state machines are those of the batch form.

`outbox` acts on commands only. `expiring_outbox` and `expiring_leases` act on time too: each key keeps a timer for the end of its claim or lease, and when
the watermark passes it the key expires, without a command, as the command `clock` of the batch form does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import LEASE_SCHEMA, OUTBOX_SCHEMA, Lease, Outbox, fold_outbox, lease_step, outbox_step

_STATE = "status string, attempts int, next_at long, lease_until long, token string, error string"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    event = Outbox(*held.get) if held.exists else Outbox()
    rows = pd.concat(list(frames))
    out = fold_outbox(rows, event)
    held.update((event.status, event.attempts, event.next_at, event.lease_until, event.token, event.error))
    yield out


def outbox(commands: DataFrame) -> DataFrame:
    """Result and state after each command of a stream (event_id, seq, cmd, at, token, error, reconcile). Commands of an event must arrive in the order of seq across batches; inside a batch they are sorted."""
    return commands.groupBy("event_id").applyInPandasWithState(_fold, OUTBOX_SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)


#: Timers need a state store that keeps several columns.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Expiring(StatefulProcessor):
    """A state machine with an end: `start` makes one from its kept fields, `step` applies a row, `end` tells when it expires (null: never)."""

    def __init__(self, start, step, end, fields: list[str], kept: str, out: str) -> None:
        self.start, self.step, self.end, self.fields, self.kept = start, step, end, fields, kept
        self.columns = [c.split() for c in out.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", self.kept)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        whole = {n: "Int64" for n, t in self.columns if t in ("long", "int")}
        return pd.DataFrame(rows, columns=[n for n, _ in self.columns]).astype(whole)

    def _keep(self, machine) -> None:
        self.state.update(tuple(getattr(machine, f) for f in self.fields))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (end := self.end(machine)) is not None:
            self.handle.registerTimer(end * 1000)

    def _held(self):
        return self.start(*self.state.get()) if self.state.exists() else self.start()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = self._held()
        commands = pd.concat(list(rows)).sort_values("seq")
        out = [self.step(machine, r) for r in commands.itertuples(index=False)]
        self._keep(machine)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, at = self._held(), expiredTimerInfo.getExpiryTimeInMs() // 1000
        if machine.expire(at) != "EXPIRED":
            return
        self._keep(machine)
        values = {self.columns[0][0]: key[0], "seq": None, "cmd": "clock", "result": "EXPIRED"}
        yield self._frame([tuple(values[n] if n in values else getattr(machine, n) for n, _ in self.columns)])

    def close(self) -> None:
        pass


def expiring_outbox(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """As `outbox`, for a stream with the event time ts (the timestamp of `at`): besides the commands' rows, one with the command clock and no seq for each claim that time has freed. Rows not after the watermark are late and dropped. Needs the session setting STORE."""
    machine = _Expiring(Outbox, outbox_step, lambda e: e.lease_until if e.status == "IN_FLIGHT" else None, ["status", "attempts", "next_at", "lease_until", "token", "error"], _STATE, OUTBOX_SCHEMA)
    return commands.withWatermark("ts", late).groupBy("event_id").transformWithStateInPandas(machine, OUTBOX_SCHEMA, "update", "eventtime")


def expiring_leases(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Result and state after each command of a stream (portal_id, seq, cmd, owner, at, ttl, generation, baseline, ts), and a row with the command clock for each lease that time has ended. Needs the session setting STORE."""
    fields = ["owner", "expires", "generation", "baseline", "baseline_at", "baseline_generation"]
    kept = "owner string, expires long, generation long, baseline string, baseline_at long, baseline_generation long"
    machine = _Expiring(Lease, lease_step, lambda x: x.expires if x.owner is not None else None, fields, kept, LEASE_SCHEMA)
    return commands.withWatermark("ts", late).groupBy("portal_id").transformWithStateInPandas(machine, LEASE_SCHEMA, "update", "eventtime")


def observation_windows(visits: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Visits and distinct sets of each page and window of event time; rows later than `late` are dropped, and finished windows leave the state."""
    return visits.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "page").agg(F.count("*").alias("n_visits"), F.approx_count_distinct("set_fp").alias("n_sets")).select(F.col("w.start").alias("start"), "page", "n_visits", "n_sets")
