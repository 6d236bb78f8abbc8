"""State machines that are sequential by nature, as folds over each key's commands; keys are independent and spread over tasks.

`outbox` and `leases` are the batch forms; `cairn.streaming` runs the same steps on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attempts of an event, seconds of a lease, seconds until a retry.
MAX_ATTEMPTS, LEASE_S, RETRY_S = 5, 60, 30
# The deposit's states and the moves between them.
DEPOSIT_MOVES = {
    "PENDING": ("DRAFT_CREATED", "FAILED", "NEEDS_RECONCILIATION"),
    "DRAFT_CREATED": ("UPLOADING", "FAILED", "NEEDS_RECONCILIATION"),
    "UPLOADING": ("UPLOADED", "FAILED", "NEEDS_RECONCILIATION"),
    "UPLOADED": ("VERIFIED", "FAILED", "NEEDS_RECONCILIATION"),
    "VERIFIED": ("PUBLISHED", "FAILED"),
    "FAILED": ("DRAFT_CREATED", "UPLOADING", "UPLOADED", "VERIFIED", "NEEDS_RECONCILIATION"),
    "NEEDS_RECONCILIATION": ("DRAFT_CREATED", "UPLOADING", "UPLOADED", "VERIFIED", "FAILED"),
    "PUBLISHED": (),
}


@dataclass
class Outbox:
    """One outbox event. Times are seconds."""

    status: str = "ABSENT"
    attempts: int = 0
    next_at: int = 0
    lease_until: int | None = None
    token: str | None = None
    error: str | None = None

    def step(self, cmd: str, at: int, token: str | None, error: str | None, reconcile: bool) -> str:
        """Apply a command; OK or the reason why it was refused."""
        if cmd == "insert":
            if self.status != "ABSENT":
                return "EXISTS"
            self.status, self.next_at = "PENDING", at
            return "OK"
        if self.status == "ABSENT":
            return "UNKNOWN_EVENT"
        if cmd == "clock":
            return self.expire(at)
        if cmd == "claim":
            if self.status == "IN_FLIGHT" and self.lease_until <= at and self.attempts >= MAX_ATTEMPTS:
                self.status, self.token, self.lease_until = "RECONCILIATION_REQUIRED", None, None
            due = (self.status in ("PENDING", "RETRY") and self.next_at <= at) or (self.status == "IN_FLIGHT" and self.lease_until <= at)
            if not due or self.attempts >= MAX_ATTEMPTS:
                return "NOT_DUE"
            self.status, self.token, self.attempts, self.lease_until = "IN_FLIGHT", token, self.attempts + 1, at + LEASE_S
            return "OK"
        if self.status != "IN_FLIGHT" or token != self.token or self.lease_until <= at:
            return "LEASE_LOST"
        if cmd == "renew":
            self.lease_until = at + LEASE_S
        elif cmd == "complete":
            self.status, self.token, self.lease_until, self.error = "COMPLETED", None, None, None
        elif cmd == "retry":
            self.status = "RECONCILIATION_REQUIRED" if reconcile else "FAILED" if self.attempts >= MAX_ATTEMPTS else "RETRY"
            self.next_at, self.token, self.lease_until, self.error = at + RETRY_S, None, None, error
        else:
            return "UNKNOWN_COMMAND"
        return "OK"


    def expire(self, at: int) -> str:
        """What the passing of time does: a claim whose lease has run out is free again, or needs a person after the last attempt. A later claim or answer finds what it would find without this."""
        if self.status != "IN_FLIGHT" or self.lease_until > at:
            return "NOT_DUE"
        self.next_at = self.lease_until
        self.status, self.token, self.lease_until = "RECONCILIATION_REQUIRED" if self.attempts >= MAX_ATTEMPTS else "RETRY", None, None
        return "EXPIRED"


def outbox_due(status: Column, attempts: Column, next_at: Column, lease_until: Column, now: Column) -> Column:
    """Whether an event can be claimed: waiting and due, or in flight under a lease that ran out, with attempts left."""
    waiting = status.isin("PENDING", "RETRY") & (next_at <= now)
    return F.coalesce((waiting | ((status == "IN_FLIGHT") & (lease_until <= now))) & (attempts < MAX_ATTEMPTS), F.lit(False))


def next_claims(events: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The oldest due events: by next_at, created_at, then event_id."""
    due = outbox_due(F.col("status"), F.col("attempts"), F.col("next_at"), F.col("lease_until"), now)
    return events.filter(due).orderBy("next_at", "created_at", "event_id").limit(limit)


@dataclass
class Lease:
    """The lease of a portal, with its fencing generation and the baseline that it guards."""

    owner: str | None = None
    expires: int = 0
    generation: int = 0
    baseline: str | None = None
    baseline_at: int = 0
    baseline_generation: int = 0

    def step(self, cmd: str, owner: str, at: int, ttl: int, generation: int | None, baseline: str | None) -> str:
        held = self.owner is not None and at < self.expires
        if cmd == "clock":
            return self.expire(at)
        if cmd == "acquire":
            if held:
                return "HELD"
            self.owner, self.expires, self.generation = owner, at + ttl, self.generation + 1
            return "OK"
        if self.owner != owner or not held or generation != self.generation:
            return "LEASE_LOST"
        if cmd == "renew":
            self.expires = at + ttl
        elif cmd == "release":
            self.owner, self.expires = None, 0
        elif cmd == "commit":
            if at < self.baseline_at:
                return "REGRESSION"
            self.baseline, self.baseline_at, self.baseline_generation = baseline, at, self.baseline_generation + 1
        else:
            return "UNKNOWN_COMMAND"
        return "OK"


    def expire(self, at: int) -> str:
        """What the passing of time does: a lease that has run out has no owner."""
        if self.owner is None or at < self.expires:
            return "NOT_DUE"
        self.owner, self.expires = None, 0
        return "EXPIRED"


@dataclass
class Stored:
    """An object of a store that only takes conditional writes. Its version is its etag; versions never come again."""

    there: bool = False
    version: int = 0

    def step(self, cmd: str, etag: int | None) -> str:
        """put_new: only where there is none; put_if_match: only over the version that the writer has seen."""
        if cmd == "put_new":
            if self.there:
                return "CONFLICT"
            self.there, self.version = True, self.version + 1
            return "OK"
        if not self.there:
            return "NOT_FOUND"
        if cmd == "put_if_match":
            if etag != self.version:
                return "PRECONDITION_FAILED"
            self.version += 1
        elif cmd == "delete":
            self.there = False
        elif cmd != "get":
            return "UNKNOWN_COMMAND"
        return "OK"


OBJECT_SCHEMA = "path string, seq long, cmd string, result string, version long, there boolean"
OUTBOX_SCHEMA = "event_id string, seq long, cmd string, result string, status string, attempts int, lease_until long, next_at long"
LEASE_SCHEMA = "portal_id string, seq long, cmd string, result string, owner string, generation long, expires long, baseline string, baseline_generation long"


def ordered_fold(rows: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable[[object, tuple], tuple], schema: str) -> DataFrame:
    """step(state, row) of every row, each key from start() on in its order. Sorted rows stream through: of a key only its state is held, however many rows it has."""
    columns = [c.split() for c in schema.split(", ")]
    whole = {n: "Int64" for n, t in columns if t in ("long", "int")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if getattr(row, key) != current:
                    current, held = getattr(row, key), start()
                out.append(step(held, row))
            yield pd.DataFrame(out, columns=[n for n, _ in columns]).astype(whole)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def outbox_step(event: Outbox, r: tuple) -> tuple:
    result = event.step(r.cmd, int(r.at), r.token, r.error, bool(r.reconcile))
    return r.event_id, r.seq, r.cmd, result, event.status, event.attempts, event.lease_until, event.next_at


def lease_step(lease: Lease, r: tuple) -> tuple:
    generation = None if pd.isna(r.generation) else int(r.generation)
    result = lease.step(r.cmd, r.owner, int(r.at), int(r.ttl), generation, r.baseline)
    return r.portal_id, r.seq, r.cmd, result, lease.owner, lease.generation, lease.expires, lease.baseline, lease.baseline_generation


def fold_outbox(rows: pd.DataFrame, event: Outbox) -> pd.DataFrame:
    """The commands of one event, from its state on."""
    out = [outbox_step(event, r) for r in rows.sort_values("seq").itertuples(index=False)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUTBOX_SCHEMA.split(", ")]).astype({"lease_until": "Int64", "next_at": "Int64"})


def outbox(commands: DataFrame) -> DataFrame:
    """Result and state after each command (event_id, seq, cmd, at, token, error, reconcile) of each event."""
    return ordered_fold(commands, "event_id", "seq", Outbox, outbox_step, OUTBOX_SCHEMA)


def leases(commands: DataFrame) -> DataFrame:
    """Result and state after each command (portal_id, seq, cmd, owner, at, ttl, generation, baseline) of each portal."""
    return ordered_fold(commands, "portal_id", "seq", Lease, lease_step, LEASE_SCHEMA)


def object_step(held: Stored, r: tuple) -> tuple:
    result = held.step(r.cmd, None if pd.isna(r.etag) else int(r.etag))
    return r.path, r.seq, r.cmd, result, held.version, held.there


def objects(commands: DataFrame) -> DataFrame:
    """Result and state after each command (path, seq, cmd, etag) of each object: compare and swap by version."""
    return ordered_fold(commands, "path", "seq", Stored, object_step, OBJECT_SCHEMA)
