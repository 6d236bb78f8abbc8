"""Publishing a new baseline over two stores without a transaction: the catalogue's head first, then the control record, each by compare and swap.

A log of commands is folded per portal in its order; of a portal only its two records and its writers' open attempts are held.

* acquire: the writer takes the lease; generation and control version go up, so attempts of the owner before fail at their next write.
* begin: the owner reads both versions and its generation for a run.
* catalog, control: the conditional writes. `answer` is what the store does: ok; lost (written, but the writer gets an error);
  dropped (not written, an error too). An error is AMBIGUOUS; the writer has to read again before it goes on.
* reread: CONFIRMED or COMMITTED if the write is there, RETRY if nothing has changed, else CONFLICT.
* crash: the attempt is forgotten. A catalogue ahead of the control record is what it can leave.
* recover: the owner sets the catalogue's head back to the committed baseline (PROJECTED), or finds nothing to do (CLEAN).

The control record decides: a run is the baseline once its control write is there, whoever knows of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .state import ordered_fold

SCHEMA = "portal_id string, seq long, cmd string, writer string, result string, baseline string, head string, generation long, baseline_generation long, control_version long, catalog_version long"


@dataclass
class Attempt:
    """What a writer knows of its commit. Phases: NONE, BEGUN, CATALOG_UNKNOWN, CATALOG, CONTROL_UNKNOWN."""

    phase: str = "NONE"
    control_version: int = 0
    catalog_version: int = 0
    generation: int = 0
    run: str | None = None


@dataclass
class Portal:
    owner: str | None = None
    generation: int = 0
    control_version: int = 0
    baseline: str | None = None
    baseline_by: int = 0
    baseline_generation: int = 0
    catalog_version: int = 0
    head: str | None = None
    attempts: dict[str, Attempt] = field(default_factory=dict)

    def step(self, cmd: str, writer: str, run: str | None, answer: str | None) -> str:
        mine = self.attempts.setdefault(writer, Attempt())
        if cmd == "acquire":
            self.owner, self.generation, self.control_version = writer, self.generation + 1, self.control_version + 1
            return "OK"
        if cmd == "begin":
            if self.owner != writer:
                mine.phase = "NONE"
                return "NOT_OWNER"
            self.attempts[writer] = Attempt("BEGUN", self.control_version, self.catalog_version, self.generation, run)
            return "OK"
        if cmd == "catalog":
            return self._catalog(mine, writer, answer)
        if cmd == "control":
            return self._control(mine, answer)
        if cmd == "reread":
            return self._reread(mine)
        if cmd == "crash":
            mine.phase = "NONE"
            return "CRASHED"
        if cmd == "recover":
            if self.owner != writer:
                return "NOT_OWNER"
            mine.phase = "NONE"
            if self.head == self.baseline:
                return "CLEAN"
            self.head, self.catalog_version = self.baseline, self.catalog_version + 1
            return "PROJECTED"
        return "UNKNOWN_COMMAND"

    def _catalog(self, mine: Attempt, writer: str, answer: str | None) -> str:
        if mine.phase != "BEGUN":
            return "OUT_OF_ORDER"
        if (self.control_version, self.owner, self.generation, self.catalog_version) != (mine.control_version, writer, mine.generation, mine.catalog_version):
            mine.phase = "NONE"
            return "CONFLICT"
        if answer != "dropped":
            self.catalog_version, self.head = self.catalog_version + 1, mine.run
        mine.phase = "CATALOG" if answer == "ok" else "CATALOG_UNKNOWN"
        return "OK" if answer == "ok" else "AMBIGUOUS"

    def _control(self, mine: Attempt, answer: str | None) -> str:
        if mine.phase != "CATALOG":
            return "OUT_OF_ORDER"
        if self.control_version != mine.control_version:
            mine.phase = "NONE"
            return "CONFLICT"
        if answer != "dropped":
            self.baseline, self.baseline_by = mine.run, mine.generation
            self.baseline_generation, self.control_version = self.baseline_generation + 1, self.control_version + 1
        mine.phase = "NONE" if answer == "ok" else "CONTROL_UNKNOWN"
        return "COMMITTED" if answer == "ok" else "AMBIGUOUS"

    def _reread(self, mine: Attempt) -> str:
        if mine.phase == "CATALOG_UNKNOWN":
            there, same, name = self.head == mine.run and self.catalog_version == mine.catalog_version + 1, self.catalog_version == mine.catalog_version, "CONFIRMED"
            mine.phase = "CATALOG" if there else "BEGUN" if same else "NONE"
        elif mine.phase == "CONTROL_UNKNOWN":
            there, same, name = self.baseline == mine.run and self.baseline_by == mine.generation, self.control_version == mine.control_version, "COMMITTED"
            mine.phase = "NONE" if there else "CATALOG" if same else "NONE"
        else:
            return "NOTHING"
        return name if there else "RETRY" if same else "CONFLICT"


def _step(portal: Portal, r: tuple) -> tuple:
    result = portal.step(r.cmd, r.writer, r.run_id, r.answer)
    return r.portal_id, r.seq, r.cmd, r.writer, result, portal.baseline, portal.head, portal.generation, portal.baseline_generation, portal.control_version, portal.catalog_version


def commits(commands: DataFrame) -> DataFrame:
    """Result and both records after each command (portal_id, seq, cmd, writer, run_id, answer) of each portal."""
    return ordered_fold(commands, "portal_id", "seq", Portal, _step, SCHEMA)
