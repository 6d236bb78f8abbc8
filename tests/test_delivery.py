"""Commits over two stores under every interleaving, and replay targets by sessions."""

import random
from copy import deepcopy
from itertools import product

import pytest

from cairn.operators import replay
from cairn.operators.baseline import Portal, commits

SCRIPT = ("begin", "catalog", "control")


def moves(portal, writer, at, committed):
    """What a writer does next in its script, given what it knows: after an ambiguous answer it reads again."""
    phase = portal.attempts[writer].phase if writer in portal.attempts else "NONE"
    if phase in ("CATALOG_UNKNOWN", "CONTROL_UNKNOWN"):
        return ["reread"]
    if at >= len(SCRIPT) or committed:
        return []
    return {"NONE": ["begin"] if at == 0 else [], "BEGUN": ["catalog"], "CATALOG": ["control"]}[phase]


def check(portal, before, cmd, writer, answer, result):
    """What must hold of any step."""
    wrote = portal.baseline_generation - before.baseline_generation
    assert wrote in (0, 1) and portal.generation >= before.generation and portal.control_version >= before.control_version and portal.catalog_version >= before.catalog_version
    if wrote:
        mine = before.attempts[writer]
        # Only the owner of the present generation, whose run stands in the catalogue, moves the baseline.
        assert cmd == "control" and answer != "dropped" and before.owner == writer and mine.generation == before.generation and before.head == mine.run == portal.baseline
    else:
        assert portal.baseline == before.baseline
    if result == "COMMITTED":
        assert portal.baseline == portal.attempts[writer].run
    if result == "CONFLICT":
        assert (portal.baseline, portal.head) == (before.baseline, before.head)


def test_every_interleaving_of_two_writers():
    """All orders of two writers' steps, with every answer, a crash of either writer at any place, and a takeover: up to six steps besides taking over."""
    seen, ends = 0, set()

    def go(portal, at, done, left, crashed):
        nonlocal seen
        seen += 1
        # Whatever has happened: the next owner gets catalogue and control record to agree, and can commit.
        after = deepcopy(portal)
        assert after.step("acquire", "c", None, None) == "OK"
        assert after.step("recover", "c", None, None) in ("PROJECTED", "CLEAN") and after.head == after.baseline == portal.baseline
        late = deepcopy(after)
        for w in "ab":  # what an old writer still sends changes nothing
            for cmd in ("catalog", "control"):
                assert late.step(cmd, w, w, "ok") in ("CONFLICT", "OUT_OF_ORDER") and (late.head, late.baseline) == (after.head, after.baseline)
        assert [after.step(x, "c", "rc", "ok") for x in SCRIPT] == ["OK", "OK", "COMMITTED"] and after.baseline == after.head == "rc"
        if not left:
            ends.add((portal.baseline, portal.head))
            return
        steps = [(w, cmd, answer) for w in "ab" for cmd in moves(portal, w, at[w], done[w]) for answer in (("ok", "lost", "dropped") if cmd in ("catalog", "control") else ("ok",))]
        steps += [(w, "crash", "ok") for w in "ab" if w not in crashed and w in portal.attempts] + [("b", "acquire", "ok")] * (portal.owner == "a")
        if not steps:
            ends.add((portal.baseline, portal.head))
        for w, cmd, answer in steps:
            now = deepcopy(portal)
            result = now.step(cmd, w, f"r{w}", answer)
            check(now, portal, cmd, w, answer, result)
            go(now, at | {w: at[w] + (cmd in SCRIPT)}, done | {w: done[w] or result == "COMMITTED"}, left - 1, crashed | ({w} if cmd == "crash" else set()))

    start = Portal()
    start.step("acquire", "a", None, None)
    go(start, {"a": 0, "b": 0}, {"a": False, "b": False}, 6, frozenset())
    assert seen > 2000 and {("ra", "ra"), ("rb", "rb"), (None, "ra"), (None, "rb"), (None, None), ("ra", "rb")} <= ends


@pytest.mark.parametrize("answers", list(product(("ok", "lost", "dropped"), repeat=2)))
def test_an_alone_writer_commits_whatever_is_lost(answers):
    portal, left = Portal(), list(answers)
    portal.step("acquire", "a", None, None)
    portal.step("begin", "a", "r", None)
    for _ in range(12):
        phase = portal.attempts["a"].phase
        if phase == "NONE":
            break
        cmd = {"BEGUN": "catalog", "CATALOG": "control"}.get(phase, "reread")
        portal.step(cmd, "a", "r", (left.pop(0) if left else "ok") if cmd != "reread" else None)
    assert (portal.baseline, portal.head, portal.baseline_generation) == ("r", "r", 1)


def test_commits_fold_each_portal(spark):
    rng = random.Random(2)
    cmds = ("acquire", "begin", "catalog", "control", "reread", "crash", "recover", "odd")
    rows = [(f"p{p}", s, cmds[s % 5] if rng.random() < 0.8 else rng.choice(cmds), "a" if s // 5 % 3 else rng.choice("ab"), f"r{s}", rng.choice(("ok", "ok", "lost", "dropped"))) for p in range(20) for s in range(60)]
    df = spark.createDataFrame(rows, "portal_id string, seq long, cmd string, writer string, run_id string, answer string").repartition(3)
    want, portals = {}, {}
    for p, s, cmd, w, run, answer in rows:
        portal = portals.setdefault(p, Portal())
        want[p, s] = (portal.step(cmd, w, run, answer), portal.baseline, portal.head, portal.baseline_generation)
    got = {(r["portal_id"], r["seq"]): (r["result"], r["baseline"], r["head"], r["baseline_generation"]) for r in commits(df).collect()}
    assert got == want and {"COMMITTED", "CONFLICT", "AMBIGUOUS", "CONFIRMED", "PROJECTED"} <= {v[0] for v in want.values()}


def test_relative_requests_find_their_page(spark):
    enc = "/replay?url=http%3A%2F%2Fa.x%2Fd%2Fp%3Fq%3D1"
    rows = [
        (1, 1, enc, None, "http://a.x/d/p?q=1", "URL"),
        (1, 2, "/i/x.png", f"http://r{enc}", "http://a.x/i/x.png", "REFERER"),
        (1, 3, "/i/y.png", None, "http://a.x/i/y.png", "SESSION"),
        (1, 4, "/replay?other=1&url=http%3A%2F%2Fb.x%2F", None, "http://b.x/", "URL"),
        (1, 5, "/i/y.png?v=1", "http://elsewhere/", "http://b.x/i/y.png?v=1", "SESSION"),
        (2, 6, "/i/z.png", None, None, "NONE"),
        (2, 7, "/replay?x=1", f"http://r{enc}", None, "NONE"),
        (2, 8, "/replay?url=", None, None, "NONE"),
        (2, 9, "/replay?url=%ZZ", None, None, "NONE"),
        (None, 10, enc, None, "http://a.x/d/p?q=1", "URL"),
        (None, 11, "/i", None, None, "NONE"),
        (1, 30, "/late.css", None, "http://b.x/late.css", "SESSION"),
        (3, 31, "replayed", None, None, "NONE"),
    ]
    log = spark.createDataFrame([r[:4] for r in rows], "client_id long, request_no long, request string, referer string").repartition(3)
    for chunk in (1 << 20, 2, 1):  # a client's log in one chunk and in many
        got = {r["request_no"]: (r["target"], r["resolved_by"]) for r in replay.targets(log, chunk).collect()}
        assert got == {r[1]: r[4:] for r in rows}


def test_a_hot_client_is_dealt_in_chunks(spark):
    rng = random.Random(6)
    rows, last = [], {}
    for n in range(3000):
        c = 1 if rng.random() < 0.6 else rng.randrange(20)
        named = rng.random() < 0.05
        if named:
            last[c] = f"http://h{n}.x/"
        rows.append((c, n, f"/replay?url=http%3A%2F%2Fh{n}.x%2F" if named else "/a", None, last[c] if named else f"{last[c]}a" if c in last else None))
    log = spark.createDataFrame([r[:4] for r in rows], "client_id long, request_no long, request string, referer string").repartition(4)
    got = {r["request_no"]: r["target"] for r in replay.targets(log, 100).collect()}
    assert got == {r[1]: r[4] for r in rows}
