"""Operators on small literal tables: boundaries, precedence, order."""

import gzip
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cairn.functions import fingerprints
from cairn.operators import graph, integrity, ledger, observations, recovery, rules, snapshot, state
from cairn.plans import log_queries
from cairn.sources import warc

FOLDER = "/root/testdata/sf0.001"
ART = "url string, status string, content_hash string, title string, published_at string, author string"


def articles(spark, *rows):
    return spark.createDataFrame([(r + (None,) * 6)[:6] for r in rows], ART)


def test_change_precedence(spark):
    prev = articles(spark, ("same", "NEW", "h"), ("body", "NEW", "h"), ("meta", "NEW", "h", "t"), ("blank", "NEW", "h"), ("gone", "NEW", "h"), ("fail", "NEW", "h"), ("removed", "NEW", "h"), ("nohash", "NEW", ""))
    curr = articles(spark, ("same", "X", "h"), ("body", "X", "g", "other"), ("meta", "X", "h", "u"), ("blank", "X", "h", "u"), ("fail", "FETCH_FAILED", "g"), ("removed", "REMOVED", "g"), ("nohash", "X", "g"), ("new", "REMOVED"))
    got = {r["url"]: r["change"] for r in snapshot.article_classes(prev, curr).collect()}
    assert got == {"same": "UNCHANGED", "body": "CONTENT_CHANGED", "meta": "METADATA_CHANGED", "blank": "UNCHANGED", "gone": "NOT_OBSERVED", "fail": "FETCH_FAILED", "removed": "REMOVED", "nohash": "UNCHANGED", "new": "NEW"}


@pytest.mark.parametrize(("prev", "curr", "flags"), [(10, 5, (False,)), (10, 4, (True,)), (9, 0, (False,))])
def test_collapse_boundary(spark, prev, curr, flags):
    rows = spark.createDataFrame([(f"u{i}", "UNCHANGED" if i < curr else "NOT_OBSERVED") for i in range(prev)], "url string, change string")
    n = lambda x: spark.createDataFrame([(x,)], "n long")
    r = snapshot.anomalies(rows, n(0), n(3)).first()
    assert (r["collapsed"],) == flags and r["empty_head"] is False


def test_reorder_and_massive(spark):
    prev = spark.createDataFrame([(f"u{i}", i) for i in range(10)] + [("only", 3)], "url string, pos int")
    curr = spark.createDataFrame([(f"u{i}", (i + 1) % 10) for i in range(10)], "url string, pos int")
    assert snapshot.reordered(prev, curr).count() == 10
    assert snapshot.reordered(prev, prev).count() == 0


def test_page_changes(spark):
    schema = "url string, unordered_fingerprint string, ordered_fingerprint string, next_page_url string, previous_page_url string"
    prev = spark.createDataFrame([("a", "s", "o", "n", None), ("b", "s", "o", None, None), ("c", "s", "o", None, None), ("d", "s", "o", None, None), ("x", "s", "o", None, None)], schema)
    curr = spark.createDataFrame([("a", "s", "o", "n", None), ("b", "t", "p", None, None), ("c", "s", "p", "n", None), ("d", "s", "o", "n", None), ("e", "s", "o", None, None)], schema)
    assert {r["url"]: r["change"] for r in snapshot.page_changes(prev, curr).collect()} == {"a": "UNCHANGED", "b": "MEMBERSHIP_CHANGED", "c": "ORDER_CHANGED", "d": "PAGINATION_CHANGED", "e": "NEW_PAGE"}


PAGES = "pos int, url string, status_code int, set_fingerprint string, next_page_url string"


@pytest.mark.parametrize(
    ("pages", "head", "incomplete", "limit", "want"),
    [
        ([(1, "p1", 200, "A", "p2"), (2, "p2", 200, "B", None)], "A", False, 9, ["BOUNDARY_RECONCILED"]),
        ([(1, "p1", 200, "A", "p2"), (2, "p2", 200, "X", None)], "A", True, 9, ["COMPLETE", "COMPLETE"]),
        ([(1, "p1", 200, "Z", "p2"), (2, "p2", 200, "B", None), (3, "p3", 200, "C", None)], "A", False, 9, ["COMPLETE", "BOUNDARY_RECONCILED"]),
        ([(1, "p1", 403, "A", "p2"), (2, "p2", 200, "B", None)], "A", False, 9, ["ACCESS_GATE"]),
        ([(1, "p1", 500, "A", "p2"), (2, "p2", 200, "B", None)], "A", False, 9, ["FETCH_FAILED"]),
        ([(1, "p1", 200, "Z", "p2"), (2, "p2", 200, "Y", "p3"), (3, "p3", 200, "C", None)], None, False, 2, ["COMPLETE", "COMPLETE"]),
    ],
)
def test_incremental_prefix(spark, pages, head, incomplete, limit, want):
    prev = spark.createDataFrame([("p1", "A", "p2"), ("p2", "B", None)], "url string, set_fingerprint string, next_page_url string")
    got = snapshot.visited_pages(spark.createDataFrame(pages, PAGES), prev, head, incomplete, limit).orderBy("pos").collect()
    assert [r["outcome"] for r in got] == want


def test_prefixes_of_many_portals(spark):
    rows = [("a", 1, "p1", 200, "A", "p2", "A"), ("a", 2, "p2", 200, "B", None, "A"), ("b", 1, "p1", 200, "Z", "p2", "A"), ("b", 2, "p2", 200, "B", None, "A"), ("c", 1, "p1", 200, "A", "p2", None), ("c", 2, "p2", 500, "B", None, None)]
    pages = spark.createDataFrame(rows, "portal string, pos int, url string, status_code int, set_fingerprint string, next_page_url string, prev_head string")
    prev = spark.createDataFrame([(p, u, f, n) for p in "abc" for u, f, n in (("p1", "A", "p2"), ("p2", "B", None))], "portal string, url string, set_fingerprint string, next_page_url string")
    got = sorted(tuple(r) for r in snapshot.visited_pages(pages, prev, None, False, 9, ("portal",)).select("portal", "pos", "outcome").collect())
    assert got == [("a", 1, "BOUNDARY_RECONCILED"), ("b", 1, "COMPLETE"), ("b", 2, "BOUNDARY_RECONCILED"), ("c", 1, "COMPLETE"), ("c", 2, "FETCH_FAILED")]


def plain_stability(visits):
    out, last = [], {}
    for page, s, o in visits:
        before = last.get(page)
        kind = "FIRST_VISIT" if before is None else "ARTICLE_SET_CHANGED" if before[0] != s else "ORDER_CHANGED_ONLY" if before[1] != o else "NO_CHANGE"
        count = 1 if kind in ("FIRST_VISIT", "ARTICLE_SET_CHANGED") else before[2] + 1
        last[page] = (s, o, count)
        out.append((kind, count))
    return out


def test_stability_equals_loop(spark):
    rng = random.Random(1)
    visits = [(rng.randrange(4), rng.choice("ab"), rng.choice("xy")) for _ in range(200)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(visits)], "n long, page int, s string, o string").repartition(5)
    got = observations.stability(df, "page", ["n"], "s", "o").orderBy("n").collect()
    assert [(r["change_type"], r["stable_count"]) for r in got] == plain_stability(visits)


def test_budget_keeps_one_row_more(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "g int, n int")
    got = observations.within_budget(df, ["n"], 3, ["g"]).orderBy("n").collect()
    assert [r["exhausted"] for r in got] == [False, False, False, True]
    assert observations.request_budget("NAIVE", 5) == 7 and observations.request_budget("ROBUST_HEAD_VERIFIED", 5) == 30


def test_recall_of_nothing(spark):
    empty = spark.createDataFrame([], "k int")
    r = observations.recall(empty, empty, "k").first()
    assert (r["recall"], r["precision"]) == (0.0, 0.0)


def test_revisits(spark):
    changed = spark.createDataFrame([(1,), (3,)], "page int")
    visits = spark.createDataFrame([(1, 1), (2, 4), (3, 1), (4, 1)], "page int, n int")
    assert sorted(r["page"] for r in observations.revisits(changed, "page", visits, 4).collect()) == [1, 3, 4]


def test_upsert_policies(spark):
    base = spark.createDataFrame([("a", "f0", "l0", "t0", 2)], "k string, first string, last string, title string, n long")
    delta = spark.createDataFrame([("a", "f1", "l1", None, 1), ("a", "f2", None, "t2", 2), ("b", "f3", "l3", None, 1)], "k string, first string, last string, title string, seq int")
    got = {r["k"]: tuple(r)[1:] for r in ledger.upsert(base, delta, ["k"], {"first": "keep", "last": "replace", "title": "coalesce", "n": "count"}, "seq").collect()}
    assert got == {"a": ("f0", None, "t2", 4), "b": ("f3", "l3", None, 1)}


def test_pointer_follows_registration(spark):
    runs = spark.createDataFrame([("p", 1, "r1", "CONVERGED"), ("p", 2, "r0", "COMPLETED"), ("p", 3, "r9", "FAILED"), ("q", 1, "x", "RUNNING")], "portal string, seq int, run string, status string")
    got = {r["portal"]: r["pointer"] for r in ledger.pointers(runs, ["portal"], "status", "seq", "run").collect()}
    assert got == {"p": "r0", "q": None}


def traversal(spark, edges, roots, depth):
    e = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src string, dst string, pos long")
    nodes, links = graph.traverse(e, spark.createDataFrame([(r,) for r in roots], "node string"), depth)
    return nodes, {k: n for k, n in links.groupBy("kind").count().collect()}


def test_traversal_counts(spark):
    nodes, kinds = traversal(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "r"), ("c", "c"), ("c", "d"), ("d", "e")], ["r"], 3)
    assert {r["node"]: r["depth"] for r in nodes.collect()} == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    assert kinds == {"NEW": 4, "KNOWN": 1, "CYCLE": 2, "TOO_DEEP": 1}
    assert [r["node"] for r in graph.depth_first_order(nodes).orderBy("rank").collect()] == ["r", "b", "a", "c", "d"]


def test_traversal_of_shared_children_and_dead_ends(spark):
    nodes, kinds = traversal(spark, [("r", "a"), ("r", "b"), ("a", "x"), ("b", "x"), ("a", "r")], ["r"], 5)
    assert nodes.count() == 4 and kinds == {"NEW": 3, "KNOWN": 1, "CYCLE": 1}
    nodes, kinds = traversal(spark, [], ["r"], 5)
    assert nodes.count() == 1 and kinds == {}


PAGES_OF = lambda x, n: [(x, f"{x}?{k}") for k in range(1, n + 1)]
SCENARIOS = {
    "two levels": ([("r", "t"), ("r", "s"), *PAGES_OF("t", 2), *PAGES_OF("s", 2)], {"t?1": 3, "t?2": 3, "s?1": 3, "s?2": 3}, 5, (7, 1.0, 1.0, 0, 0), 4, 3),
    "three levels": ([("r", "g"), ("r", "h"), ("g", "a"), ("g", "b"), ("h", "c"), *PAGES_OF("a", 1), *PAGES_OF("b", 1), *PAGES_OF("c", 1)], {"a?1": 2, "b?1": 2, "c?1": 2}, 5, (9, 1.0, 1.0, 0, 0), 3, 2),
    "shared child": ([("r", "e"), ("r", "c"), ("e", "x"), ("c", "x"), *PAGES_OF("x", 1)], {"x?1": 2}, 5, (5, 1.0, 1.0, 0, 1), 2, 2),
    "cycle": ([("r", "a"), ("a", "b"), ("a", "a?1"), ("b", "a"), ("b", "b?1")], {"a?1": 1, "b?1": 1}, 5, (5, 1.0, 1.0, 1, 0), 2, 2),
    "too deep": ([(f"d{i}", f"d{i + 1}") for i in range(7)], {"d7": 2}, 4, (5, 0.0, 0.625, 0, 0), 1, 1),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_traversal_reports(spark, name):
    edges, articles, depth, want, breadth, deep = SCENARIOS[name]
    root = edges[0][0]
    e = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src string, dst string, pos long")
    nodes, links = graph.traverse(e, spark.createDataFrame([(root,)], "node string"), depth)
    found = spark.createDataFrame([(n, f"{n}/{k}") for n, m in articles.items() for k in range(m)], "node string, article string")
    r = graph.traversal_report(nodes, links, found, len({x for p in edges for x in p}), sum(articles.values())).first()
    assert (r["requests"], r["article_recall"], r["navigation_recall"], r["cycles"], r["duplicate_navigation"]) == want
    assert graph.frontier(nodes).first()["max_frontier"] == breadth and graph.frontier(nodes, True).first()["max_frontier"] == deep


def test_chains(spark):
    links = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", None, "CONTENT"), ("l", "m", "R"), ("m", "l", "R"), ("z", "nowhere", "R")] + [(f"n{i}", f"n{i + 1}", "R") for i in range(9)], "node string, target string, kind string")
    starts = spark.createDataFrame([(x,) for x in ("a", "l", "z", "n0", "n4", "q")], "start string")
    got = {r["start"]: (r["hops"], r["reason"]) for r in graph.chains(links, starts, 5).collect()}
    assert got == {"a": (2, "CONTENT"), "l": (1, "LOOP"), "z": (1, "MISSING"), "n0": (5, "TOO_LONG"), "n4": (5, "MISSING"), "q": (0, "MISSING")}


RESPONSE = "url string, in_session boolean, status_code int, page_type string, gate_type string, interaction string, target_url string, sets_cookie boolean, next_page_url string"
U = "https://h.x/"


def page(name, following=None, status=200):
    return (U + name, None, status, "CONTENT", None, None, None, False, U + following if following else None)


def gate(name, target=None, kind="AGE", act="CONFIRM", cookie=True, inside=False):
    return (U + name, inside, 200, "GATE", kind, act, U + (target or name), cookie, None)


def hop(name, target):
    return (U + name, None, 302, "REDIRECT", None, None, target if "://" in target else U + target, False, None)


def inside(name, following=None):
    return (U + name, True, 200, "CONTENT", None, None, None, False, U + following if following else None)


SESSIONS = {
    "no gate": ([page("a")], ["a"], [("RESOLVED", 1, False)], [("LAST_PAGE_REACHED", 1, 1)]),
    "age gate": ([gate("a"), inside("a")], ["a"], [("RESOLVED", 2, True)], [("LAST_PAGE_REACHED", 1, 2)]),
    "session for a site": ([x for n in "abc" for x in (gate(n), inside(n))], list("abc"), [("RESOLVED", 2, True), ("RESOLVED", 1, True), ("RESOLVED", 1, True)], None),
    "redirect to a gate": ([hop("a", "m"), gate("m", "d"), page("d")], ["a"], [("RESOLVED", 3, False)], [("LAST_PAGE_REACHED", 1, 3)]),
    "gate loop": ([gate("a", cookie=False)], ["a"], [("GATE_LOOP_DETECTED", 1, False)], [("GATE_RESOLUTION_FAILED_GATE_LOOP_DETECTED", 0, 1)]),
    "denied gate": ([gate("a", kind="LOGIN")], ["a"], [("GATE_BLOCKED", 1, False)], [("GATE_RESOLUTION_FAILED_GATE_BLOCKED", 0, 1)]),
    "unsupported": ([gate("a", act="UNSUPPORTED")], ["a"], [("UNSUPPORTED_GATE", 1, False)], None),
    "external": ([hop("a", "https://o.y/")], ["a"], [("OUT_OF_SCOPE_GATE_TARGET", 1, False)], [("GATE_RESOLUTION_FAILED_OUT_OF_SCOPE_GATE_TARGET", 0, 1)]),
    "redirect loop": ([hop("a", "b"), hop("b", "a")], ["a"], [("REDIRECT_LOOP_DETECTED", 2, False)], None),
    "five hops": ([hop(f"r{i}", f"r{i + 1}") for i in range(5)] + [page("r5")], ["r0"], [("RESOLVED", 6, False)], None),
    "six hops": ([hop(f"r{i}", f"r{i + 1}") for i in range(6)] + [page("r6")], ["r0"], [("REDIRECT_LIMIT_EXCEEDED", 6, False)], None),
    "budget of an origin": ([gate(f"g{i}", f"g{i + 1}", inside=None) for i in range(4)] + [page("g4")], ["g0"], [("GATE_ORIGIN_BUDGET_EXHAUSTED", 4, False)], None),
    "three pages": ([page("a", "b"), page("b", "c"), page("c")], ["a"], None, [("LAST_PAGE_REACHED", 3, 3)]),
    "page loop": ([page("a", "b"), page("b", "a")], ["a"], None, [("ARTICLE_PAGE_LOOP_DETECTED", 2, 2)]),
    "missing page": ([page("a", "b"), page("b", status=404)], ["a"], None, [("GATE_RESOLUTION_FAILED_FETCH_FAILED", 1, 2)]),
    "gate on page two": ([page("a", "b"), gate("b"), inside("b", "c"), page("c")], ["a"], None, [("LAST_PAGE_REACHED", 3, 4)]),
    "eleven pages": ([page(f"p{i}", f"p{i + 1}") for i in range(10)] + [page("p10")], ["p0"], None, [("PAGE_BUDGET_EXHAUSTED", 10, 10)]),
    "nothing recorded": ([page("z")], ["a"], [("FETCH_FAILED", 1, False)], None),
}


def test_gates(spark):
    """All scenarios at once: each is a session on hosts of its own."""
    here = lambda i, u: u.replace("https://h.x/", f"https://h{i}.x/") if u else u
    responses, requests, hosts = [], [], []
    for i, (pages, asked, *_) in enumerate(SESSIONS.values()):
        responses += [tuple(here(i, v) if isinstance(v, str) else v for v in p) for p in pages]
        requests += [(str(i), k, here(i, U + a)) for k, a in enumerate(asked)]
        hosts.append(f"h{i}.x")
    df = spark.createDataFrame(responses, RESPONSE)
    asked = spark.createDataFrame(requests, "session string, seq long, url string")
    single, whole = ({(r["session"], r["seq"]): r for r in graph.resolve_gates(asked, df, tuple(hosts), ("AGE",), follow).collect()} for follow in (False, True))
    for i, (name, (_, _, one, article)) in enumerate(SESSIONS.items()):
        for k, want in enumerate(one or ()):
            r = single[str(i), k]
            assert (r["status"], r["requests"], r["session_reused"]) == want, name
        for k, want in enumerate(article or ()):
            r = whole[str(i), k]
            assert (r["status"], r["components"], r["requests"]) == want, name


def test_logical_articles(spark):
    rows = [("one", 1, "u1", None), ("loop", 1, "u1", "u2"), ("loop", 2, "u2", "u1"), ("gap", 1, "u1", "u9"), ("long", 1, "u1", "u2"), ("long", 2, "u2", "u3"), ("long", 3, "u3", None)]
    df = spark.createDataFrame(rows, "article string, pos int, url string, next string")
    got = {r["article"]: (r["n_pages"], r["reason"]) for r in graph.logical_articles(df, "article", "pos", "next", "url", 2).collect()}
    assert got == {"one": (1, "LAST_PAGE_REACHED"), "loop": (2, "ARTICLE_PAGE_LOOP_DETECTED"), "gap": (1, "NEXT_PAGE_MISSING"), "long": (2, "PAGE_BUDGET_EXHAUSTED")}


def test_manifests(spark):
    m = spark.createDataFrame([("a", "X"), ("b", "y"), ("c", "z")], "path string, sha256 string")
    f = spark.createDataFrame([("a", "x"), ("b", "no"), ("d", "q")], "path string, sha256 string")
    states = integrity.verify(m, f)
    assert {r["path"]: r["state"] for r in states.collect()} == {"a": "VERIFIED", "b": "MISMATCH", "c": "MISSING", "d": "UNEXPECTED"}
    assert integrity.rollup(states).first()["is_valid"] is False
    assert integrity.rollup(states.limit(0)).first()["is_valid"] is True
    assert integrity.manifest_text(f.limit(0)).first()["text"] == "\n"
    assert integrity.manifest_text(spark.createDataFrame([("b\\c", "2"), ("a", "1")], "path string, sha256 string")).first()["text"] == "1  a\n2  b/c\n"


def test_quota_limits(spark):
    files = spark.createDataFrame([("p", 1)] * 100 + [("q", 1)] * 101 + [("r", 50 * 1024**3 + 1)], "p string, n long")
    assert {r["p"]: r["within_quota"] for r in integrity.quota(files, "n", ["p"]).collect()} == {"p": True, "q": False, "r": False}


def test_reconciliation(spark):
    catalog = spark.createDataFrame([("p", "r1", "CONVERGED"), ("p", "r2", "CONVERGED"), ("p", "r3", "CONVERGED")], "portal_id string, run_id string, status string")
    packages = spark.createDataFrame([("p", "r1", True, True, "CONVERGED", 0), ("p", "r2", False, True, "CONVERGED", 0), ("p", "r4", True, True, "CONVERGED", 0), ("q", "r5", True, True, "FAILED", 0), ("q", "r6", True, True, "CONVERGED", 2)], "portal_id string, run_id string, is_valid boolean, has_state boolean, status string, n_anomalies int")
    states = recovery.classes(catalog, packages)
    assert {r["run_id"]: r["state"] for r in states.collect()} == {"r1": "VALID", "r2": "CORRUPTED", "r3": "MISSING_PACKAGE", "r4": "ORPHAN", "r5": "AMBIGUOUS", "r6": "AMBIGUOUS"}
    assert {r["portal_id"]: r["action"] for r in recovery.actions(states).collect()} == {"p": "ADOPT_ORPHAN", "q": "MANUAL_REVIEW"}
    runs = spark.createDataFrame([("p", "r1", 1, "CONVERGED"), ("p", "r2", 2, "CONVERGED")], "portal_id string, run_id string, seq int, status string")
    assert [tuple(r) for r in recovery.fallback_heads(states, runs).collect()] == [("p", "r2", "r1")]


def test_outbox_guards():
    e = state.Outbox()
    assert e.step("claim", 0, "t", None, False) == "UNKNOWN_EVENT" and e.step("insert", 0, None, None, False) == "OK" and e.step("insert", 0, None, None, False) == "EXISTS"
    for k in range(5):
        assert e.step("claim", 100 * k, f"t{k}", None, False) == "OK"
        assert e.step("renew", 100 * k + 1, "wrong", None, False) == "LEASE_LOST"
        assert e.step("complete", 100 * k + 60, f"t{k}", None, False) == "LEASE_LOST"
        if k < 4:
            assert e.step("claim", 100 * k + 59, "x", None, False) == "NOT_DUE"
    assert e.step("claim", 1000, "t", None, False) == "NOT_DUE" and e.status == "RECONCILIATION_REQUIRED" and e.attempts == 5
    e = state.Outbox()
    e.step("insert", 0, None, None, False)
    e.step("claim", 0, "t", None, False)
    assert e.step("retry", 1, "t", "boom", False) == "OK" and (e.status, e.next_at) == ("RETRY", 31)
    assert e.step("claim", 30, "u", None, False) == "NOT_DUE" and e.step("claim", 31, "u", None, False) == "OK"
    assert e.step("retry", 32, "u", "boom", True) == "OK" and e.status == "RECONCILIATION_REQUIRED"


def test_lease_guards():
    x = state.Lease()
    assert x.step("acquire", "a", 0, 10, None, None) == "OK" and x.step("acquire", "a", 5, 10, None, None) == "HELD"
    assert x.step("commit", "a", 5, 10, 1, "r1") == "OK" and x.step("renew", "a", 5, 10, 2, None) == "LEASE_LOST"
    assert x.step("renew", "a", 9, 10, 1, None) == "OK" and x.step("acquire", "b", 19, 10, None, None) == "OK" and x.generation == 2
    assert x.step("commit", "a", 20, 10, 1, "r2") == "LEASE_LOST" and x.step("release", "b", 20, 10, 2, None) == "OK" and x.owner is None


def test_folds_run_per_key(spark):
    rows = [("e1", 1, "insert", 0), ("e1", 2, "claim", 1), ("e1", 3, "complete", 2), ("e2", 1, "claim", 0)]
    df = spark.createDataFrame([(k, s, c, a, "t", None, False) for k, s, c, a in rows], "event_id string, seq long, cmd string, at long, token string, error string, reconcile boolean")
    got = {(r["event_id"], r["seq"]): (r["result"], r["status"]) for r in state.outbox(df).collect()}
    assert got == {("e1", 1): ("OK", "PENDING"), ("e1", 2): ("OK", "IN_FLIGHT"), ("e1", 3): ("OK", "COMPLETED"), ("e2", 1): ("UNKNOWN_EVENT", "ABSENT")}


def test_rule_repair(spark):
    old, new = "<article><h1 class='t'>A</h1></article>", "<article><h2 class='head'>A</h2></article>"
    pages = spark.createDataFrame([(1, "", new), (2, "", new), (3, "", old)], "page_id long, url string, html string")
    config = {"selectors": {"title": {"selector": "h1.t", "type": "css"}}, "version": 1}
    fixed = rules.FixedRules({"title": {"selector": "article > h2.head, article > h1", "type": "css"}})
    same, report = rules.repair(pages, config, fixed, approved=False)
    assert same["version"] == 1 and report == [{"field": "title", "old_rate": 0.3333, "new_rate": 1.0, "applied": False}]
    done, _ = rules.repair(pages, config, fixed, approved=True)
    assert done["version"] == 2 and done["history"][0]["rule"] == config["selectors"]["title"] and config["version"] == 1
    assert rules.accepted(rules.validate(pages, done["selectors"])).first()["accepted"]
    assert rules.repair(pages, done, fixed, True) == (done, [])


def warc_file(path, records, compress=True):
    data = b"".join(warc.encoded(u, s, m, p, compress=False) for u, s, m, p in records)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with open(path, "wb") as f:
        f.write(gzip.compress(info + data) if compress else info + data)


def test_warc_reading(spark, tmp_path):
    page = b"<p>caf\xe9</p>"
    warc_file(tmp_path / "a.warc.gz", [("http://H.x/a", 200, "text/html", page), ("http://h.x/a#f", 404, "text/html", b""), ("http://h.x/i.html", 200, "image/png", b"\x00")])
    warc_file(tmp_path / "b.warc", [("http://h.x/b/", 200, "application/xhtml+xml", b"x")], compress=False)
    rows = warc.read(spark, str(tmp_path))
    assert rows.count() == 4 and warc.read(spark, str(tmp_path), all_records=True).count() == 6
    assert warc.read(spark, str(tmp_path), payload=False).filter("payload IS NOT NULL").count() == 0
    assert warc.html_records(rows).count() == 3 and warc.html_records(rows, loose=False).count() == 2
    index = warc.resources(rows)
    assert {r["norm_uri"]: r["status_code"] for r in index.collect()} == {"http://h.x/a": 404, "http://h.x/i.html": 200, "http://h.x/b/": 200}
    assert rows.filter("target_uri = 'http://H.x/a'").select(warc.decoded("payload").alias("t")).first()["t"] == "<p>café</p>"
    asked = spark.createDataFrame([(1, "http://h.x/b"), (2, "https://h.x/b/"), (3, "http://h.x/none")], "request_no int, url string")
    assert {r["request_no"]: r["outcome"] for r in warc.replayed(asked, index).collect()} == {1: "FOUND", 2: "FOUND", 3: "RESOURCE_NOT_IN_ARCHIVE"}


def test_warc_faults_and_containers(spark, tmp_path):
    bad = tmp_path / "bad.warc"
    bad.write_bytes(b"not a warc\r\n\r\n")
    assert warc.validated(str(bad))["error"].startswith("PARSE_ERROR") and warc.validated(str(tmp_path / "none"))["error"] == "FILE_NOT_FOUND"
    (tmp_path / "empty.warc").write_bytes(b"")
    assert warc.validated(str(tmp_path / "empty.warc"))["error"] == "EMPTY_FILE"
    short = tmp_path / "short.warc"
    short.write_bytes(warc.encoded("u", 200, "text/html", b"x" * 50, compress=False)[:-30])
    assert not warc.validated(str(short))["valid"]
    with zipfile.ZipFile(tmp_path / "c.wacz", "w") as z:
        z.writestr("archive/d.warc.gz", warc.encoded("http://h.x/z", 200, "text/html", b"zz"))
        z.writestr("pages/pages.jsonl", '{"format":"x"}\n{"url":"http://h.x/z"}\nbroken\n')
    assert [r["target_uri"] for r in warc.read(spark, str(tmp_path / "c.wacz")).collect()] == ["http://h.x/z"]
    assert [r[1] for r in warc.page_lines(str(tmp_path / "c.wacz")) if r[1]] == ["http://h.x/z"]
    odd = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 22\r\n\r\nHTTP/1.1 abc\r\n\r\nhello!"
    assert [r[6:8] for r in warc.records(io.BytesIO(odd), "f")] == [(None, None)]


def test_warc_round_trip(spark, tmp_path):
    downloads = spark.createDataFrame([("http://a/1", 200, "text/html", "html", bytearray(b"one")), ("http://a/2", 0, "text/html", "html", bytearray(b"x")), ("http://a/3", 200, "image/png", "image", bytearray(b"")), ("http://a/4", 200, "text/css", "css", bytearray(b"four"))], "url string, status_code int, content_type string, resource_type string, payload binary")
    told = warc.write(warc.harvest(downloads).coalesce(1), str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    assert sorted(r["uri"] for r in told.collect()) == ["http://a/1", "http://a/4"]
    assert {r["target_uri"]: bytes(r["payload"]) for r in back.collect()} == {"http://a/1": b"one", "http://a/4": b"four"}
    assert back.join(told, F.col("target_uri") == F.col("uri")).filter(F.sha2("payload", 256) == F.col("payload_sha256")).count() == 2


def test_split_of_pages(spark):
    pages = spark.createDataFrame([(f"u{i}",) for i in range(7)], "url string")
    assert [r["part"] for r in warc.sample_split(pages).orderBy("url").collect()] == ["generation"] * 3 + ["validation"] * 2 + ["held_out"]
    with pytest.raises(ValueError):
        warc.sample_split(pages.limit(5))


def test_fingerprint_ignores_input_order(spark):
    rows = [(i, f"u{i % 7}") for i in range(50)]
    random.Random(1).shuffle(rows)
    a = spark.createDataFrame(rows, "p long, u string").repartition(6).agg(fingerprints.ordered(F.col("u"), F.col("p"))).first()
    b = spark.createDataFrame(sorted(rows), "p long, u string").agg(fingerprints.ordered(F.col("u"), F.col("p"))).first()
    assert a == b


def test_conditional_writes():
    o = state.Stored()
    steps = [("put_if_match", 0, "NOT_FOUND"), ("get", None, "NOT_FOUND"), ("put_new", None, "OK"), ("put_new", None, "CONFLICT"), ("put_if_match", 0, "PRECONDITION_FAILED"), ("put_if_match", 1, "OK"), ("put_if_match", 1, "PRECONDITION_FAILED"), ("put_if_match", None, "PRECONDITION_FAILED"), ("odd", 2, "UNKNOWN_COMMAND"), ("delete", None, "OK"), ("put_if_match", 2, "NOT_FOUND"), ("put_new", None, "OK"), ("get", None, "OK")]
    assert [o.step(cmd, etag) for cmd, etag, _ in steps] == [want for *_, want in steps] and o.version == 3


def test_head_folder_is_kept_by_its_run_dir(spark):
    folders = spark.createDataFrame([("p", n, False, False, 1) for n in ("a1", "b2", "c3", "xb2", "")], "portal_id string, name string, is_package boolean, has_anomaly boolean, bytes long")
    heads = spark.createDataFrame([("p", "c3", "/runs/xb2/")], "portal_id string, head_run string, run_dir string")
    got = {r["name"]: r["reason"] for r in recovery.retention(folders, heads, 1).collect()}
    assert got == {"a1": "RECENT", "b2": "HEAD", "xb2": "HEAD", "c3": "HEAD", "": "REMOVABLE"}


def test_reach_follows_the_starts_and_not_the_graph(spark, monkeypatch):
    steps = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(2000)] + [(f"n{i}", f"n{i // 2}") for i in range(2000)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "url string, target string").repartition(4)
    starts = spark.createDataFrame([("a",), ("d",), ("n1998",), ("nowhere",), ("a",)], "start string")
    kept, stored = [], graph._stored
    monkeypatch.setattr(graph, "_stored", lambda df: kept.append(out := stored(df)) or out)
    got = {(r["start"], r["url"]) for r in graph.reached(starts, steps, 3).collect()}
    want, edges = set(), {}
    for r in steps.collect():
        edges.setdefault(r["url"], set()).add(r["target"])
    for s in ("a", "d", "n1998", "nowhere"):
        level = {s}
        for _ in range(4):
            want |= {(s, u) for u in level}
            level = {t for u in level for t in edges.get(u, ())}
    assert got == want and sum(df.count() for df in kept) < 40
    monkeypatch.setattr(graph, "GATHER", 2)
    assert {r["url"] for r in graph.reached(starts.filter("start = 'a'"), steps, 50).collect()} == {"a", "b", "c", "d"}


def test_reach_is_bound_by_no_number_of_rows(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "3")  # a recursive query fails beyond it
    try:
        edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "r"), ("r", None), ("a", "c"), ("c", "d"), ("d", "e"), ("s", "c"), ("s", "s"), ("x", "y")], "src string, dst string")
        roots = spark.createDataFrame([("r",), ("s",), ("r",)], "node string")
        assert sorted(map(tuple, graph.reach(edges, roots, 2).collect())) == [("a", 1), ("b", 2), ("c", 1), ("d", 2), ("r", 0), ("s", 0)]
        assert log_queries.nav_reach(spark, FOLDER).count() > 3
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
