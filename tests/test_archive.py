"""Packages, state documents, rule files, whole runs and policies."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.operators import crawl, observations
from cairn.sources import config, packages, snapshots, state_json, warc


def test_packages_are_sealed(spark, tmp_path):
    path = str(tmp_path / "pkg")
    tables = {"a": spark.range(5), "b/c": spark.range(3).withColumn("x", F.lit("y"))}
    states = packages.write(tables, path, {"run": "r1"})
    assert {r["state"] for r in states.collect()} == {"VERIFIED"} and packages.is_valid(spark, path)
    before = packages.fingerprint(spark, path)
    with pytest.raises(FileExistsError):
        packages.write(tables, path)
    file = next((tmp_path / "pkg" / "a").glob("*.parquet"))
    file.write_bytes(file.read_bytes() + b"!")
    (tmp_path / "pkg" / "a" / "more.txt").write_text("x")
    next((tmp_path / "pkg" / "b" / "c").glob("*.parquet")).unlink()
    for crc in (tmp_path / "pkg").rglob("*.crc"):
        crc.unlink()
    got = packages.verification(spark, path).groupBy("state").count().collect()
    assert {"MISMATCH", "UNEXPECTED", "MISSING"} <= {r["state"] for r in got} and not packages.is_valid(spark, path)
    assert packages.fingerprint(spark, path) == before and not packages.is_valid(spark, str(tmp_path / "none"))


def test_backup_and_restore(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "t"))
    packages.backup(spark, {"t": str(tmp_path / "t")}, str(tmp_path / "backup"))
    with pytest.raises(FileExistsError):
        packages.restore(spark, str(tmp_path / "backup"), {"t": str(tmp_path / "t")})
    packages.restore(spark, str(tmp_path / "backup"), {"t": str(tmp_path / "u")})
    assert spark.read.parquet(str(tmp_path / "u")).count() == 4


def test_state_documents(spark, tmp_path):
    doc = {
        "portal_id": "p", "run_id": "r", "unknown": 1, "archive_order": ["u2", "u1"],
        "articles": {"u1": {"canonical_url": "u1", "title": "T", "metadata": {"html": "<p>"}}, "u2": {"canonical_url": "u2", "status": "NEW", "odd": True}, "u3": {"canonical_url": "u3"}},
        "archive_pages": {"x": {"url": "x", "article_urls": ["u2", "u1"], "page_number": 1}},
    }
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    states = state_json.read_states(spark, str(tmp_path / "s.json"))
    a = {r["url"]: r for r in state_json.articles(states).collect()}
    assert (a["u2"]["pos"], a["u1"]["pos"], a["u3"]["pos"]) == (1, 2, None) and a["u1"]["status"] == "UNCHANGED" and a["u2"]["status"] == "NEW"
    assert [r["html"] for r in state_json.stored_html(states).collect()] == ["<p>"]
    assert state_json.pages(states).first()["crawl_status"] == "COMPLETE"
    assert tuple(state_json.snapshots(states).first())[-2:] == (3, 1)
    back = state_json.states_of(state_json.snapshots(states), state_json.articles(states), state_json.pages(states)).first()
    again = json.loads(back["document"])
    assert again["archive_order"] == ["u2", "u1"] and again["articles"]["u1"]["title"] == "T" and again["archive_pages"]["x"]["page_number"] == 1


def test_catalog_documents(spark, tmp_path):
    doc = {"portal_id": "p", "latest_successful_run_id": "r2", "all_run_ids": ["r1", "r2"], "runs": {"r1": {"run_id": "r1", "status": "FAILED"}, "r2": {"run_id": "r2", "status": "CONVERGED", "article_count": 4}}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    runs = state_json.read_catalogs(spark, str(tmp_path / "c.json"))
    assert {r["run_id"]: (r["seq"], r["is_head"]) for r in runs.collect()} == {"r1": (1, False), "r2": (2, True)}
    more = runs.unionByName(runs.limit(1).withColumn("run_id", F.lit("__system__")))
    out = json.loads(state_json.catalogs_of(more, runs.filter("is_head").select("portal_id", F.col("run_id").alias("pointer"))).first()["document"])
    assert out["all_run_ids"] == ["r1", "r2"] and out["latest_successful_run_id"] == "r2" and out["runs"]["r2"]["article_count"] == 4


def test_rule_files():
    text = "selectors:\n  title:\n    selector: h1.a\n  body: div.b\nmetadata:\n  version: 3\n  acceptance_threshold: 0.8\n"
    rules = config.parse_rules(text)
    assert rules == {"selectors": {"title": {"selector": "h1.a", "type": "css"}, "body": {"selector": "div.b", "type": "css"}}, "version": 3, "threshold": 0.8}
    assert config.parse_rules(config.rules_text(rules)) == rules and config.parse_rules("")["version"] == 1


def frames(spark, pages, articles=(), probes=(), prev=()):
    log = spark.createDataFrame([(i + 1, u, s, a, n) for i, (u, s, a, n) in enumerate(pages)], "pos int, url string, status_code int, article_urls array<string>, next_page_url string")
    art = spark.createDataFrame([(u, s, "t", None, "a", h) for u, s, h in articles], "url string, status_code int, title string, published_at string, author string, content_hash string")
    pr = spark.createDataFrame(list(probes), "url string, status_code int")
    old = spark.createDataFrame([(u, "r0", "t", None, "a", h, "CAPTURED", "w", "i", "NEW") for u, h in prev], "url string, first_seen_run_id string, title string, published_at string, author string, content_hash string, capture_status string, warc_file string, warc_record_id string, status string")
    return log, art, pr, old


A, B, C, D = (f"https://x.y/{n}" for n in "abcd")


def test_whole_run(spark):
    log, art, pr, old = frames(spark, [("p1", 200, [A + "/", B, ""], "p2"), ("p2", 200, [B, C], None)], [(A, 200, "h2"), (C, 200, "h3")], [(D, 404)], [(A, "h1"), (B, "hb"), (D, "hd")])
    none = spark.createDataFrame([], "url string, set_fingerprint string, next_page_url string")
    run = crawl.incremental_run(log, art, pr, none, old, None, "r1")
    assert {r["url"]: r["change"] for r in run.classes.collect()} == {A: "CONTENT_CHANGED", B: "UNCHANGED", C: "NEW", D: "REMOVED"}
    assert {r["url"]: r["first_seen_run_id"] for r in run.articles.collect()} == {A: "r0", B: "r0", C: "r1", D: "r0"}
    s = run.summary.first()
    assert (s["n_pages"], s["n_new"], s["n_removed"], s["convergence"]) == (2, 1, 1, "CONVERGED")


@pytest.mark.parametrize(("status", "urls", "want"), [(403, [A], "MANUAL_REVIEW_REQUIRED"), (200, [], "MANUAL_REVIEW_REQUIRED"), (500, [A], "FAILED"), (200, [A], "CONVERGED")])
def test_convergence_of_one_page(spark, status, urls, want):
    log, art, pr, old = frames(spark, [("p1", status, urls, None)])
    none = spark.createDataFrame([], "url string, set_fingerprint string, next_page_url string")
    assert crawl.incremental_run(log, art, pr, none, old, None, "r1").summary.first()["convergence"] == want


def test_article_statuses(spark):
    log, art, pr, old = frames(spark, [("p1", 200, [A, B, C, D], None)], [(A, 410, "h"), (B, 500, "h2"), (C, 403, "h3"), (D, None, "h4")], prev=[(A, "h1"), (B, "h1"), (C, "h1"), (D, "h1")])
    none = spark.createDataFrame([], "url string, set_fingerprint string, next_page_url string")
    run = crawl.incremental_run(log, art, pr, none, old, None, "r1")
    assert {r["url"]: r["change"] for r in run.classes.collect()} == {A: "REMOVED", B: "FETCH_FAILED", C: "UNCHANGED", D: "CONTENT_CHANGED"}
    assert {r["url"]: (r["capture_status"], r["content_hash"]) for r in run.articles.collect()} == {A: ("REMOVED", "h1"), B: ("FAILED", "h1"), C: ("REUSED", "h1"), D: ("CAPTURED", "h4")}
    assert run.summary.first()["convergence"] == "MANUAL_REVIEW_REQUIRED"


def test_unchanged_head_ends_the_run(spark):
    log, art, pr, old = frames(spark, [("p1", 200, [A, B], "p2"), ("p2", 200, [C], None)], prev=[(A, "h"), (B, "h"), (C, "h")])
    fp = crawl.page_states(log).filter("pos = 1").select("url", "set_fingerprint", "next_page_url")
    head = fp.first()["set_fingerprint"]
    run = crawl.incremental_run(log, art, pr, fp, old, head, "r1")
    assert run.pages.count() == 1 and run.summary.first()["reconciled"]
    assert crawl.incremental_run(log, art, pr, fp, old, head, "r1", prev_incomplete=True).pages.count() == 2


def test_retries(spark):
    rows = [("a", 1, 503, None), ("a", 2, 503, None), ("a", 3, 200, None), ("a", 4, 200, None), ("b", 1, 429, 90), ("b", 2, 429, 5), ("c", 1, 404, None), ("d", 1, None, None), ("d", 2, 500, None), ("d", 3, 500, None), ("d", 4, 500, None), ("d", 5, 200, None)]
    df = spark.createDataFrame([(*r, False) for r in rows], "url string, attempt int, status_code int, retry_after int, reused boolean")
    got = {}
    for r in crawl.retries(df).orderBy("url", "attempt").collect():
        got.setdefault(r["url"], []).append((r["next_step"], r["delay"]))
    assert got == {"a": [("RETRY", 2), ("RETRY", 4), ("DONE", 0)], "b": [("RETRY", 60), ("GIVE_UP", 0)], "c": [("DONE", 0)], "d": [("RETRY", 2), ("RETRY", 4), ("RETRY", 8), ("GIVE_UP", 0)]}


def test_projection_never_regresses(spark):
    runs = spark.createDataFrame([("p", "old", "2026-01-01"), ("p", "new", "2026-02-01")], "portal_id string, run_id string, started_at string")
    one = lambda v, c: spark.createDataFrame([("p", v)], f"portal_id string, {c} string")
    assert tuple(crawl.projected(one("old", "baseline"), one("new", "head"), runs).select("head", "projected").first()) == ("new", False)
    assert tuple(crawl.projected(one("new", "baseline"), one("old", "head"), runs).select("head", "projected").first()) == ("new", True)
    assert tuple(crawl.projected(one("new", "baseline"), one(None, "head"), runs).select("head", "projected").first()) == ("new", True)


def test_migrations():
    assert crawl.migrations(1, {1: "a", 3: "c", 2: "b"}, 3) == ["b", "c"]
    with pytest.raises(ValueError):
        crawl.migrations(4, {}, 3)


def simulator(changes):
    """Five pages of four items; changes: (page, visit) -> items."""
    rows = [(p, 1, [f"i{p}{k}" for k in range(4)]) for p in range(1, 6)] + [(p, v, items) for (p, v), items in changes.items()]
    return pd.DataFrame(rows, columns=["page", "visit_no", "urls"])


@pytest.mark.parametrize(("profile", "requests"), [("NAIVE", 5), ("PRECISION", 10), ("ROBUST", 10), ("ROBUST_HEAD_VERIFIED", 11)])
def test_policies_on_a_stable_archive(profile, requests):
    got = crawl.visit_schedule(simulator({}), profile, 5)
    assert len(got) == requests and not got["changed"].any()


def test_policies_on_a_changing_archive(spark):
    changes = {(2, 2): ["i20", "i21", "i22", "new"]}
    naive, robust = (crawl.visit_schedule(simulator(changes), p, 5) for p in ("NAIVE", "ROBUST"))
    assert "new" not in set(sum(naive["urls"], [])) and "new" in set(sum(robust["urls"], []))
    assert len(robust) > 10 and list(robust[robust["changed"]]["page"]) == [2]
    log = spark.createDataFrame([(int(r.request_no), int(r.page), ",".join(r.urls)) for r in robust.itertuples()], "n long, page int, s string")
    last = observations.stability(log, "page", ["n"], "s").groupBy("page").agg(F.max_by("stable_count", "n").alias("c")).collect()
    assert all(r["c"] >= 2 for r in last)


def test_head_verification_finds_a_late_insertion():
    got = crawl.visit_schedule(simulator({(1, 3): ["late", "i10", "i11", "i12"], (2, 3): ["i13", "i20", "i21", "i22"]}), "ROBUST_HEAD_VERIFIED", 5)
    phases = got.groupby("phase").size().to_dict()
    assert phases["INITIAL"] == 10 and phases["HEAD_VERIFICATION"] >= 1 and phases["RECONCILIATION"] >= 2
    assert "late" in set(sum(got["urls"], [])) and not got.iloc[-1]["changed"]


def test_portals_have_schedules_of_their_own(spark):
    logs = {p: simulator({(2, 2): [f"new{p}"]} if p % 2 else {}) for p in range(4)}
    rows = [(p, int(r.page), int(r.visit_no), list(r.urls)) for p, log in logs.items() for r in log.itertuples(index=False)]
    got = crawl.visit_schedules(spark.createDataFrame(rows, "portal_id int, page int, visit_no int, urls array<string>"), "ROBUST", 5).toPandas()
    for p, log in logs.items():
        mine = got[got["portal_id"] == p].sort_values("request_no")
        want = crawl.visit_schedule(log, "ROBUST", 5)
        assert mine[["phase", "page", "visit_no"]].values.tolist() == want[["phase", "page", "visit_no"]].values.tolist()


def test_files_are_validated_on_executors(spark, tmp_path):
    pages = spark.createDataFrame([(f"https://x.y/{i}", bytearray(b"<p>" * (i + 1)), 200) for i in range(6)], "uri string, payload binary, status_code int")
    warc.write(pages.coalesce(1), str(tmp_path / "w"), compress=False)
    whole = next((tmp_path / "w").glob("*.warc"))
    (tmp_path / "w" / "cut.warc").write_bytes(whole.read_bytes()[:-30])
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    got = {r["file"].rsplit("/", 1)[1]: r for r in warc.validations(spark, str(tmp_path / "w")).collect()}
    assert got[whole.name]["valid"] and (got[whole.name]["total"], got[whole.name]["html"]) == (6, 6) and got[whole.name]["size"] == whole.stat().st_size
    assert got["cut.warc"]["error"].startswith("PARSE_ERROR") and got["empty.warc"]["error"] == "EMPTY_FILE"
    (tmp_path / "w" / "cut.warc").unlink()
    (tmp_path / "w" / "empty.warc").unlink()
    assert spark.read.format("warc").option("limit", "2").load(str(tmp_path / "w")).count() == 2


def test_versions_are_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "v")
    assert snapshots.current(spark, path) == 0
    assert snapshots.publish(spark, {"a": spark.range(3), "b": spark.range(1)}, path, after=0) == 1
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        snapshots.publish(spark, {"a": spark.range(9), "b": broken}, path)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, {"a": spark.range(9)}, path, after=0)
    assert snapshots.current(spark, path) == 1 and snapshots.read(spark, path, "a").count() == 3
    assert len([p for p in (tmp_path / "v").iterdir() if p.name.startswith("version-")]) == 1
    assert snapshots.publish(spark, {"a": spark.range(5)}, path) == 2
    assert (snapshots.read(spark, path, "a").count(), snapshots.read(spark, path, "a", 1).count()) == (5, 3)


def test_a_marker_that_exists_is_a_conflict(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    snapshots.publish(spark, {"a": spark.range(3)}, path)
    monkeypatch.setattr(snapshots, "current", lambda *_: 0)  # as seen by a writer that began before
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, {"a": spark.range(9)}, path)
    monkeypatch.undo()
    assert snapshots.read(spark, path, "a").count() == 3


def test_a_marker_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    snapshots.publish(spark, {"a": spark.range(3)}, path)
    put, renamed = snapshots._put, snapshots._renamed

    def torn(store, place, name):
        store.create(place, False).close()  # the file is there, its content is not
        assert snapshots.current(spark, path) == 1 and snapshots.read(spark, path, "a").count() == 3  # a reader in between
        raise OSError("disk full")

    monkeypatch.setattr(snapshots, "_put", torn)
    with pytest.raises(OSError, match="disk full"):
        snapshots.publish(spark, {"a": spark.range(9)}, path)
    assert snapshots.read(spark, path, "a").count() == 3 and snapshots.current(spark, path) == 1
    monkeypatch.setattr(snapshots, "_put", put)

    def unanswered(*args):
        renamed(*args)
        raise OSError("connection lost")

    monkeypatch.setattr(snapshots, "_renamed", unanswered)
    with pytest.raises(OSError, match="connection lost"):
        snapshots.publish(spark, {"a": spark.range(9)}, path)
    monkeypatch.undo()
    assert snapshots.current(spark, path) == 2 and snapshots.read(spark, path, "a").count() == 9  # it had been published
    assert snapshots.publish(spark, {"a": spark.range(4)}, path) == 3
    assert len([p for p in (tmp_path / "v").iterdir() if p.name.startswith("version-")]) == 3


def test_an_error_that_is_no_conflict_is_said_to_be_none(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    monkeypatch.setattr(snapshots, "_put", lambda *_: (_ for _ in ()).throw(PermissionError("no")))
    with pytest.raises(PermissionError):
        snapshots.publish(spark, {"a": spark.range(9)}, path)
    assert snapshots.current(spark, path) == 0
