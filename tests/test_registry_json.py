"""Registry documents of several versions in one folder."""

import json

from cairn.sources import registry_json


def test_three_versions_in_one_folder(spark, tmp_path):
    docs = {
        "old.json": {"receipts": {"p:r0": {"state": "published", "file_list": "a,b", "fingerprint": "f0"}, "p:r:x": {"state": "failed", "file_list": "", "fingerprint": None}}},
        "one.json": {"schema_version": "1", "updated_at": "t1", "receipts": {"p:r1": {"portal_id": "p", "run_id": "r1", "state": "draft_created", "file_list": "a", "fingerprint": "f1"}}},
        "two.json": {"schema_version": "2", "receipts": {"q:r": {"status": "VERIFIED", "files": ["x", "y", "z"], "fingerprint": "f2", "state": "ignored"}}},
        "three.json": {"schema_version": "3", "odd": 1, "receipts": {"q:s": {"status": "PUBLISHED", "files": [], "package_fingerprint": "f3", "n_files": 7, "fingerprint": "no"}}},
        "new.json": {"schema_version": "4", "receipts": {"z:z": {"status": "X"}}},
        "bad.json": {"schema_version": "new", "receipts": {}},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    (tmp_path / "torn.json").write_text('{"schema_version": "2", "receipts": {')
    (tmp_path / "list.json").write_text("[1]")
    read = registry_json.documents(spark, str(tmp_path))
    rows = {(r["portal_id"], r["run_id"]): (r["version"], r["status"], r["package_fingerprint"], r["n_files"]) for r in registry_json.receipts(read).collect()}
    assert rows == {("p", "r0"): (1, "PUBLISHED", "f0", 2), ("p", "r:x"): (1, "FAILED", None, 0), ("p", "r1"): (1, "DRAFT_CREATED", "f1", 1), ("q", "r"): (2, "VERIFIED", "f2", 3), ("q", "s"): (3, "PUBLISHED", "f3", 7)}
    assert {r["file"].rsplit("/", 1)[1]: r["error"] for r in registry_json.refused(read).collect()} == {"new.json": "NEWER_VERSION", "bad.json": "BAD_VERSION", "torn.json": "NOT_JSON", "list.json": "NOT_JSON"}


def test_registries_are_written_in_the_present_version(spark, tmp_path):
    rows = spark.createDataFrame([("p", "r1", "PUBLISHED", "f", 1, ["a"], "t2"), ("p", "r1", "FAILED", "f", 1, ["a"], "t1"), ("p", "r2", "FAILED", None, 0, [], None), ("q", "r1", "VERIFIED", "g", 0, None, "t")], registry_json.RECEIPT)
    docs = {r["portal_id"]: r["document"] for r in registry_json.registries_of(rows).collect()}
    p = json.loads(docs["p"])
    assert p["schema_version"] == "3" and p["updated_at"] == "t2" and list(p["receipts"]) == ["p:r1", "p:r2"] and p["receipts"]["p:r1"]["status"] == "PUBLISHED"
    (tmp_path / "all.txt").write_text("\n".join(docs.values()))
    back = registry_json.receipts(registry_json.documents(spark, str(tmp_path), lines=True))
    assert sorted((r["portal_id"], r["run_id"], r["status"], r["n_files"]) for r in back.collect()) == [("p", "r1", "PUBLISHED", 1), ("p", "r2", "FAILED", 0), ("q", "r1", "VERIFIED", 0)]


def test_upgrades_are_one_projection(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    plan = registry_json.receipts(registry_json.documents(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan and "Join" not in plan
