"""The deposit sink: whole deposits or none, receipts written once, failed jobs that leave nothing."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.sources import deposits


def files(spark, keys=((1, "r1"), (1, "r2"), (2, "r1")), n=4, suffix=""):
    rows = [(str(p), r, f"d/{i}.txt" if i % 2 else f"{i}.txt", f"{p}{r}{i}{suffix}".encode()) for p, r in keys for i in range(n)]
    return spark.createDataFrame(rows, "portal_id string, run_id string, filename string, payload binary").repartition(3)


def outcomes(df):
    return {(r["portal_id"], r["run_id"]): r["outcome"] for r in df.collect()}


def left(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith((".", "_")) and "_jobs" not in p.parts)


def test_a_rerun_returns_the_receipt(spark, tmp_path):
    path = str(tmp_path / "repo")
    first = outcomes(deposits.deposit(files(spark), path))
    assert set(first.values()) == {"PUBLISHED"} and len(first) == 3
    receipt = {(r["portal_id"], r["run_id"]): r for r in deposits.receipts(spark, path).collect()}["1", "r2"]
    assert receipt["n_files"] == 4 and [f["filename"] for f in receipt["files"]] == ["0.txt", "2.txt", "d/1.txt", "d/3.txt"]
    manifest = "".join(f"{hashlib.sha256(f'1r2{i}'.encode()).hexdigest()}  {n}\n" for i, n in ((0, "0.txt"), (2, "2.txt"), (1, "d/1.txt"), (3, "d/3.txt")))
    assert receipt["package_fingerprint"] == hashlib.sha256(manifest.encode()).hexdigest()
    place = Path(path) / "1" / "r2" / "receipt.json"
    before = (place.stat().st_mtime_ns, left(path))
    assert set(outcomes(deposits.deposit(files(spark), path)).values()) == {"RECEIPT_RETURNED"}
    changed = outcomes(deposits.deposit(files(spark, ((1, "r2"), (3, "r")), suffix="!"), path))
    assert changed == {("1", "r2"): "CHANGED_PACKAGE", ("3", "r"): "PUBLISHED"}
    assert place.stat().st_mtime_ns == before[0] and (Path(path) / "1" / "r2" / "0.txt").read_bytes() == b"1r20"
    assert not (Path(path) / "_staging").exists() or not any((Path(path) / "_staging").iterdir())


def test_a_failing_task_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "repo")
    broken = files(spark).withColumn("payload", F.when((F.col("portal_id") == "2") & (F.col("filename") == "d/3.txt"), F.raise_error(F.lit("disk gone")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="disk gone"):
        deposits.deposit(broken, path)
    assert left(path) == [] and (not (tmp_path / "repo" / "_staging").exists() or not any((tmp_path / "repo" / "_staging").iterdir()))
    assert set(outcomes(deposits.deposit(files(spark), path)).values()) == {"PUBLISHED"}


def test_a_commit_that_breaks_off_is_completed_by_a_rerun(spark, tmp_path):
    path = str(tmp_path / "repo")
    writer = deposits._Writer({"path": path})
    rows = sorted(files(spark).withColumn("sha256", F.lit(None).cast("string")).collect(), key=lambda r: r[:3])
    message = writer.write(iter(rows))
    system, root = deposits.store(path)
    writer._published(system, root, message.deposits[0])  # then the driver dies
    assert len({p.split("/")[0] + p.split("/")[1] for p in left(path) if not p.startswith("_staging")}) == 1
    got = outcomes(deposits.deposit(files(spark), path))
    assert sorted(got.values()) == ["PUBLISHED", "PUBLISHED", "RECEIPT_RETURNED"]


def test_quota_digests_and_names(spark, tmp_path):
    path = str(tmp_path / "repo")
    some = files(spark, ((1, "many"),), 7).unionByName(files(spark, ((2, "ok"),), 3))
    assert outcomes(deposits.deposit(some, path, max_files=5)) == {("1", "many"): "OVER_QUOTA", ("2", "ok"): "PUBLISHED"}
    assert outcomes(deposits.deposit(files(spark, ((3, "big"),)), path, max_total_bytes=10)) == {("3", "big"): "OVER_QUOTA"}
    wrong = files(spark, ((4, "x"), (5, "y"))).withColumn("sha256", F.when((F.col("portal_id") == "4") & (F.col("filename") == "0.txt"), F.lit("00")).otherwise(F.upper(F.sha2("payload", 256))))
    assert outcomes(deposits.deposit(wrong, path)) == {("4", "x"): "DIGEST_MISMATCH", ("5", "y"): "PUBLISHED"}
    names = spark.createDataFrame([("6", "a", "../x", b"1"), ("6", "b", "x", b"1"), ("6", "b", "x", b"2"), ("6", "c", None, b""), ("6", "d/../e", "ok.txt", None)], "portal_id string, run_id string, filename string, payload binary")
    assert outcomes(deposits.deposit(names, path)) == {("6", "a"): "UNSAFE_NAME", ("6", "b"): "REPEATED_NAME", ("6", "c"): "UNSAFE_NAME", ("6", "d/../e"): "PUBLISHED"}
    assert {(r["portal_id"], r["run_id"]) for r in deposits.receipts(spark, path).collect()} == {("2", "ok"), ("5", "y"), ("6", "d/../e")}
    assert deposits.deposit(files(spark).limit(0), path).collect() == []


def test_rows_of_a_deposit_in_several_tasks_are_refused(spark, tmp_path):
    spark.dataSource.register(deposits.DepositSource)
    rows = files(spark, ((1, "r"),)).withColumn("sha256", F.lit(None).cast("string")).repartition(4)
    with pytest.raises(Exception, match="spread over tasks"):
        rows.write.format("deposit").mode("append").save(str(tmp_path / "repo"))
    assert left(str(tmp_path / "repo")) == []


def test_the_driver_gets_a_name_for_each_task(spark, tmp_path):
    import pickle

    keys = [(p, f"r{i:03}") for p in (1, 2) for i in range(100)]
    writer = deposits._Writer({"path": str(tmp_path / "repo"), "job": "j"})
    rows = sorted(files(spark, keys, 1).withColumn("sha256", F.lit(None).cast("string")).collect(), key=lambda r: r[:3])
    messages = [writer.write(iter(rows[i::2])) for i in (0, 1)] + [writer.write(iter(()))]
    assert max(len(pickle.dumps(m)) for m in messages) < 1000
    writer.commit(messages)
    assert len(left(str(tmp_path / "repo"))) == 400 and len((tmp_path / "repo" / "_jobs" / "j.json").read_text().splitlines()) == 200
    with pytest.raises(ValueError, match="order"):
        writer.write(iter(rows[::-1]))


def test_receipts_are_found_without_the_driver_listing_files(spark, tmp_path):
    path = str(tmp_path / "repo")
    keys = [("", "bare"), ("_own", "r"), ("a/b", "r 1"), ("a/b", "ü%2F"), ("p", "")]
    rows = spark.createDataFrame([(p, r, n, b"x") for p, r in keys for n in ("f.txt", "deep/er/g.txt", "deep/receipt.json")[: 3 if p and r else 2]], "portal_id string, run_id string, filename string, payload binary")
    assert set(outcomes(deposits.deposit(rows, path)).values()) == {"PUBLISHED"}
    (tmp_path / "repo" / "p2" / "unfinished").mkdir(parents=True)
    found = deposits.receipts(spark, path)
    assert found.inputFiles() == [] and [t for _, t in found.dtypes] == [t for _, t in spark.createDataFrame([], deposits.RECEIPT).dtypes]
    assert sorted((r["portal_id"], r["run_id"], r["status"], len(r["files"])) for r in found.collect()) == [(p, r, "PUBLISHED", 3 if p and r else 2) for p, r in keys]


def test_a_task_keeps_no_files_that_will_not_be_published(spark, tmp_path):
    path = str(tmp_path / "repo")
    assert set(outcomes(deposits.deposit(files(spark, ((1, "r1"), (1, "r2"))), path)).values()) == {"PUBLISHED"}
    again = files(spark, ((1, "r1"),)).unionByName(files(spark, ((1, "r2"), (2, "new")), suffix="!")).unionByName(files(spark, ((3, "many"),), 7))
    faulty = spark.createDataFrame([("4", "a", "1.txt", b"1"), ("4", "a", "../x", b"2"), (None, "b", "1.txt", b"1"), (None, "b", "../x", b"1"), ("1" * 300, "c", "../x", b"1")], again.schema)
    rows = again.unionByName(faulty).withColumn("sha256", F.lit(None).cast("string")).orderBy("portal_id", "run_id", "filename").collect()
    writer = deposits._Writer({"path": path, "job": "j", "maxfiles": "5"})
    message = writer.write(iter(rows))
    staged = {d.run_id: Path(d.folder) for d in message.deposits}
    assert [r for r, folder in staged.items() if folder.exists()] == ["new"] and len(staged) == 7
    before = left(path)
    writer.commit([message])
    got = outcomes(spark.read.schema(deposits.OUTCOME).json(f"{path}/_jobs/j.json"))
    assert got == {(None, "b"): "UNSAFE_NAME", ("1", "r1"): "RECEIPT_RETURNED", ("1", "r2"): "CHANGED_PACKAGE", ("2", "new"): "PUBLISHED", ("3", "many"): "OVER_QUOTA", ("4", "a"): "UNSAFE_NAME", ("1" * 300, "c"): "UNSAFE_NAME"}
    assert len([f for f in left(path) if f.startswith("2/")]) == 5 and [f for f in before if f.startswith("1/")] == [f for f in left(path) if f.startswith("1/")]


def test_a_deposit_leaves_no_shuffle_files(spark, tmp_path):
    import re
    import time

    def shuffled():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    rows, before, key = files(spark), shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    out = deposits.deposit(rows, str(tmp_path / "repo"))
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(key) == "false"
    assert len(out.collect()) == 3
