"""Streamed digests equal those of gathered lists, and gather none."""

import hashlib

from pyspark.sql import functions as F

from cairn.functions import fingerprints
from cairn.operators import digests, integrity

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_equal_to_gathered_lists(spark):
    rows = [("a", 3, "x"), ("a", 1, "ü"), ("a", 2, ""), ("a", 5, "x"), ("a", 4, None), ("b", 1, None), (None, 1, "n"), (None, 2, "m")]
    df = spark.createDataFrame(rows, "host string, pos long, url string").repartition(3)
    got = {r["host"]: (r["ordered_fingerprint"], r["set_fingerprint"], r["n_urls"], r["n_distinct"]) for r in digests.fingerprints(df, "host", "url", "pos").collect()}
    assert got == {"a": (sha("ü\nx\nx"), sha("x\nü"), 3, 2), "b": (sha(""), sha(""), 0, 0), None: (sha("n\nm"), sha("m\nn"), 2, 2)}
    want = df.groupBy("host").agg(fingerprints.ordered(F.col("url"), F.col("pos")).alias("o"), fingerprints.as_set(F.col("url")).alias("s"))
    assert {r["host"]: (r["o"], r["s"]) for r in want.collect()} == {k: v[:2] for k, v in got.items()}
    assert digests.fingerprints(df.limit(0), "host", "url", "pos").collect() == []


def test_a_host_of_a_million_urls(spark):
    rows = spark.range(1_000_000).select(F.lit("h").alias("host"), (F.col("id") * 7919 % 1_000_003).alias("pos"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    found = digests.streamed(rows, ["host"], ["pos"], "url", "d")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan and plan.count("Exchange") == 1
    order = sorted(range(1_000_000), key=lambda i: i * 7919 % 1_000_003)
    r = found.first()
    assert r["d"] == sha("\n".join(f"http://h/{i}" for i in order)) and r["n_d"] == 1_000_000


def test_manifests(spark):
    files = spark.createDataFrame([("p", "b\\c", "2"), ("p", "a", "1"), ("q", "z", "9")], "pkg string, path string, sha256 string")
    got = {r["pkg"]: (r["package_fingerprint"], r["length"]) for r in integrity.manifest_digest(files, ["pkg"]).collect()}
    assert got == {"p": (sha("1  a\n2  b/c\n"), 12), "q": (sha("9  z\n"), 5)}
    one = files.filter("pkg = 'p'").drop("pkg")
    text = integrity.manifest_text(one).first()["text"]
    assert integrity.manifest_digest(one).first()["package_fingerprint"] == sha(text)
