"""Sealed packages: a folder of Parquet tables with a manifest of digests, written once and verified as a whole.

All paths are read and written by Spark, so they may lie in any store that it reaches."""

from __future__ import annotations

import hashlib
import json
import platform
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digests import streamed
from ..operators.integrity import parsed_manifest, rollup, verify

MANIFEST, ENVIRONMENT = "_manifest", "_environment"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def environment(spark: SparkSession, extra: Mapping[str, str] | None = None) -> dict[str, str]:
    return {"spark": spark.version, "python": platform.python_version(), "system": platform.system()} | dict(extra or {})


def files(spark: SparkSession, path: str) -> DataFrame:
    """path below the package, sha256 and length of its files; names that begin with _ are the package's own or the writer's."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = re.sub("^[a-z0-9]+:/*", "/", path.rstrip("/"))
    below = F.regexp_extract("path", f"^.*?{re.escape(root)}/(.*)$", 1)
    rows = found.select(below.alias("path"), F.sha2("content", 256).alias("sha256"), "length")
    return rows.filter(~F.exists(F.split("path", "/"), lambda x: x.startswith("_") | x.startswith(".")))


def write(tables: Mapping[str, DataFrame], path: str, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Write a package and return its verification; a package that exists is never overwritten. The manifest comes last, so a package without one is unfinished."""
    spark = next(iter(tables.values())).sparkSession
    if _exists(spark, path):
        raise FileExistsError(path)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    facts = json.dumps(environment(spark, extra), sort_keys=True)
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{path}/{ENVIRONMENT}")
    lines = files(spark, path).orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value"))
    lines.coalesce(1).write.text(f"{path}/{MANIFEST}")
    return verification(spark, path)


def verification(spark: SparkSession, path: str) -> DataFrame:
    """State of each file of a package against its manifest; a faulty line of the manifest counts as MISMATCH of that line."""
    lines = spark.read.text(f"{path}/{MANIFEST}").withColumn("line_no", F.monotonically_increasing_id())
    parsed = parsed_manifest(lines)
    faults = parsed.filter("error IS NOT NULL").select(F.coalesce("path", F.concat(F.lit("line "), "line_no")).alias("path"), F.lit("MISMATCH").alias("state"))
    return verify(parsed.filter("error IS NULL").select("path", "sha256"), files(spark, path)).unionByName(faults)


def is_valid(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/{MANIFEST}") and bool(rollup(verification(spark, path)).first()["is_valid"])


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of the manifest's lines in their order of path, streamed line by line."""
    lines = spark.read.text(f"{path}/{MANIFEST}").select(F.substring_index("value", "  ", -1).alias("p"), "value")
    found = streamed(lines, [], ["p", "value"], "value").first()
    return found["digest"] if found else hashlib.sha256(b"").hexdigest()


def backup(spark: SparkSession, tables: Mapping[str, str], to: str) -> None:
    """Copy tables (name -> path) to a folder that must not exist."""
    if _exists(spark, to):
        raise FileExistsError(to)
    for name, path in tables.items():
        spark.read.parquet(path).write.parquet(f"{to}/{name}")


def restore(spark: SparkSession, source: str, tables: Mapping[str, str]) -> None:
    """Copy a backup back; a table that exists is never overwritten."""
    taken = [p for p in tables.values() if _exists(spark, p)]
    if taken:
        raise FileExistsError(", ".join(taken))
    for name, path in tables.items():
        spark.read.parquet(f"{source}/{name}").write.parquet(path)
