"""Integrity of packages, manifests, keys and deposits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contained_path, manifest_line
from .digests import streamed

# Limits of a deposit.
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 100, 50 * 1024**3, 50 * 1024**3


def verify(manifest: DataFrame, files: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """State of every path of either side (keys, sha256): VERIFIED, MISSING, MISMATCH or UNEXPECTED; one full outer join."""
    m = manifest.select(*keys, F.lower("sha256").alias("_m"))
    f = files.select(*keys, F.lower("sha256").alias("_f"))
    state = F.when(F.col("_f").isNull(), "MISSING").when(F.col("_m").isNull(), "UNEXPECTED").when(F.col("_m") == F.col("_f"), "VERIFIED").otherwise("MISMATCH")
    return m.join(f, list(keys), "full_outer").select(*keys, state.alias("state"))


def rollup(states: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return states.groupBy(*group).agg(*(n(s).alias(f"n_{s.lower()}") for s in ("VERIFIED", "MISSING", "MISMATCH", "UNEXPECTED")), F.coalesce(F.bool_and(F.col("state") == "VERIFIED"), F.lit(True)).alias("is_valid"))


def error_lists(states: DataFrame, faults: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per package all errors in one text: faults of its metadata (group, error), then missing, changed and unexpected files, each kind by name."""
    kinds = {"MISSING": 1, "MISMATCH": 2, "UNEXPECTED": 3}
    rank = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    files = states.filter(F.col("state").isin(*kinds)).select(*group, F.try_element_at(rank, F.col("state")).alias("_k"), F.col("path").alias("error"))
    both = faults.select(*group, F.lit(0).alias("_k"), "error").unionByName(files)
    return both.groupBy(*group).agg(F.count("*").alias("n_errors"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "error"))), lambda r: r["error"]), "; ").alias("errors"))


def parsed_manifest(lines: DataFrame) -> DataFrame:
    """sha256, path, line_no and error of manifest lines (line_no, value); blank lines and comments go. Paths that leave the package are errors."""
    p = lines.select("line_no", manifest_line(F.col("value")).alias("m")).select("line_no", "m.*")
    safe = contained_path(F.col("path"))
    p = p.withColumn("error", F.coalesce("error", F.when(F.col("path").isNotNull() & safe.isNull(), F.lit("UNSAFE_PATH")))).withColumn("path", F.coalesce(safe, "path"))
    return p.filter(F.col("error").isNotNull() | F.col("path").isNotNull())


def manifest_text(files: DataFrame) -> DataFrame:
    """One row: the manifest of files (path, sha256) as text, sorted by path. A package's file list is bounded by its own size."""
    row = F.struct(F.replace("path", F.lit("\\"), F.lit("/")).alias("p"), "sha256")
    return files.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat(r["sha256"], F.lit("  "), r["p"])), "\n"), F.lit("\n")).alias("text"))


def manifest_digest(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """package_fingerprint and length (characters) of the manifest of files (keys, path, sha256), per package: what `manifest_text` would hash to, streamed line by line."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    lines = files.select(*keys, path.alias("_path"), F.concat("sha256", F.lit("  "), path).alias("_line"))
    d = streamed(lines, keys, ["_path", "_line"], "_line", "package_fingerprint", tail="\n")
    return d.select(*keys, "package_fingerprint", F.col("chars_package_fingerprint").alias("length"))


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """Number of child rows whose key, not null, has no parent: one anti-join."""
    known = child.filter(" AND ".join(f"{c} IS NOT NULL" for c, _ in keys))
    on = [known[c] == parent[p] for c, p in keys]
    return known.join(parent, on, "left_anti").agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("constraint_name"), "n_violations")


def pointer_audit(portals: DataFrame, runs: DataFrame, successful: Sequence[str]) -> DataFrame:
    """Portals (portal_id, pointer) whose pointer names no successful run of theirs (portal_id, run_id, status)."""
    good = runs.filter(F.col("status").isin(*successful)).select("portal_id", F.col("run_id").alias("pointer"))
    return portals.filter("pointer IS NOT NULL").join(good, ["portal_id", "pointer"], "left_anti")


def verify_deposit(artifacts: DataFrame, listed: DataFrame) -> DataFrame:
    """filename and verified: the remote MD5 equals the local one in either case, and the SHA-256 that of the list where it is listed."""
    j = artifacts.join(listed.select("filename", F.lower("sha256").alias("_l")), "filename", "left")
    same = F.coalesce(F.lower("remote_md5") == F.lower("local_md5"), F.lit(False))
    return j.select("filename", (same & (F.col("_l").isNull() | (F.col("_l") == F.lower("local_sha256")))).alias("verified"))


def quota(files: DataFrame, size: str, group: Sequence[str] = ()) -> DataFrame:
    q = files.groupBy(*group).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.coalesce(F.max(size), F.lit(0)).alias("largest"))
    return q.withColumn("within_quota", (F.col("n_files") <= MAX_FILES) & (F.col("largest") <= MAX_FILE_BYTES) & (F.col("total_bytes") <= MAX_TOTAL_BYTES))


def transitions(log: DataFrame, key: str, order: Sequence[str], status: str, allowed: DataFrame) -> DataFrame:
    """Each status change of a log with whether it is allowed; `allowed` is a small table (src, dst). A first row starts from nothing and is allowed, and so is staying."""
    from pyspark.sql import Window

    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    j = log.withColumn("previous", before)
    ok = allowed.select(F.col("src").alias("previous"), F.col("dst").alias(status), F.lit(True).alias("_ok"))
    j = j.join(F.broadcast(ok), ["previous", status], "left")
    return j.withColumn("is_allowed", F.col("previous").isNull() | (F.col("previous") == F.col(status)) | F.coalesce("_ok", F.lit(False))).drop("_ok")


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first check that fails, or null."""
    out = F.when(~F.coalesce(checks[0][0], F.lit(False)), checks[0][1])
    for ok, name in checks[1:]:
        out = out.when(~F.coalesce(ok, F.lit(False)), name)
    return out
