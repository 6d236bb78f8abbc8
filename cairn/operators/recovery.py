"""Catalogue against packages on disk: reconciliation, retention, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .integrity import first_reason
from .ledger import SUCCESSFUL

KEEP_STAGING = 5


def classes(catalog: DataFrame, packages: DataFrame) -> DataFrame:
    """portal_id, run_id and state of catalogue rows and packages, by one full outer join.

    catalog: portal_id, run_id, status. packages: portal_id, run_id, is_valid, has_state, status, n_anomalies.
    VALID, MISSING_PACKAGE, CORRUPTED, ORPHAN (a sound package of a successful run without anomalies that the catalogue
    lacks) or AMBIGUOUS (any other package that it lacks)."""
    c = catalog.select("portal_id", "run_id", F.lit(True).alias("_c"))
    p = packages.select("portal_id", "run_id", "is_valid", "has_state", "n_anomalies", F.col("status").alias("_s"), F.lit(True).alias("_p"))
    sound = F.col("is_valid") & F.col("has_state") & F.col("_s").isin(*SUCCESSFUL) & (F.coalesce("n_anomalies", F.lit(0)) == 0)
    state = F.when(F.col("_p").isNull(), "MISSING_PACKAGE").when(F.col("_c") & F.col("is_valid"), "VALID").when(F.col("_c"), "CORRUPTED").when(F.coalesce(sound, F.lit(False)), "ORPHAN").otherwise("AMBIGUOUS")
    return c.join(p, ["portal_id", "run_id"], "full_outer").select("portal_id", "run_id", state.alias("state"))


def actions(states: DataFrame) -> DataFrame:
    """Per portal: counts and what to do: adopt a single orphan, leave several to a person, else nothing."""
    n = lambda s: F.count_if(F.col("state") == s)
    a = states.groupBy("portal_id").agg(*(n(s).alias(f"n_{s.lower()}") for s in ("VALID", "MISSING_PACKAGE", "CORRUPTED", "ORPHAN", "AMBIGUOUS")))
    return a.withColumn("action", F.when((F.col("n_orphan") > 1) | (F.col("n_ambiguous") > 0), "MANUAL_REVIEW").when(F.col("n_orphan") == 1, "ADOPT_ORPHAN").otherwise("NONE"))


def fallback_heads(states: DataFrame, runs: DataFrame) -> DataFrame:
    """Per portal whose head is corrupted: the latest valid run before it with status CONVERGED or COMPLETED, if any. runs: portal_id, run_id, seq, status; the head is the largest seq."""
    j = runs.join(states, ["portal_id", "run_id"])
    w = Window.partitionBy("portal_id")
    j = j.withColumn("_head", F.max_by("state", "seq").over(w))
    good = (F.col("state") == "VALID") & F.col("status").isin("CONVERGED", "COMPLETED")
    return j.filter("_head IN ('CORRUPTED', 'MISSING_PACKAGE')").groupBy("portal_id").agg(F.max_by("run_id", "seq").alias("head"), F.max_by(F.when(good, F.col("run_id")), F.when(good, F.col("seq"))).alias("fallback"))


def retention(folders: DataFrame, heads: DataFrame, keep: int = KEEP_STAGING) -> DataFrame:
    """folders (portal_id, name, is_package, has_anomaly, bytes) with keep and reason. Packages, the head's folder, and folders with anomalies stay; of the others the newest `keep` by name. The head's folder holds its id in its name, or its run_dir (where heads has one) ends with the folder's name."""
    run_dir = F.col("run_dir") if "run_dir" in heads.columns else F.lit(None).cast("string").alias("run_dir")
    j = folders.join(heads.select("portal_id", "head_run", run_dir), "portal_id", "left")
    head = F.coalesce(F.contains(F.col("name"), F.col("head_run")), F.lit(False)) | F.coalesce((F.col("name") != "") & F.endswith(F.regexp_replace("run_dir", "/+$", ""), F.col("name")), F.lit(False))
    reason = F.when(F.col("is_package"), "PACKAGE").when(head, "HEAD").when(F.col("has_anomaly"), "ANOMALY")
    j = j.withColumn("reason", reason)
    n = F.row_number().over(Window.partitionBy("portal_id", F.col("reason").isNull()).orderBy(F.desc("name")))
    j = j.withColumn("_n", n).withColumn("reason", F.coalesce("reason", F.when(F.col("_n") <= keep, F.lit("RECENT"))))
    return j.select("portal_id", "name", F.col("reason").isNotNull().alias("kept"), F.coalesce("reason", F.lit("REMOVABLE")).alias("reason"), "bytes")


def reclaimable(plan: DataFrame) -> DataFrame:
    return plan.groupBy("portal_id").agg(F.count_if(~F.col("kept")).alias("n_removable"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("bytes"))), F.lit(0)).alias("bytes"))


def baselines(portals: DataFrame) -> DataFrame:
    """portal_id and the first fault of each portal's baseline (null: usable), over one row of facts per portal."""
    checks = [
        (F.col("head_run").isNotNull(), "NO_SUCCESSFUL_RUN"),
        (F.col("run_dir_exists"), "RUN_DIR_MISSING"),
        (F.col("state_exists"), "STATE_MISSING"),
        (F.col("state_portal") == F.col("portal_id"), "PORTAL_MISMATCH"),
        (F.col("package_valid"), "PACKAGE_INVALID"),
    ]
    return portals.select("portal_id", first_reason(checks).alias("reason"))
