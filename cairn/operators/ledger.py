"""Merge of observations into keyed tables, and the run catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Run states in which a run moves the portal's pointer, and those that wait for recovery.
SUCCESSFUL = ("CONVERGED", "COMPLETED", "PILOT_SCOPE_CONVERGED", "MULTIPAGE_PILOT_COMPLETE")
INTERRUPTIBLE = ("RUNNING", "FINALIZING")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], policy: Mapping[str, str], order: str) -> DataFrame:
    """base with the rows of delta merged in. policy of each other column: `replace` (the last value), `coalesce` (the last
    that is not null), `keep` (the first) or `count` (the base's number plus the rows merged). `order` sorts the rows of
    delta; one shuffle by key, no join."""
    cols = list(policy)
    rows = base.select(*keys, *cols).withColumns({"_new": F.lit(0), "_at": F.lit(None).cast(delta.schema[order].dataType)})
    more = delta.select(*keys, *(F.col(c) if c in delta.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in cols), F.lit(1).alias("_new"), F.col(order).alias("_at"))
    at = F.struct("_new", "_at")
    make = {
        "replace": lambda c: F.max_by(F.struct(F.col(c)), at)[c],
        "coalesce": lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c))), F.when(F.col(c).isNotNull(), at))[c],
        "keep": lambda c: F.min_by(F.struct(F.col(c)), at)[c],
        "count": lambda c: (F.coalesce(F.max(F.when(F.col("_new") == 0, F.col(c))), F.lit(0)) + F.sum("_new")),
    }
    return rows.unionByName(more).groupBy(*keys).agg(*(make[how](c).alias(c) for c, how in policy.items()))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pointers(runs: DataFrame, keys: Sequence[str], status: str, seq: str, run: str, successful: Sequence[str] = SUCCESSFUL) -> DataFrame:
    """Per portal: the last successful run in the order of registration, and counts."""
    good = F.col(status).isin(*successful)
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.count_if(good).alias("n_successful"), F.max_by(F.when(good, F.col(run)), F.when(good, F.col(seq))).alias("pointer"))


def with_status(runs: DataFrame, statuses: Sequence[str], order: Sequence[Column], limit: int = 100) -> DataFrame:
    return runs.filter(F.col("status").isin(*statuses)).orderBy(*order).limit(limit)


def interrupted(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin(*INTERRUPTIBLE))


def recovered(runs: DataFrame, valid_package: Column, package_exists: Column) -> DataFrame:
    """State that recovery gives an interrupted run: RUNNING was INTERRUPTED; FINALIZING converged if its package is valid, failed if there is none, and else waits for review."""
    new = F.when(F.col("status") == "RUNNING", "INTERRUPTED").when(F.col("status") == "FINALIZING", F.when(valid_package, "CONVERGED").when(~package_exists, "FAILED").otherwise("MANUAL_REVIEW_REQUIRED")).otherwise(F.col("status"))
    return runs.withColumn("recovered_status", new)


def registry_after(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Capture state of registered URLs after events (url, seq, outcome, http_status, error): the last event decides, and events of unknown URLs do nothing."""
    last = latest(events, ["url"], [F.desc("seq")]).select("url", "outcome", F.col("http_status").alias("_s"), F.col("error").alias("_e"))
    j = entries.join(last, "url", "left")
    state = F.when(F.col("outcome") == "SUCCESS", "CAPTURED").when(F.col("outcome") == "FAILURE", "FAILED").otherwise(F.col("capture_status"))
    return j.select("url", state.alias("capture_status"), F.coalesce("_s", "http_status").alias("http_status"), F.when(F.col("outcome") == "FAILURE", F.col("_e")).alias("error"))


def cascade(parents: DataFrame, children: DataFrame, key: Sequence[str], deleted: DataFrame) -> DataFrame:
    """Children that stay when the deleted parents go."""
    return children.join(parents.join(deleted, list(key), "left_semi"), list(key), "left_anti")


def restricted(children: DataFrame, key: Sequence[str], deleted: DataFrame) -> DataFrame:
    """Parents that may not be deleted since children refer to them."""
    return deleted.join(children, list(key), "left_semi")
