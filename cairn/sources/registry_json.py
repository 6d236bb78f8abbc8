"""Registries of deposit receipts as versioned JSON documents <-> tables; old versions are upgraded as they are read, newer ones refused.

A document is an object with schema_version (absent: 1), updated_at and receipts, a map from "portal:run" to a receipt. Documents of all versions are read by one scan
with one schema, which has the fields of all versions; `upgraded` then applies, row by row, the steps between a row's version and the present one. A step is a set of
columns over the columns that the step before gives, so the chain is a projection: no version costs a pass of its own.

Versions: 1 has `state` in lower case and `file_list`, a text with commas; 2 has `status` in upper case and `files`, an array; 3 names the digest
`package_fingerprint` (before: `fingerprint`) and counts `n_files`."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
RECEIPT = "portal_id string, run_id string, status string, package_fingerprint string, n_files int, files array<string>, updated_at string"
_OLD = "state string, file_list string, fingerprint string"
_FIELDS = f"{RECEIPT}, {_OLD}"
_DOCUMENT = f"schema_version string, updated_at string, receipts map<string, struct<{', '.join(c.replace(' ', ': ', 1) for c in _FIELDS.split(', '))}>>"


def steps() -> dict[int, dict[str, Column]]:
    """What brings a receipt of the version before to each version."""
    return {
        2: {"status": F.upper("state"), "files": F.when(F.col("file_list") == "", F.array().cast("array<string>")).otherwise(F.split("file_list", ","))},
        3: {"package_fingerprint": F.col("fingerprint"), "n_files": F.coalesce(F.size("files"), F.lit(0))},
    }


def upgraded(rows: DataFrame, chain: Mapping[int, Mapping[str, Column]], version: str = "version") -> DataFrame:
    """rows with the columns of the last version of the chain; a row takes the steps above its own version, in their order. Its version stays as it was read."""
    for v in sorted(chain):
        old = F.col(version) < v
        rows = rows.withColumns({name: F.when(old, made).otherwise(F.col(name)) for name, made in chain[v].items()})
    return rows


def documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, version, error and the fields of each document below path: one a file, or one a line. error: NOT_JSON, BAD_VERSION, or NEWER_VERSION for versions above VERSION."""
    text = spark.read.text(path, wholetext=not lines, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", _DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"), F.try_parse_json("value").alias("v"))
    rows = text.select("file", "v", "d.*").withColumn("version", F.when(F.col("schema_version").isNull(), 1).otherwise(F.expr("try_cast(schema_version AS int)")))
    broken = F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    error = F.when(broken, "NOT_JSON").when(F.col("version").isNull() | (F.col("version") < 1), "BAD_VERSION").when(F.col("version") > VERSION, "NEWER_VERSION")
    return rows.withColumn("error", error).drop("v", "schema_version")


def receipts(docs: DataFrame) -> DataFrame:
    """The receipts of all documents that can be read, as of the present version, with the version they were written in. A receipt without its own ids has those of its key."""
    rows = docs.filter("error IS NULL").select("file", "version", "updated_at", F.explode("receipts").alias("_key", "_r")).select("file", "version", F.col("updated_at").alias("_doc_at"), "_key", "_r.*")
    named = rows.withColumns({"portal_id": F.coalesce("portal_id", F.element_at(F.split("_key", ":", 2), 1)), "run_id": F.coalesce("run_id", F.try_element_at(F.split("_key", ":", 2), F.lit(2))), "updated_at": F.coalesce("updated_at", "_doc_at")})
    return upgraded(named, steps()).select("file", "version", *(c.split()[0] for c in RECEIPT.split(", ")))


def refused(docs: DataFrame) -> DataFrame:
    """Documents that were not read, with the reason."""
    return docs.filter("error IS NOT NULL").select("file", "version", "error")


def registries_of(rows: DataFrame, key: str = "portal_id") -> DataFrame:
    """key and the document of each registry, in the present version. A registry's receipts come together in one document by its nature; of receipts of one run the last by updated_at stays."""
    fields = [c.split()[0] for c in RECEIPT.split(", ")]
    last = rows.groupBy("portal_id", "run_id").agg(F.max_by(F.struct(*fields), F.coalesce("updated_at", F.lit(""))).alias("_r"), *([] if key == "portal_id" else [F.first(key).alias(key)]))
    entries = F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "portal_id", "run_id").alias("k"), "_r")), lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
    docs = last.groupBy(key).agg(F.max(F.col("_r")["updated_at"]).alias("updated_at"), F.map_from_entries(entries).alias("receipts"))
    return docs.select(key, F.to_json(F.struct(F.lit(str(VERSION)).alias("schema_version"), "updated_at", "receipts")).alias("document"))
