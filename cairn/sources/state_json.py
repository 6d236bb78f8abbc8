"""Portal states and run catalogues as JSON documents <-> tables.

A document is one JSON object per file (multi-line). Unknown keys are dropped by the declared schemas, missing ones take
their defaults. Maps keyed by URL become rows; the place of an article in the archive's order becomes a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "canonical_url string, first_seen_run_id string, last_seen_run_id string, title string, published_at string, author string, content_hash string, raw_hash string, status string, content_capture_status string, seen_on_pages array<string>, representation_type string, metadata map<string,string>, last_captured_at string, warc_file string, warc_record_id string"
PAGE = "url string, ordered_fingerprint string, unordered_fingerprint string, article_urls array<string>, next_page_url string, previous_page_url string, page_number int, crawl_status string, observed_at string"
STATE = f"portal_id string, run_id string, schema_version string, captured_at string, archive_pages map<string, struct<{', '.join(c.replace(' ', ': ', 1) for c in PAGE.split(', '))}>>, articles map<string, struct<{', '.join(c.replace(' ', ': ', 1) for c in ARTICLE.split(', '))}>>, archive_order array<string>, head_fingerprint string, boundary_fingerprints map<string,string>, last_complete_archive_page string, last_potentially_incomplete_page string, source_manifest string"
RUN = "run_id string, started_at string, completed_at string, status string, mode string, previous_run_id string, article_count int, new_article_count int, changed_article_count int, run_dir string, manual_review_status string, anomalies array<string>"
CATALOG = f"portal_id string, updated_at string, first_capture string, latest_capture string, latest_successful_run_id string, all_run_ids array<string>, runs map<string, struct<{', '.join(c.replace(' ', ': ', 1) for c in RUN.split(', '))}>>"
SYSTEM_RUN = "__system__"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, STATE).filter("portal_id IS NOT NULL").withColumn("schema_version", F.coalesce("schema_version", F.lit("1")))


def snapshots(states: DataFrame) -> DataFrame:
    """One row per state, with counts taken from its maps."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return states.select("portal_id", "run_id", "schema_version", "captured_at", "head_fingerprint", "last_complete_archive_page", "last_potentially_incomplete_page", size("articles").alias("total_articles_count"), size("archive_pages").alias("total_archive_pages_count"))


def articles(states: DataFrame) -> DataFrame:
    """One row per article, keyed by its URL in the document; pos is its place in the archive's order, null if it has none."""
    a = states.select("portal_id", "run_id", "archive_order", F.explode("articles").alias("url", "a"))
    pos = F.nullif(F.array_position("archive_order", F.col("url")), F.lit(0))
    return a.select("portal_id", "run_id", "url", pos.alias("pos"), "a.*").withColumns({"status": F.coalesce("status", F.lit("UNCHANGED")), "content_capture_status": F.coalesce("content_capture_status", F.lit("CAPTURED")), "representation_type": F.coalesce("representation_type", F.lit("HTML"))})


def pages(states: DataFrame) -> DataFrame:
    p = states.select("portal_id", "run_id", F.explode("archive_pages").alias("key", "p"))
    return p.select("portal_id", "run_id", "p.*").withColumn("crawl_status", F.coalesce("crawl_status", F.lit("COMPLETE")))


def stored_html(states: DataFrame) -> DataFrame:
    """Articles that keep their page in the metadata, under raw_html, html or html_content."""
    m = F.col("metadata")
    body = F.coalesce(m["raw_html"], m["html"], m["html_content"])
    return articles(states).select("portal_id", "run_id", "url", body.alias("html")).filter("html IS NOT NULL")


def _struct(schema: str) -> Column:
    return F.struct(*(c.split()[0] for c in schema.split(", ")))


def states_of(snapshots: DataFrame, articles: DataFrame, pages: DataFrame) -> DataFrame:
    """portal_id, run_id and the document of each state, as JSON text. A state's rows come together in one document by its nature."""
    keys = ["portal_id", "run_id"]
    a = articles.withColumn("_a", _struct(ARTICLE)).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", "_a")), lambda x, y: F.when(x["url"] < y["url"], -1).when(x["url"] > y["url"], 1).otherwise(0))).alias("articles"), F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "url")))), lambda r: r["url"]).alias("archive_order"))
    p = pages.withColumn("_p", _struct(PAGE)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("url", "_p"))).alias("archive_pages"))
    j = snapshots.join(a, keys, "left").join(p, keys, "left")
    return j.select(*keys, F.to_json(F.struct(*[c for c in j.columns])).alias("document"))


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of each catalogue, with the place of its registration and whether it is the head."""
    c = _documents(spark, path, CATALOG).filter("portal_id IS NOT NULL")
    r = c.select("portal_id", "latest_successful_run_id", "all_run_ids", F.explode("runs").alias("key", "r"))
    return r.select("portal_id", "r.*", F.array_position("all_run_ids", F.col("r.run_id")).alias("seq"), F.coalesce(F.col("r.run_id") == F.col("latest_successful_run_id"), F.lit(False)).alias("is_head"))


def catalogs_of(runs: DataFrame, pointers: DataFrame) -> DataFrame:
    """portal_id and catalogue document of runs (portal_id, seq, and the fields of a run) and pointers (portal_id, pointer); the system's own run stays out."""
    kept = runs.filter(F.col("run_id") != SYSTEM_RUN).withColumn("_r", _struct(RUN))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "run_id", "_r")))
    c = kept.groupBy("portal_id").agg(ordered.alias("o"), F.min("started_at").alias("first_capture"), F.max(F.coalesce("completed_at", "started_at")).alias("latest_capture"))
    c = c.join(pointers.select("portal_id", F.col("pointer").alias("latest_successful_run_id")), "portal_id", "left")
    doc = F.struct("portal_id", "first_capture", "latest_capture", "latest_successful_run_id", F.transform("o", lambda r: r["run_id"]).alias("all_run_ids"), F.map_from_entries(F.transform("o", lambda r: F.struct(r["run_id"], r["_r"]))).alias("runs"))
    return c.select("portal_id", F.to_json(doc).alias("document"))
