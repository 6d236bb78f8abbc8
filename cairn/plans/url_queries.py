"""Queries on page URLs and on snapshots of them. Each has the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fingerprints, urls
from ..operators import digests, observations, snapshot

EXCLUDED, ARTICLE = ("/login", "/privacy", "/a"), ("/b", "/c", "/post/")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def url_canonical(spark, d):
    u = urls.canonical(F.col("url"))
    return _pages(spark, d).select("page_id", u.alias("canonical_url"), urls.url_hash(u).alias("url_hash"))


def url_lookup_norm(spark, d):
    u = urls.lookup(F.col("url"))
    return _pages(spark, d).select("page_id", u.alias("lookup_url"), urls.toggled_slash(u).alias("alias_url"))


def _hosted(spark, d):
    return _pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"), urls.canonical(F.col("url")).alias("u"))


_HOSTED = f"hosted AS (SELECT page_id, lower(regexp_extract(url, '{urls._HOST}', 1)) AS host, {urls.canonical_sql('url')} AS u FROM pages)"


def page_fingerprints(spark, d):
    rows = _hosted(spark, d)
    n = rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.countDistinct("u").alias("n_distinct"))
    return digests.fingerprints(rows, "host", "u", "page_id").select("host", "ordered_fingerprint", "set_fingerprint").join(n, "host")


def child_fingerprints(spark, d):
    rows = _pages(spark, d).select(urls.host(F.col("url")).alias("host"), F.col("page_id"), F.trim("url").alias("u"))
    return digests.fingerprints(rows, "host", "u", "page_id").select("host", "ordered_fingerprint", "set_fingerprint")


def url_ledger(spark, d):
    return observations.ledger(_hosted(spark, d), "u", "host", "page_id").withColumnRenamed("u", "canonical_url")


def url_duplicates(spark, d):
    return observations.duplicates(_hosted(spark, d), "u")


def new_per_host(spark, d):
    return observations.new_per_page(_hosted(spark, d), "u", "host", ["page_id"])


def archive_order(spark, d):
    first = observations.first_seen(_hosted(spark, d), "u", ["page_id"])
    return first.select("host", "u", F.row_number().over(Window.partitionBy("host").orderBy("page_id")).alias("pos"))


def link_classes(spark, d):
    page = _pages(spark, d)
    hosts = [f"{x}" for x in ("example.com", "www.example.com", "blog.example.org")]
    u = F.col("url")
    even = F.when(F.col("page_id") % 2 == 0, urls.path(u)).otherwise(u)
    return page.select("page_id", urls.link_class(even, hosts, EXCLUDED, ARTICLE).alias("link_class"), urls.valid_article(u, (), ("#", "/privacy"), ("/a", "/b", "/c"), "/archive", "/news/").alias("is_article"), urls.asset_kept(u).alias("is_asset"))


def _any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


_LINK_CLASSES = f"""
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '{urls._PATH}', 1) ELSE url END AS v FROM pages),
q AS (SELECT *, lower(regexp_extract(v, '{urls._HOST}', 1)) AS h, lower(regexp_extract(v, '{urls._PATH}', 1)) AS pa, lower(regexp_extract(url, '{urls._PATH}', 1)) AS up FROM p)
SELECT page_id, CASE WHEN coalesce(v, '') = '' THEN 'EXCLUDED' WHEN h <> '' AND h NOT IN ('example.com', 'www.example.com', 'blog.example.org') THEN 'OUT_OF_SCOPE' WHEN {_any('pa', EXCLUDED)} THEN 'EXCLUDED' WHEN {_any('pa', ARTICLE)} THEN 'ARTICLE_NODE' ELSE 'ARCHIVE_NODE' END AS link_class,
 (NOT {_any('lower(url)', ('#', '/privacy'))} AND up <> '/archive' AND (up LIKE '/a%' OR up LIKE '/b%' OR up LIKE '/c%') AND trim(replace(up, '/news/', ''), '/') <> '') AS is_article,
 true AS is_asset FROM q
"""


def _articles(spark, d, which: str) -> DataFrame:
    p = _pages(spark, d).filter("page_id % 10 <> 0" if which == "prev" else "page_id % 7 <> 0")
    body = F.concat("html", F.when((F.lit(which) == "curr") & (F.col("page_id") % 5 == 0), "*").otherwise(""))
    status = F.when((F.lit(which) == "curr") & (F.col("page_id") % 31 == 0), "REMOVED").when((F.lit(which) == "curr") & (F.col("page_id") % 37 == 0), "FETCH_FAILED").otherwise("NEW")
    title = F.concat(F.lit("t"), (F.col("page_id") % F.when(F.lit(which) == "curr", 11).otherwise(33)).cast("string"))
    rows = p.select("page_id", urls.canonical(F.col("url")).alias("url"), status.alias("status"), F.sha2(body, 256).alias("content_hash"), F.when(F.col("page_id") % 3 > 0, title).alias("title"), F.lit(None).cast("string").alias("published_at"), F.lit("").alias("author"))
    return observations.first_seen(rows, "url", ["page_id"])


def _articles_sql(which: str) -> str:
    curr = which == "curr"
    return f"""{which} AS (SELECT * FROM (SELECT page_id, {urls.canonical_sql('url')} AS url, {"CASE WHEN page_id % 31 = 0 THEN 'REMOVED' WHEN page_id % 37 = 0 THEN 'FETCH_FAILED' ELSE 'NEW' END" if curr else "'NEW'"} AS status, sha256(html || {"CASE WHEN page_id % 5 = 0 THEN '*' ELSE '' END" if curr else "''"}) AS content_hash, CASE WHEN page_id % 3 > 0 THEN 't' || (page_id % {11 if curr else 33}) END AS title FROM pages WHERE page_id % {7 if curr else 10} <> 0) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)"""


_CLASSES = f"""{_articles_sql('prev')}, {_articles_sql('curr')},
classes AS (SELECT coalesce(p.url, c.url) AS url, CASE WHEN p.url IS NULL THEN 'NEW' WHEN c.url IS NULL THEN 'NOT_OBSERVED' WHEN c.status = 'REMOVED' THEN 'REMOVED' WHEN c.status = 'FETCH_FAILED' THEN 'FETCH_FAILED' WHEN p.content_hash <> c.content_hash THEN 'CONTENT_CHANGED' WHEN coalesce(p.title, '') <> coalesce(c.title, '') AND coalesce(p.title, '') <> '' AND coalesce(c.title, '') <> '' THEN 'METADATA_CHANGED' ELSE 'UNCHANGED' END AS change, coalesce(c.status = 'REMOVED', false) AS confirmed_removed FROM prev p FULL JOIN curr c ON p.url = c.url)"""


def snapshot_diff(spark, d):
    return snapshot.article_classes(_articles(spark, d, "prev"), _articles(spark, d, "curr"))


def diff_summary(spark, d):
    return snapshot.summary(snapshot_diff(spark, d))


_SUMMARY = "SELECT count(*) FILTER (change <> 'NEW') AS n_prev, count(*) FILTER (change <> 'NOT_OBSERVED') AS n_curr, " + ", ".join(f"count(*) FILTER (change = '{c}') AS n_{c.lower()}" for c in ("NEW", "UNCHANGED", "CONTENT_CHANGED", "METADATA_CHANGED", "NOT_OBSERVED", "FETCH_FAILED", "REMOVED"))


def _orders(spark, d):
    p, c = _articles(spark, d, "prev"), _articles(spark, d, "curr")
    place = F.col("page_id") % 13 * 1000000 + F.col("page_id")
    h = urls.host(F.col("url")).alias("host")
    return p.select(h, "url", F.col("page_id").alias("pos")), c.select(h, "url", place.alias("pos"))


def reordered_urls(spark, d):
    return snapshot.reordered(*_orders(spark, d), portal="host")


_REORDERED = f"""common AS (SELECT lower(regexp_extract(p.url, '{urls._HOST}', 1)) AS host, p.url, p.page_id AS i, c.page_id % 13 * 1000000 + c.page_id AS j FROM prev p JOIN curr c USING (url)),
ranked AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY i, url) AS prev_place, row_number() OVER (PARTITION BY host ORDER BY j, url) AS curr_place FROM common),
moved AS (SELECT host, url, prev_place::INT AS prev_place, curr_place::INT AS curr_place FROM ranked WHERE prev_place <> curr_place)"""


def anomaly_flags(spark, d):
    moved = reordered_urls(spark, d).agg(F.count("*").alias("n"))
    first = _pages(spark, d).filter("page_id = 1").agg(F.count("*").alias("n"))
    return snapshot.anomalies(snapshot_diff(spark, d), moved, first)


_ANOMALIES = f"""WITH {_CLASSES}, {_REORDERED}, s AS ({_SUMMARY} FROM classes), t AS (SELECT n_prev, n_curr, n_prev - n_not_observed AS n_common, (SELECT count(*) FROM moved) AS n_reordered, (SELECT count(*) FROM pages WHERE page_id = 1) AS n_first FROM s),
f AS (SELECT n_prev, n_curr, n_common, n_reordered, (n_prev >= 10 AND n_curr < n_prev * 0.5) AS collapsed, (n_first = 0) AS empty_head, (n_common >= 10 AND n_reordered > n_common * 0.8) AS massive_reorder FROM t)
SELECT *, (collapsed OR empty_head OR massive_reorder) AS manual_review FROM f"""


def _host_pages(spark, d, which: str) -> DataFrame:
    p = _pages(spark, d).filter("page_id % 50 <> 0" if which == "prev" else "page_id % 49 <> 0")
    pos = F.col("page_id") if which == "prev" else F.when(F.col("page_id") % 40 == 1, -F.col("page_id")).otherwise(F.col("page_id"))
    rows = p.select(urls.host(F.col("url")).alias("url"), urls.canonical(F.col("url")).alias("u"), pos.alias("pos"))
    step = 4 if which == "curr" else 5
    return rows.groupBy("url").agg(fingerprints.ordered(F.col("u"), F.col("pos")).alias("ordered_fingerprint"), fingerprints.as_set(F.col("u")).alias("unordered_fingerprint"), F.when(F.length("url") % step == 0, F.concat("url", F.lit("/2"))).alias("next_page_url"), F.lit(None).cast("string").alias("previous_page_url"))


def page_change_types(spark, d):
    return snapshot.page_changes(_host_pages(spark, d, "prev"), _host_pages(spark, d, "curr"))


def thread_page_changes(spark, d):
    return snapshot.thread_page_changes(_host_pages(spark, d, "prev"), _host_pages(spark, d, "curr"))


def _host_pages_sql(which: str) -> str:
    pos = "page_id" if which == "prev" else "CASE WHEN page_id % 40 = 1 THEN -page_id ELSE page_id END"
    return f"""{which} AS (SELECT host AS url, sha256(string_agg(u, chr(10) ORDER BY pos)) AS o, sha256(array_to_string(list_sort(list_distinct(list(u))), chr(10))) AS s, CASE WHEN length(host) % {4 if which == 'curr' else 5} = 0 THEN host || '/2' END AS n FROM (SELECT host, u, {pos} AS pos FROM hosted WHERE page_id % {50 if which == 'prev' else 49} <> 0) GROUP BY host)"""


_PAGE_PAIR = f"WITH {_HOSTED}, {_host_pages_sql('prev')}, {_host_pages_sql('curr')}"


def removed_probe(spark, d):
    probes = _articles(spark, d, "prev").select("url", F.element_at(F.array(F.lit(404), F.lit(200), F.lit(500)), (F.col("page_id") % 3 + 1).cast("int")).alias("status_code"))
    return snapshot.confirmed_removals(_articles(spark, d, "prev"), _articles(spark, d, "curr"), probes)


def carried_over(spark, d):
    prev = _articles(spark, d, "prev").withColumns({"first_seen_run_id": F.lit("run-1"), "warc_file": F.concat(F.lit("w"), F.col("page_id")), "warc_record_id": F.concat(F.lit("r"), F.col("page_id")), "capture_status": F.when(F.col("page_id") % 4 == 0, "FAILED").otherwise("CAPTURED")})
    return snapshot.carried_over(prev, _articles(spark, d, "curr"), "run-2")


def incremental_prefix(spark, d):
    """Hosts with one first letter are a portal's archive pages in the order of their names; each portal's crawl ends at the first page that is as before."""
    portal = F.left("url", F.lit(1)).alias("portal")
    curr = _host_pages(spark, d, "curr").withColumn("portal", portal)
    pos = F.row_number().over(Window.partitionBy("portal").orderBy("url"))
    log = curr.select("portal", pos.alias("pos"), "url", F.when(F.length("url") % 23 == 0, 500).otherwise(200).alias("status_code"), F.col("unordered_fingerprint").alias("set_fingerprint"), "next_page_url", F.lit(None).cast("string").alias("prev_head"))
    prev = _host_pages(spark, d, "prev").select(portal, "url", F.col("unordered_fingerprint").alias("set_fingerprint"), "next_page_url")
    return snapshot.visited_pages(log, prev, None, False, 5, ("portal",))


_PREFIX = f"""{_PAGE_PAIR}, log AS (SELECT left(c.url, 1) AS portal, row_number() OVER (PARTITION BY left(c.url, 1) ORDER BY c.url) AS pos, c.url, length(c.url) % 23 = 0 AS failed, (c.s = p.s AND c.n IS NOT DISTINCT FROM p.n AND p.url IS NOT NULL) AS same FROM curr c LEFT JOIN prev p USING (url)),
done AS (SELECT *, CASE WHEN failed THEN 'FETCH_FAILED' WHEN pos > 1 AND same THEN 'BOUNDARY_RECONCILED' ELSE 'COMPLETE' END AS outcome FROM log),
cut AS (SELECT portal, coalesce(min(pos) FILTER (outcome <> 'COMPLETE'), 1000000000) AS last FROM done GROUP BY portal)
SELECT portal, pos::INT AS pos, url, outcome FROM done JOIN cut USING (portal) WHERE pos <= last AND pos <= 5"""

QUERIES = {f.__name__: f for f in (url_canonical, url_lookup_norm, page_fingerprints, child_fingerprints, url_ledger, url_duplicates, new_per_host, archive_order, link_classes, snapshot_diff, diff_summary, reordered_urls, anomaly_flags, page_change_types, thread_page_changes, removed_probe, carried_over, incremental_prefix)}

ORACLES = {
    "url_canonical": f"SELECT page_id, u AS canonical_url, sha256(u) AS url_hash FROM (SELECT page_id, {urls.canonical_sql('url')} AS u FROM pages)",
    "url_lookup_norm": f"SELECT page_id, u AS lookup_url, CASE WHEN u LIKE '%/' THEN regexp_replace(u, '/$', '') ELSE u || '/' END AS alias_url FROM (SELECT page_id, {urls.lookup_sql('url')} AS u FROM pages)",
    "page_fingerprints": f"WITH {_HOSTED} SELECT host, sha256(string_agg(u, chr(10) ORDER BY page_id)) AS ordered_fingerprint, sha256(array_to_string(list_sort(list_distinct(list(u))), chr(10))) AS set_fingerprint, count(*) AS n_pages, count(DISTINCT u) AS n_distinct FROM hosted GROUP BY host",
    "child_fingerprints": f"WITH h AS (SELECT page_id, lower(regexp_extract(url, '{urls._HOST}', 1)) AS host, trim(url) AS u FROM pages) SELECT host, sha256(string_agg(u, chr(10) ORDER BY page_id)) AS ordered_fingerprint, sha256(array_to_string(list_sort(list_distinct(list(u))), chr(10))) AS set_fingerprint FROM h GROUP BY host",
    "url_ledger": f"WITH {_HOSTED} SELECT u AS canonical_url, min(page_id) AS first_visit, max(page_id) AS last_visit, count(DISTINCT host) AS n_pages, count(*) AS n_seen, string_agg(host, ',' ORDER BY page_id) AS pages FROM hosted GROUP BY u",
    "url_duplicates": f"WITH {_HOSTED} SELECT count(*) AS n_seen, count(DISTINCT u) AS n_distinct, count(u) - count(DISTINCT u) AS n_duplicates FROM hosted",
    "new_per_host": f"WITH {_HOSTED}, r AS (SELECT host, row_number() OVER (PARTITION BY u ORDER BY page_id) AS n FROM hosted) SELECT host, count(*) AS n_items, count(*) FILTER (n = 1) AS n_new FROM r GROUP BY host",
    "archive_order": f"WITH {_HOSTED}, r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY page_id) AS n FROM hosted) SELECT host, u, (row_number() OVER (PARTITION BY host ORDER BY page_id))::INT AS pos FROM r WHERE n = 1",
    "link_classes": _LINK_CLASSES,
    "snapshot_diff": f"WITH {_CLASSES} SELECT * FROM classes",
    "diff_summary": f"WITH {_CLASSES} {_SUMMARY} FROM classes",
    "reordered_urls": f"WITH {_CLASSES}, {_REORDERED} SELECT * FROM moved",
    "anomaly_flags": _ANOMALIES,
    "page_change_types": f"{_PAGE_PAIR} SELECT c.url, CASE WHEN p.url IS NULL THEN 'NEW_PAGE' WHEN c.s <> p.s THEN 'MEMBERSHIP_CHANGED' WHEN c.o <> p.o THEN 'ORDER_CHANGED' WHEN c.n IS DISTINCT FROM p.n THEN 'PAGINATION_CHANGED' ELSE 'UNCHANGED' END AS change FROM curr c LEFT JOIN prev p USING (url)",
    "thread_page_changes": f"{_PAGE_PAIR} SELECT c.url, CASE WHEN p.url IS NULL THEN 'NEW_PAGE' WHEN c.o = p.o THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM curr c LEFT JOIN prev p USING (url)",
    "removed_probe": f"WITH {_CLASSES} SELECT url, 'REMOVED' AS status FROM prev WHERE url NOT IN (SELECT url FROM curr) AND page_id % 3 = 0",
    "carried_over": f"WITH {_CLASSES} SELECT c.url, coalesce(CASE WHEN p.url IS NOT NULL THEN 'run-1' END, 'run-2') AS first_seen_run_id, 'run-2' AS last_seen_run_id, CASE WHEN p.url IS NULL THEN 'NEW' ELSE 'UNCHANGED' END AS status, CASE WHEN p.url IS NULL THEN 'CAPTURED' WHEN p.page_id % 4 = 0 THEN 'FAILED' ELSE 'REUSED' END AS capture_status, p.title, p.content_hash, 'w' || p.page_id AS warc_file, 'r' || p.page_id AS warc_record_id FROM curr c LEFT JOIN prev p USING (url)",
    "incremental_prefix": _PREFIX,
}
