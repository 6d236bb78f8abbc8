"""Queries on whole runs, state documents, deposits and policies, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import crawl, observations, state
from ..sources import state_json


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _logs(spark, d):
    """Twenty archive pages of portal URLs, an article log, probes and an older snapshot."""
    p = _t(spark, d, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("u"), F.sha2("html", 256).alias("h"))
    i = F.col("page_id")
    log = p.filter(i % 9 != 4).groupBy((i % 20 + 1).cast("int").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda r: r["url"]).alias("article_urls"))
    name = lambda n: F.concat(F.lit("https://portal.example/page/"), n.cast("string"))
    log = log.select("pos", name(F.col("pos")).alias("url"), F.lit(200).alias("status_code"), "article_urls", F.when(F.col("pos") < 20, name(F.col("pos") + 1)).alias("next_page_url"))
    article_log = p.filter(i % 3 != 0).groupBy(F.col("u").alias("url")).agg(F.when(F.min(i) % 17 == 0, 500).otherwise(200).alias("status_code"), F.concat(F.lit("t"), (F.min(i) % 5).cast("string")).alias("title"), F.lit(None).cast("string").alias("published_at"), F.lit("a").alias("author"), F.min(F.when(i % 4 == 0, F.reverse("h")).otherwise(F.col("h"))).alias("content_hash"))
    prev = p.filter(i % 7 != 0).groupBy(F.col("u").alias("url")).agg(F.lit("run-0").alias("first_seen_run_id"), F.concat(F.lit("t"), (F.min(i) % 5).cast("string")).alias("title"), F.lit(None).cast("string").alias("published_at"), F.lit("a").alias("author"), F.min("h").alias("content_hash"), F.lit("CAPTURED").alias("capture_status"), F.lit("w").alias("warc_file"), F.lit("r").alias("warc_record_id"), F.lit("NEW").alias("status"))
    probes = p.groupBy(F.col("u").alias("url")).agg(F.when(F.min(i) % 2 == 0, 404).otherwise(200).alias("status_code"))
    return log, article_log, probes, prev


def _run(spark, d):
    log, article_log, probes, prev = _logs(spark, d)
    no_pages = spark.createDataFrame([], "url string, set_fingerprint string, next_page_url string")
    return crawl.incremental_run(log, article_log, probes, no_pages, prev, None, "run-1")


def incremental_run(spark, d):
    return _run(spark, d).summary


def incremental_classes(spark, d):
    return _run(spark, d).classes


_RUN = f"""WITH p AS (SELECT page_id, {urls.canonical_sql('url')} AS u, sha256(html) AS h FROM pages),
seen AS (SELECT DISTINCT u FROM p WHERE page_id % 9 <> 4),
log AS (SELECT u, CASE WHEN min(page_id) % 17 = 0 THEN 500 ELSE 200 END AS s, 't' || (min(page_id) % 5) AS title, min(CASE WHEN page_id % 4 = 0 THEN reverse(h) ELSE h END) AS h FROM p WHERE page_id % 3 <> 0 GROUP BY u),
prev AS (SELECT u, 't' || (min(page_id) % 5) AS title, min(h) AS h FROM p WHERE page_id % 7 <> 0 GROUP BY u),
probe AS (SELECT u, CASE WHEN min(page_id) % 2 = 0 THEN 404 ELSE 200 END AS s FROM p GROUP BY u),
cur AS (SELECT seen.u, CASE WHEN log.u IS NOT NULL AND log.s <> 200 THEN 'FETCH_FAILED' ELSE 'OK' END AS status, coalesce(CASE WHEN log.s = 200 THEN log.title END, prev.title) AS title, CASE WHEN log.s = 200 OR prev.u IS NOT NULL THEN 'a' END AS author, coalesce(CASE WHEN log.s = 200 THEN log.h END, prev.h) AS h FROM seen LEFT JOIN log USING (u) LEFT JOIN prev USING (u)
 UNION ALL SELECT prev.u, 'REMOVED', prev.title, NULL, prev.h FROM prev JOIN probe USING (u) WHERE prev.u NOT IN (SELECT u FROM seen) AND probe.s = 404),
classes AS (SELECT coalesce(prev.u, cur.u) AS url, CASE WHEN prev.u IS NULL THEN 'NEW' WHEN cur.u IS NULL THEN 'NOT_OBSERVED' WHEN cur.status <> 'OK' THEN cur.status WHEN prev.h <> cur.h THEN 'CONTENT_CHANGED' WHEN (coalesce(prev.title, ''), 'a') <> (coalesce(cur.title, ''), coalesce(cur.author, '')) AND coalesce(cur.title, '') || coalesce(cur.author, '') <> '' THEN 'METADATA_CHANGED' ELSE 'UNCHANGED' END AS change, coalesce(cur.status = 'REMOVED', false) AS confirmed_removed FROM prev FULL JOIN cur ON prev.u = cur.u)"""


def fetch_retries(spark, d):
    e = _t(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, (503, 429, 200, 500, 404))), (F.col("event_id") % 5 + 1).cast("int"))
    attempts = e.select(F.col("user_id").cast("string").alias("url"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("attempt"), status.alias("status_code"), F.when(F.col("event_id") % 2 == 0, F.lit(70)).alias("retry_after"), (F.col("event_id") % 7 == 0).alias("reused"))
    return crawl.retries(attempts)


def _state(spark, d):
    p = _t(spark, d, "pages")
    k = (F.col("page_id") % 5).cast("string")
    a = p.groupBy(F.concat(F.lit("portal"), k).alias("portal_id"), urls.canonical(F.col("url")).alias("url")).agg(F.min("page_id").alias("pos"), F.min(F.sha2("html", 256)).alias("content_hash"))
    blank = [c.split() for c in state_json.ARTICLE.split(", ")]
    own = {"canonical_url": F.col("url"), "content_hash": F.col("content_hash"), "first_seen_run_id": F.lit("run-1"), "status": F.lit("NEW")}
    a = a.select("portal_id", F.lit("run-1").alias("run_id"), "url", "pos", *[own.get(n, F.lit(None).cast(t)).alias(n) for n, t in blank])
    pages = a.groupBy("portal_id", "run_id").agg(F.array_sort(F.collect_list("url")).alias("article_urls"))
    cols = [c.split() for c in state_json.PAGE.split(", ")]
    mine = {"url": F.lit("https://p/1"), "article_urls": F.col("article_urls")}
    pages = pages.select("portal_id", "run_id", *[mine.get(n, F.lit(None).cast(t)).alias(n) for n, t in cols])
    head = a.groupBy("portal_id", "run_id").agg(F.lit("1").alias("schema_version"))
    return head, a, pages


def state_documents(spark, d):
    """State documents written as JSON and read back as tables."""
    docs = state_json.states_of(*_state(spark, d)).select(F.from_json("document", state_json.STATE).alias("s")).select("s.*")
    return state_json.articles(docs).groupBy("portal_id").agg(F.count("*").alias("n_articles"), F.count("pos").alias("n_ordered"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url", "content_hash"))), lambda r: F.concat(r["url"], r["content_hash"])), "\n"), 256).alias("digest"))


def catalog_documents(spark, d):
    o = _t(spark, d, "orders")
    runs = o.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("portal_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 9 == 0, "__system__").otherwise(F.col("o_orderkey").cast("string")).alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), F.lit("CONVERGED").alias("status"))
    for c in state_json.RUN.split(", "):
        n, t = c.split()
        if n not in runs.columns:
            runs = runs.withColumn(n, F.lit(None).cast(t))
    heads = runs.filter("run_id <> '__system__'").groupBy("portal_id").agg(F.max_by("run_id", "seq").alias("pointer"))
    docs = state_json.catalogs_of(runs, heads)
    return docs.select("portal_id", F.get_json_object("document", "$.latest_successful_run_id").alias("head"), F.get_json_object("document", "$.first_capture").alias("first_capture"), F.size(F.from_json(F.get_json_object("document", "$.all_run_ids"), "array<string>")).alias("n_runs"))


def control_projection(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("portal_id"))
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("portal_id"), F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"))
    first = o.groupBy("portal_id").agg(F.min("run_id").alias("a"), F.max("run_id").alias("b"))
    j = c.join(first, "portal_id")
    control = j.select("portal_id", F.when(F.col("portal_id") % 5 > 0, F.col("a")).alias("baseline"))
    catalogs = j.select("portal_id", F.when(F.col("portal_id") % 7 > 0, F.col("b")).alias("head"))
    return crawl.projected(control, catalogs, o).select("portal_id", F.col("head").cast("string").alias("head"), "projected")


def hydration(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("portal_id"))
    control = c.select("portal_id", F.when(F.col("portal_id") % 3 == 0, F.col("portal_id") * 10).alias("baseline"))
    catalogs = c.filter("portal_id % 2 = 0").select("portal_id", (F.col("portal_id") * 20).alias("head"))
    return crawl.hydrated(control, catalogs).withColumn("baseline", F.col("baseline").cast("string"))


def quarantine(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 100).alias("portal_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5 > 0).alias("is_valid"))
    listed = o.filter("run_id % 10 = 0").select("portal_id", "run_id", F.lit("OLD").alias("reason"))
    return crawl.quarantined(listed, o, F.lit("INVALID_PACKAGE"))


def deposit_actions(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 100).alias("portal_id"), F.col("o_orderkey").alias("run_id"), F.md5(F.col("o_orderkey").cast("string")).alias("fingerprint"), (F.col("o_orderkey") % 5 > 0).alias("is_valid"))
    receipts = o.filter("run_id % 3 > 0").select("portal_id", "run_id", F.when(F.col("run_id") % 4 == 0, F.lit("x")).otherwise(F.col("fingerprint")).alias("package_fingerprint"), F.when(F.col("run_id") % 2 == 0, "VERIFIED").otherwise("UPLOADING").alias("status"))
    return crawl.deposit_actions(o, receipts)


def deposit_metadata_errors(spark, d):
    i = F.col("doc_id")
    title = F.when(i % 7 == 0, F.col("text")).when(i % 7 == 1, F.col("lang")).when(i % 7 == 2, "   abc   ").when(i % 7 == 3, F.lit(None)).otherwise(F.col("source"))
    filled = lambda n, c: F.when(i % n == 0, F.array().cast("array<string>")).when(i % n == 1, F.lit(None)).otherwise(F.array(c))
    errors = text.deposit_errors(title, F.when(i % 9 == 0, "short" + " " * 30).otherwise(F.col("text")), filled(5, F.col("source")), filled(11, F.col("lang")), filled(8, F.lit("WARC")), F.when(i % 6 == 0, "").when(i % 6 > 1, "sums"), F.when(i % 4 == 0, "embargoed").when(i % 4 == 1, "open"), F.when(i % 3 == 0, "2030-01-01"))
    return _t(spark, d, "documents").select("doc_id", F.array_join(errors, ",").alias("errors"))


def run_report(spark, d):
    """Runs and successes by portal group and status, with subtotals."""
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 10).alias("portal"), F.col("o_orderstatus").alias("status"))
    return o.rollup(F.col("portal").cast("string").alias("portal"), "status").agg(F.count("*").alias("n_runs"), F.grouping_id().cast("int").alias("level"))


def url_lineage(spark, d):
    """URLs with first and last run, runs seen, and whether they count as new, reused or gone in the last run."""
    e = _t(spark, d, "events").select(F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("url"), (F.col("event_id") % 12).alias("run"))
    a = e.groupBy("url").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.countDistinct("run").alias("n_runs"))
    return a.withColumn("state", F.when(F.col("last_run") < 11, "GONE").when(F.col("first_run") == 11, "NEW").otherwise("REUSED"))


def outbox_due(spark, d):
    """The first hundred events that a worker would claim at second 5000."""
    e = _t(spark, d, "events")
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "RETRY", "IN_FLIGHT", "COMPLETED", "FAILED"))), (i % 5 + 1).cast("int"))
    rows = e.select(i.alias("event_id"), status.alias("status"), (i % 7).cast("int").alias("attempts"), (i * 3 % 9000).alias("next_at"), F.when(i % 5 == 2, i * 11 % 9000).alias("lease_until"), (i % 97).alias("created_at"))
    return state.next_claims(rows, F.lit(5000), 100).select("event_id", "status", "attempts", "next_at")


def robots_gate(spark, d):
    robots = F.when(F.col("page_id") % 3 == 0, F.lit(None)).when(F.col("page_id") % 3 == 1, F.lit("User-agent: *\nDisallow: /en/\n")).otherwise(F.lit("User-agent: cairn\nDisallow: /\n"))
    p = _t(spark, d, "pages")
    return p.select("page_id", urls.robots_allowed("cairn")(robots, F.col("url")).alias("allowed"))


def head_recall(spark, d):
    """What a first pass over each user's events finds against all of them."""
    v = _t(spark, d, "events").select("user_id", "event_id", F.concat("event_type", (F.col("event_id") % 30).cast("string")).alias("item"))
    found = observations.within_budget(v, ["event_id"], 40, ["user_id"]).filter("NOT exhausted")
    return observations.recall(found, v, "item")


QUERIES = {f.__name__: f for f in (incremental_run, incremental_classes, fetch_retries, state_documents, catalog_documents, control_projection, hydration, quarantine, deposit_actions, deposit_metadata_errors, run_report, url_lineage, outbox_due, robots_gate, head_recall)}

ORACLES = {
    "incremental_classes": f"{_RUN} SELECT * FROM classes",
    "incremental_run": f"{_RUN}, s AS (SELECT count(*) FILTER (change <> 'NEW') AS n_prev, count(*) FILTER (change <> 'NOT_OBSERVED') AS n_curr, {', '.join(f'''count(*) FILTER (change = '{c}') AS n_{c.lower()}''' for c in ('NEW', 'UNCHANGED', 'CONTENT_CHANGED', 'METADATA_CHANGED', 'NOT_OBSERVED', 'FETCH_FAILED', 'REMOVED'))} FROM classes) SELECT s.*, (SELECT count(DISTINCT page_id % 20) FROM p WHERE page_id % 9 <> 4) AS n_pages, 0::BIGINT AS n_failed_pages, false AS gate, false AS reconciled, false AS empty_head, false AS article_gate, 'CONVERGED' AS convergence FROM s",
    "fetch_retries": "WITH a AS (SELECT user_id::VARCHAR AS url, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, [503, 429, 200, 500, 404][event_id % 5 + 1] AS s, CASE WHEN event_id % 2 = 0 THEN 70 END AS ra, event_id % 7 = 0 AS reused FROM events), b AS (SELECT *, sum(CASE WHEN s = 429 THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY attempt) AS n429 FROM a), c AS (SELECT *, CASE WHEN s >= 500 OR (s = 429 AND n429 <= 1) THEN CASE WHEN attempt > 3 THEN 'GIVE_UP' ELSE 'RETRY' END WHEN s = 429 THEN 'GIVE_UP' ELSE 'DONE' END AS next_step FROM b), e AS (SELECT *, coalesce(max(CASE WHEN next_step <> 'RETRY' THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM c) SELECT url, attempt::INT AS attempt, s AS status_code, next_step, CASE WHEN next_step <> 'RETRY' THEN 0 WHEN s = 429 THEN least(coalesce(ra, 30), 60) ELSE (2 ** attempt)::BIGINT END AS delay, CASE WHEN reused THEN 0 ELSE 1 END AS cost FROM e WHERE ended = 0",
    "state_documents": f"WITH a AS (SELECT 'portal' || (page_id % 5) AS portal_id, {urls.canonical_sql('url')} AS url, min(page_id) AS pos, min(sha256(html)) AS h FROM pages GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY portal_id ORDER BY pos, url) AS n FROM a) SELECT portal_id, count(*) AS n_articles, count(*) AS n_ordered, sha256(string_agg(url || h, chr(10) ORDER BY n)) AS digest FROM r GROUP BY portal_id",
    "catalog_documents": "WITH r AS (SELECT 'p' || o_custkey AS portal_id, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders WHERE o_orderkey % 9 <> 0) SELECT portal_id, max(seq)::VARCHAR AS head, min(s) AS first_capture, count(*)::INT AS n_runs FROM r GROUP BY portal_id",
    "control_projection": "WITH o AS (SELECT o_custkey AS p, min(o_orderkey) AS a, max(o_orderkey) AS b, arg_min(o_orderdate::DATE, o_orderkey) AS da, arg_max(o_orderdate::DATE, o_orderkey) AS db FROM orders GROUP BY 1), j AS (SELECT p, CASE WHEN p % 5 > 0 THEN a END AS base, CASE WHEN p % 7 > 0 THEN b END AS head, da, db FROM o WHERE p IN (SELECT c_custkey FROM customer)), n AS (SELECT *, coalesce(head <> base AND db > da, false) AS newer FROM j) SELECT p AS portal_id, (CASE WHEN base IS NULL OR newer THEN head ELSE base END)::VARCHAR AS head, (base IS NOT NULL AND NOT newer) AS projected FROM n",
    "hydration": "SELECT c_custkey AS portal_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10 WHEN c_custkey % 2 = 0 THEN c_custkey * 20 END::VARCHAR AS baseline, CASE WHEN c_custkey % 3 = 0 THEN 'CONTROL' WHEN c_custkey % 2 = 0 THEN 'CATALOG' ELSE 'NONE' END AS origin FROM customer",
    "quarantine": "SELECT o_custkey % 100 AS portal_id, o_orderkey AS run_id, CASE WHEN o_orderkey % 10 = 0 THEN 'OLD' ELSE 'INVALID_PACKAGE' END AS reason FROM orders WHERE o_orderkey % 5 = 0",
    "deposit_actions": "SELECT o_custkey % 100 AS portal_id, o_orderkey AS run_id, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'RECONCILE_CHANGED_PACKAGE' WHEN o_orderkey % 2 = 0 THEN 'RETURN_RECEIPT' ELSE 'RESUME_DRAFT' END WHEN o_orderkey % 5 > 0 THEN 'CREATE_DRAFT' ELSE 'REJECT_INVALID_PACKAGE' END AS action FROM orders",
    "deposit_metadata_errors": r"""WITH t AS (SELECT doc_id AS i, coalesce(CASE i % 7 WHEN 0 THEN text WHEN 1 THEN lang WHEN 2 THEN '   abc   ' WHEN 3 THEN NULL ELSE source END, '') AS title, CASE WHEN i % 9 = 0 THEN 'short' ELSE coalesce(text, '') END AS description FROM documents),
n AS (SELECT i, length(regexp_replace(title, '^\s+|\s+$', '', 'g')) AS title, length(regexp_replace(description, '^\s+|\s+$', '', 'g')) AS description FROM t)
SELECT i AS doc_id, array_to_string(list_filter([CASE WHEN title < 5 THEN 'TITLE_TOO_SHORT' END, CASE WHEN i % 5 < 2 THEN 'NO_CREATOR' END, CASE WHEN description < 20 THEN 'DESCRIPTION_TOO_SHORT' END, CASE WHEN i % 11 < 2 THEN 'NO_SOURCE_DOMAIN' END, CASE WHEN i % 8 < 2 THEN 'NO_ARCHIVE_FORMAT' END, CASE WHEN i % 6 < 2 THEN 'NO_CHECKSUM_MANIFEST' END, CASE WHEN i % 4 = 0 AND i % 3 > 0 THEN 'NO_EMBARGO_DATE' END], lambda x: x IS NOT NULL), ',') AS errors FROM n""",
    "run_report": "SELECT (o_custkey % 10)::VARCHAR AS portal, o_orderstatus AS status, count(*) AS n_runs, grouping((o_custkey % 10)::VARCHAR, o_orderstatus)::INT AS level FROM orders GROUP BY ROLLUP ((o_custkey % 10)::VARCHAR, o_orderstatus)",
    "url_lineage": "WITH e AS (SELECT event_type || (user_id % 40) AS url, event_id % 12 AS run FROM events), a AS (SELECT url, min(run) AS first_run, max(run) AS last_run, count(DISTINCT run) AS n_runs FROM e GROUP BY url) SELECT *, CASE WHEN last_run < 11 THEN 'GONE' WHEN first_run = 11 THEN 'NEW' ELSE 'REUSED' END AS state FROM a",
    "outbox_due": "WITH r AS (SELECT event_id, ['PENDING', 'RETRY', 'IN_FLIGHT', 'COMPLETED', 'FAILED'][event_id % 5 + 1] AS status, (event_id % 7)::INT AS attempts, event_id * 3 % 9000 AS next_at, CASE WHEN event_id % 5 = 2 THEN event_id * 11 % 9000 END AS lease_until, event_id % 97 AS created_at FROM events) SELECT event_id, status, attempts, next_at FROM r WHERE attempts < 5 AND ((status IN ('PENDING', 'RETRY') AND next_at <= 5000) OR (status = 'IN_FLIGHT' AND lease_until <= 5000)) ORDER BY next_at, created_at, event_id LIMIT 100",
    "robots_gate": f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN true WHEN page_id % 3 = 1 THEN NOT regexp_extract(url, '{urls._PATH}', 1) LIKE '/en/%' ELSE false END AS allowed FROM pages",
    "head_recall": "WITH v AS (SELECT event_type || (event_id % 30) AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT DISTINCT item FROM v WHERE n <= 40), t AS (SELECT DISTINCT item FROM v), n AS (SELECT (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM f JOIN t USING (item)) AS n_both) SELECT *, round(n_both / n_truth, 4) AS recall, round(n_both / n_found, 4) AS precision FROM n",
}
