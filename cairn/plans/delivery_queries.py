"""Queries on deposits that are really written, commits over two stores, and replay sessions, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import baseline, replay
from ..sources import deposits, registry_json, warc
from .function_queries import _folder, _t

_MAX_BYTES = 40_000


def deposit_sink(spark, d):
    """Files deposited six at a time, and once more after some have changed: what became of each deposit, both times."""
    i = F.col("doc_id")
    docs = _t(spark, d, "documents").select(F.concat(F.lit("p"), (F.floor(i / 6) % 50).cast("string")).alias("portal_id"), F.concat(F.lit("r"), F.floor(i / 6).cast("string")).alias("run_id"), F.concat(F.lit("f"), i.cast("string"), F.lit(".txt")).alias("filename"), F.coalesce("text", F.lit("")).alias("text"), i)
    path, out = _folder(spark, "deposits"), None
    for attempt in (1, 2):
        text = F.when((i % 13 == 0) & F.lit(attempt == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        files = docs.withColumn("text", text).select("portal_id", "run_id", "filename", F.encode("text", "UTF-8").alias("payload"), F.when(i % 41 == 0, "00").otherwise(F.sha2("text", 256)).alias("sha256"))
        got = deposits.deposit(files, path, max_total_bytes=_MAX_BYTES).withColumn("attempt", F.lit(attempt))
        out = got if out is None else out.unionByName(got)
    n = deposits.receipts(spark, path).count()
    return out.withColumns({"package_fingerprint": F.coalesce("package_fingerprint", F.lit("-")), "n_receipts": F.lit(n).cast("long")})


_STEPS = ("acquire", "begin", "catalog", "control", "begin", "catalog", "reread", "catalog", "control", "reread", "control", "recover", "acquire", "begin", "catalog", "crash", "acquire", "recover", "begin", "catalog", "control")


def baseline_commit(spark, d):
    """Two writers of each portal publish baselines over catalogue and control record; answers get lost, writers crash and take over. Every command's result and records."""
    e, i = _t(spark, d, "events"), F.col("event_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    place = F.when(i % 11 == 0, i % len(_STEPS)).otherwise(F.col("seq") % len(_STEPS))
    step = F.element_at(F.array(*map(F.lit, _STEPS)), (place + 1).cast("int"))
    writer = F.when((F.col("seq") / len(_STEPS)).cast("long") % 2 == F.when(i % 17 == 0, 1).otherwise(0), "a").otherwise("b")
    answer = F.when(i % 5 == 0, "lost").when(i % 7 == 0, "dropped").otherwise("ok")
    commands = e.withColumn("seq", n).select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("portal_id"), "seq", step.alias("cmd"), writer.alias("writer"), F.concat(F.lit("run"), i.cast("string")).alias("run_id"), answer.alias("answer"))
    r = baseline.commits(commands)
    return r.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("baseline", "head")})


def replay_sessions(spark, d):
    """Requests of clients against an archive of pages: named ones, relative ones with a Referer, without one, with a foreign one, and empty ones."""
    pages = _t(spark, d, "pages")
    i, n = F.col("event_id"), pages.count()
    index = warc.resources(pages.filter("page_id % 4 <> 3").select(F.lit("f").alias("file"), F.col("page_id").alias("record_no"), F.col("url").alias("target_uri"), F.lit(200).alias("status_code"), F.col("page_id").cast("string").alias("record_id"), F.lit("text/html").alias("content_type")))
    log = _t(spark, d, "events").select(F.col("user_id").alias("client_id"), i.alias("request_no"), (i * 7919 % n).alias("page_id")).join(pages.select("page_id", "url"), "page_id")
    k, named = F.col("request_no") % 5, urls.replay_url(F.lit(""), F.col("url"))
    path = F.regexp_extract("url", "^[^/]*//[^/?#]*([^#]*)", 1)
    request = F.when(k == 0, named).when(k == 4, "/replay?x=1").otherwise(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    referer = F.when(k == 1, F.concat(F.lit("http://r:80"), named)).when(k == 3, "http://other.example/?url=")
    rows = log.select("client_id", "request_no", request.alias("request"), referer.alias("referer"))
    return replay.answered(rows, index).select("request_no", F.coalesce("target", F.lit("-")).alias("target"), "resolved_by", "status_code", "outcome")


def registry_versions(spark, d):
    """Receipts from registry documents of all versions in one folder, and the documents of a version that is too new."""
    o = _t(spark, d, "orders")
    portal = F.col("o_custkey") % 200
    v = F.when(portal % 5 == 0, 1).otherwise(portal % 5).cast("int")
    status = F.when(F.col("o_orderstatus") == "F", "PUBLISHED").when(F.col("o_orderstatus") == "O", "DRAFT_CREATED").otherwise("FAILED")
    names = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int")), lambda k: F.concat(F.lit("f"), k.cast("string")))
    digest = F.md5(F.col("o_orderkey").cast("string"))
    receipt = F.struct(F.when(v > 1, status).alias("status"), F.when(v > 2, digest).alias("package_fingerprint"), F.when(v > 2, F.size(names)).alias("n_files"), F.when(v > 1, names).alias("files"), F.when(v == 1, F.lower(status)).alias("state"), F.when(v == 1, F.array_join(names, ",")).alias("file_list"), F.when(v < 3, digest).alias("fingerprint"))
    key = F.concat(F.lit("p"), portal.cast("string"), F.lit(":r"), F.col("o_orderkey").cast("string"))
    docs = o.select(portal.alias("portal"), F.when(portal % 5 > 0, v.cast("string")).alias("schema_version"), F.struct(key.alias("k"), receipt.alias("r")).alias("e")).groupBy("portal", "schema_version").agg(F.map_from_entries(F.collect_list("e")).alias("receipts"))
    path = _folder(spark, "registries")
    docs.select(F.to_json(F.struct("schema_version", "receipts")).alias("value")).write.text(path)
    read = registry_json.documents(spark, path, lines=True)
    bad = registry_json.refused(read).groupBy("version", "error").agg(F.count("*").cast("int").alias("n_files"))
    dash = F.lit("-")
    return registry_json.receipts(read).select("portal_id", "run_id", "version", "status", "package_fingerprint", "n_files").unionByName(bad.select(dash.alias("portal_id"), dash.alias("run_id"), "version", F.col("error").alias("status"), dash.alias("package_fingerprint"), "n_files"))


QUERIES = {f.__name__: f for f in (deposit_sink, baseline_commit, replay_sessions, registry_versions)}

_W = "CASE writer WHEN 'a' THEN a ELSE b END"
_WRITTEN = "answer <> 'dropped'"
#: The commit protocol as a recursion over each portal's commands; s is the state before, w the writer's attempt, r the result.
_COMMITS = f"""WITH RECURSIVE n AS (SELECT user_id, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
c AS (SELECT user_id, seq, 'run' || i AS run, {list(_STEPS)}[CASE WHEN i % 11 = 0 THEN i % {len(_STEPS)} ELSE seq % {len(_STEPS)} END + 1] AS cmd, CASE WHEN (seq // {len(_STEPS)}) % 2 = CASE WHEN i % 17 = 0 THEN 1 ELSE 0 END THEN 'a' ELSE 'b' END AS writer, CASE WHEN i % 5 = 0 THEN 'lost' WHEN i % 7 = 0 THEN 'dropped' ELSE 'ok' END AS answer FROM n),
f AS (
 SELECT user_id, 0::BIGINT AS seq, NULL::VARCHAR AS cmd, NULL::VARCHAR AS writer, NULL::VARCHAR AS result, NULL::VARCHAR AS owner, 0::BIGINT AS gen, 0::BIGINT AS cv, NULL::VARCHAR AS base, 0::BIGINT AS base_by, 0::BIGINT AS bgen, 0::BIGINT AS kv, NULL::VARCHAR AS head,
  {{'ph': 'NONE', 'cv': 0::BIGINT, 'kv': 0::BIGINT, 'g': 0::BIGINT, 'run': NULL::VARCHAR}} AS a, {{'ph': 'NONE', 'cv': 0::BIGINT, 'kv': 0::BIGINT, 'g': 0::BIGINT, 'run': NULL::VARCHAR}} AS b FROM n WHERE seq = 1
 UNION ALL
 SELECT user_id, seq, cmd, writer, r, CASE WHEN cmd = 'acquire' THEN writer ELSE owner END, gen + (cmd = 'acquire')::INT, cv + (cmd = 'acquire' OR set_control)::INT,
  CASE WHEN set_control THEN w.run ELSE base END, CASE WHEN set_control THEN w.g ELSE base_by END, bgen + set_control::INT, kv + (set_catalog OR r = 'PROJECTED')::INT, CASE WHEN set_catalog THEN w.run WHEN r = 'PROJECTED' THEN base ELSE head END,
  CASE WHEN writer = 'a' THEN new ELSE a END, CASE WHEN writer = 'b' THEN new ELSE b END
 FROM (SELECT *, r IN ('OK', 'AMBIGUOUS') AND cmd = 'catalog' AND {_WRITTEN} AS set_catalog, r IN ('COMMITTED', 'AMBIGUOUS') AND cmd = 'control' AND {_WRITTEN} AS set_control,
   CASE WHEN cmd = 'begin' AND r = 'OK' THEN {{'ph': 'BEGUN', 'cv': cv, 'kv': kv, 'g': gen, 'run': run}} ELSE {{'ph': CASE
     WHEN cmd = 'begin' OR cmd = 'crash' OR r IN ('CONFLICT', 'COMMITTED', 'PROJECTED', 'CLEAN') THEN 'NONE'
     WHEN cmd = 'catalog' AND r = 'OK' OR r = 'CONFIRMED' THEN 'CATALOG' WHEN cmd = 'catalog' AND r = 'AMBIGUOUS' THEN 'CATALOG_UNKNOWN' WHEN cmd = 'control' AND r = 'AMBIGUOUS' THEN 'CONTROL_UNKNOWN'
     WHEN r = 'RETRY' THEN CASE w.ph WHEN 'CATALOG_UNKNOWN' THEN 'BEGUN' ELSE 'CATALOG' END ELSE w.ph END, 'cv': w.cv, 'kv': w.kv, 'g': w.g, 'run': w.run}} END AS new
  FROM (SELECT *, CASE cmd WHEN 'acquire' THEN 'OK' WHEN 'crash' THEN 'CRASHED'
    WHEN 'begin' THEN CASE WHEN owner IS DISTINCT FROM writer THEN 'NOT_OWNER' ELSE 'OK' END
    WHEN 'recover' THEN CASE WHEN owner IS DISTINCT FROM writer THEN 'NOT_OWNER' WHEN head IS NOT DISTINCT FROM base THEN 'CLEAN' ELSE 'PROJECTED' END
    WHEN 'catalog' THEN CASE WHEN w.ph <> 'BEGUN' THEN 'OUT_OF_ORDER' WHEN cv <> w.cv OR owner IS DISTINCT FROM writer OR gen <> w.g OR kv <> w.kv THEN 'CONFLICT' WHEN answer = 'ok' THEN 'OK' ELSE 'AMBIGUOUS' END
    WHEN 'control' THEN CASE WHEN w.ph <> 'CATALOG' THEN 'OUT_OF_ORDER' WHEN cv <> w.cv THEN 'CONFLICT' WHEN answer = 'ok' THEN 'COMMITTED' ELSE 'AMBIGUOUS' END
    ELSE CASE w.ph WHEN 'CATALOG_UNKNOWN' THEN CASE WHEN head IS NOT DISTINCT FROM w.run AND kv = w.kv + 1 THEN 'CONFIRMED' WHEN kv = w.kv THEN 'RETRY' ELSE 'CONFLICT' END
     WHEN 'CONTROL_UNKNOWN' THEN CASE WHEN base IS NOT DISTINCT FROM w.run AND base_by = w.g THEN 'COMMITTED' WHEN cv = w.cv THEN 'RETRY' ELSE 'CONFLICT' END ELSE 'NOTHING' END END AS r
   FROM (SELECT f.* EXCLUDE (seq, cmd, writer, result), c.seq, c.cmd, c.writer, c.run, c.answer, CASE c.writer WHEN 'a' THEN f.a ELSE f.b END AS w FROM f JOIN c ON c.user_id = f.user_id AND c.seq = f.seq + 1))))
SELECT 'p' || user_id AS portal_id, seq, cmd, writer, result, coalesce(base, '-') AS baseline, coalesce(head, '-') AS head, gen AS generation, bgen AS baseline_generation, cv AS control_version, kv AS catalog_version FROM f WHERE seq > 0"""

ORACLES = {
    "deposit_sink": f"""WITH d AS (SELECT 'p' || (doc_id // 6 % 50) AS p, 'r' || (doc_id // 6) AS r, 'f' || doc_id || '.txt' AS name, coalesce(text, '') || CASE WHEN attempt = 2 AND doc_id % 13 = 0 THEN '!' ELSE '' END AS t, doc_id, attempt FROM documents, (SELECT unnest([1, 2]) AS attempt)),
g AS (SELECT attempt, p, r, count(*) AS n, sum(octet_length(encode(t)))::BIGINT AS total, bool_or(doc_id % 41 = 0) AS wrong, sha256(string_agg(sha256(t) || '  ' || name || chr(10), '' ORDER BY name)) AS fp FROM d GROUP BY ALL),
x AS (SELECT *, CASE WHEN total > {_MAX_BYTES} THEN 'OVER_QUOTA' WHEN wrong THEN 'DIGEST_MISMATCH' ELSE 'PUBLISHED' END AS o FROM g),
y AS (SELECT x.*, e.fp AS there FROM x LEFT JOIN x e ON x.attempt = 2 AND e.attempt = 1 AND e.p = x.p AND e.r = x.r AND e.o = 'PUBLISHED')
SELECT attempt, p AS portal_id, r AS run_id, CASE WHEN o <> 'PUBLISHED' OR there IS NULL THEN o WHEN there = fp THEN 'RECEIPT_RETURNED' ELSE 'CHANGED_PACKAGE' END AS outcome, CASE WHEN o <> 'PUBLISHED' THEN '-' ELSE coalesce(there, fp) END AS package_fingerprint, n AS n_files, total AS total_bytes, (SELECT count(*) FROM y WHERE o = 'PUBLISHED' AND there IS NULL) AS n_receipts FROM y""",
    "baseline_commit": _COMMITS,
    "registry_versions": "WITH o AS (SELECT *, o_custkey % 200 AS p, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE o_custkey % 5 END AS v FROM orders) SELECT 'p' || p AS portal_id, 'r' || o_orderkey AS run_id, v::INT AS version, CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'DRAFT_CREATED' ELSE 'FAILED' END AS status, md5(o_orderkey::VARCHAR) AS package_fingerprint, (o_orderkey % 4 + 1)::INT AS n_files FROM o WHERE v < 4 UNION ALL SELECT '-', '-', 4, 'NEWER_VERSION', '-', count(DISTINCT p)::INT FROM o WHERE v = 4 HAVING count(*) > 0",
    "replay_sessions": f"""WITH l AS (SELECT user_id, event_id AS i, event_id % 5 AS k, url, regexp_extract(url, '^[^/]*//[^/?#]*([^#]*)', 1) AS pq FROM events e JOIN pages p ON p.page_id = e.event_id * 7919 % (SELECT count(*) FROM pages)),
q AS (SELECT *, CASE WHEN pq LIKE '/%' THEN pq ELSE '/' || pq END AS rel, last_value(CASE WHEN k = 0 THEN url END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM l),
t AS (SELECT i, CASE WHEN k = 0 THEN url WHEN k = 1 THEN regexp_extract(url, '^[^/]*//[^/?#]*', 0) || rel WHEN k IN (2, 3) AND user_id IS NOT NULL THEN regexp_extract(s, '^[^/]*//[^/?#]*', 0) || rel END AS target, CASE WHEN k = 0 THEN 'URL' WHEN k = 1 THEN 'REFERER' WHEN k IN (2, 3) AND s IS NOT NULL AND user_id IS NOT NULL THEN 'SESSION' ELSE 'NONE' END AS how FROM q),
x AS (SELECT DISTINCT {urls.lookup_sql("url")} AS u FROM pages WHERE page_id % 4 <> 3),
y AS (SELECT DISTINCT regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS u FROM x),
z AS (SELECT t.*, {urls.lookup_sql("t.target")} AS n FROM t),
h AS (SELECT z.*, n IN (SELECT u FROM x) OR CASE WHEN n LIKE '%/' THEN n[:-2] ELSE n || '/' END IN (SELECT u FROM x) OR regexp_replace(n, '^[A-Za-z][A-Za-z0-9+.-]*:', '') IN (SELECT u FROM y) AS hit FROM z)
SELECT i AS request_no, coalesce(target, '-') AS target, how AS resolved_by, CASE WHEN target IS NOT NULL AND hit THEN 200 ELSE 404 END AS status_code, CASE WHEN target IS NULL THEN 'INVALID_REQUEST' WHEN hit THEN 'FOUND' ELSE 'RESOURCE_NOT_IN_ARCHIVE' END AS outcome FROM h""",
}
