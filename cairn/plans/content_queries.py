"""Queries on page content, packages, deposits and state, derived from the driver's tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, json_payload, text, urls
from ..operators import integrity, observations, recovery, rules, state
from ..sources import warc

RULES = {
    "title": {"selector": "article h1", "type": "css"},
    "first": {"selector": "//article/p[1]", "type": "xpath"},
    "links": {"selector": "nav > ul > li > a[href]", "type": "css"},
    "image": {"selector": "article img.hero", "type": "css"},
    "frame": {"selector": "div.ad, footer", "type": "css"},
}


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rich(spark, d):
    """The pages with assets, images, dates, authors and marks of lazy loading, by their number."""
    i = F.col("page_id")
    n = i.cast("string")
    some = lambda cond, *parts: F.when(cond, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise("")
    every = F.lit(True)
    head = F.concat(some(every, '<link rel="stylesheet" href="/s', (i % 3).cast("string"), '.css">'), some(i % 2 == 1, '<link rel="shortcut icon" href="/favicon.ico">'), some(i % 5 == 0, '<link rel="preload" as="font" href="https://fonts.example/f.woff2">'), some(i % 3 == 0, '<link rel="canonical" href=" https://c.example/', n, '">'), some(i % 4 > 0, '<meta name="author" content="A', (i % 4).cast("string"), '">'), some(i % 6 == 0, '<meta property="article:published_time" content="2024-01-01">'), some(i % 3 == 1, '<script src="/app', (i % 2).cast("string"), '.js" defer></script>'), some(i % 8 == 0, '<link rel="https://api.w.org/" href="/wp-json/">'), some(every, "</head>"))
    body = F.concat(some(i % 2 == 0, '<img src="/img/', n, '.png" srcset="/img/', n, ".png 1x, /img/", n, '-2.png 2x" loading="lazy">'), some(i % 3 == 0, '<img src="https://cdn.example/logo.svg">'), some(i % 7 == 0, '<img data-src="/lazy', n, '.jpg" src="data:image/gif;base64,x">'), some(i % 5 == 1, '<time datetime="2023-0', (i % 9 + 1).cast("string"), '-01">x</time>'), some(i % 11 == 0, '<video src="/v', n, '.mp4"></video>'), some(every, "</article>"))
    foot = F.concat(F.lit("<footer>"), some(i % 4 == 0, '<img src="/foot', (i % 2).cast("string"), '.png">'))
    h = F.replace(F.replace(F.replace(F.col("html"), F.lit("</head>"), head), F.lit("</article>"), body), F.lit("<footer>"), foot)
    return _t(spark, d, "pages").select("page_id", "url", h.alias("html"))


#: Character references of the pages' texts, which a semicolon may end or, where a text was cut, may not; & comes last, so that none is read twice.
_REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&"))


def _plain_sql(x: str) -> str:
    return reduce(lambda x, r: f"regexp_replace({x}, '&{r[0]};?', '{r[1]}', 'g')", _REFERENCES, x)


_ORIGIN = "regexp_extract(url, '^[^/]*//[^/?#]*', 0)"


def html_metadata(spark, d):
    shown = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return html.page_metadata(_rich(spark, d)).select("page_id", "title", "heading", *map(shown, ("canonical_url", "author", "publication_date", "rest_api_url")))


def lazy_loading(spark, d):
    return html.page_lazy_loading(_rich(spark, d))


def lazy_samples(spark, d):
    return html.page_lazy_samples(_rich(spark, d)).select("page_id", "mark", "tag", "source")


def page_assets(spark, d):
    return html.page_assets(_rich(spark, d)).select("page_id", "asset_url", "resource_type", "same_origin")


def assets_by_type(spark, d):
    return html.page_assets(_rich(spark, d)).groupBy("resource_type").agg(F.count("*").alias("n"), F.count_if("same_origin").alias("n_same_origin"))


def page_image_roles(spark, d):
    return html.page_images(_rich(spark, d))


def link_discovery(spark, d):
    """Candidate links of each page, canonical: how many, the first as it stands, and the first ten that differ."""
    links = html.page_links(_t(spark, d, "pages")).withColumn("u", urls.canonical(F.col("link_url")))
    per = links.groupBy("page_id").agg(F.count("*").alias("n_candidates"), F.countDistinct("u").alias("n_distinct"), F.min_by("href", "pos").alias("first_href"), F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "u"))), lambda r: r["u"])), 1, 10).alias("ten"))
    return per.select("page_id", "n_candidates", "n_distinct", "first_href", (F.col("n_candidates") - F.col("n_distinct")).alias("n_duplicates"), F.array_join("ten", " ").alias("first_ten"))


_HREFS = r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS hs FROM pages)"""


def rewritten_links(spark, d):
    r = html.page_rewritten(_t(spark, d, "pages"))
    return r.select("page_id", F.regexp_count("replay_html", F.lit("/replay\\?url=")).alias("n_replay_links"))


def reduced_pages(spark, d):
    r = html.page_reduced(_t(spark, d, "pages"))
    c = F.col("reduced_html")
    return r.select("page_id", (F.contains(c, F.lit("<script")) | F.contains(c, F.lit("<style")) | F.contains(c, F.lit("<!--"))).alias("has_dropped"), F.regexp_count(c, F.lit("<a href=")).alias("n_links"))


def selector_validation(spark, d):
    return rules.validate(_t(spark, d, "pages"), RULES)


def selector_validation_sql(spark, d):
    """selector_validation as SQL text: the rules as a table function in a lateral join."""
    rules.register(spark)
    return spark.sql(
        "SELECT field, tested, successful, empty, several, failures, rate, rate >= :threshold AS acceptable FROM (SELECT *, bround(successful / tested, 4) AS rate FROM ("
        "SELECT field, count(*) AS tested, count_if(success) AS successful, count_if(NOT success AND error <=> 'EMPTY_TEXT') AS empty, count_if(success AND match_count > 1) AS several, count_if(NOT success) AS failures"
        " FROM {pages} AS p, LATERAL page_fields(p.html, :rules) GROUP BY field))",
        args={"rules": json.dumps(RULES), "threshold": rules.THRESHOLD},
        pages=_t(spark, d, "pages"),
    )


def selector_acceptance(spark, d):
    return rules.accepted(rules.validate(_t(spark, d, "pages"), {k: RULES[k] for k in ("title", "links")}))


def selector_repair(spark, d):
    """Rates of the failing rules before and after a repair that was approved."""
    fixed = rules.FixedRules({"image": {"selector": "article h1", "type": "css"}})
    _, report = rules.repair(_t(spark, d, "pages"), {"selectors": RULES, "version": 1}, fixed, True)
    return spark.createDataFrame([(r["field"], float(r["old_rate"]), float(r["new_rate"]), r["applied"]) for r in report], "field string, old_rate double, new_rate double, applied boolean")


def field_accuracy(spark, d):
    """Three fields against what the page's text says; the last truth is wrong for one page in four."""
    pages = _t(spark, d, "pages")
    plain = lambda c: F.trim(reduce(lambda x, r: F.regexp_replace(x, f"&{r[0]};?", r[1]), _REFERENCES, c))
    truths = {"title": plain(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), "body": plain(F.regexp_extract("html", "<p><b>([^<]*)", 1)), "ad": F.when(F.col("page_id") % 4 == 0, "-").otherwise(plain(F.regexp_extract("html", '<div class="ad">([^<]*)', 1)))}
    truth = pages.select("page_id", F.explode(F.create_map(*(x for f, c in truths.items() for x in (F.lit(f), c)))).alias("field", "expected"))
    return rules.field_accuracy(html.page_fields(pages, {"title": RULES["title"], "body": RULES["first"], "ad": {"selector": "div.ad", "type": "css"}}), truth)


def html_split(spark, d):
    return warc.sample_split(_t(spark, d, "pages").select("page_id", "url"), "url").select("page_id", "part")


def _as_records(spark, d):
    i = F.col("page_id")
    mimes = ("text/html", "text/html; charset=utf-8", "text/css", "application/javascript", "image/png", "application/json", "font/woff2", "text/plain", "application/xml", "application/pdf", "application/octet-stream")
    return _t(spark, d, "pages").select(F.when(i % 13 == 0, "resource").otherwise("response").alias("warc_type"), F.element_at(F.array(*map(F.lit, mimes)), (i % 11 + 1).cast("int")).alias("content_type"), F.concat("url", F.when(i % 2 == 0, ".css").otherwise("")).alias("target_uri"), F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, 404).otherwise(200).alias("status_code"), F.length("html").cast("long").alias("payload_length"), i.alias("page_id"))


def content_categories(spark, d):
    return warc.categories(_as_records(spark, d))


def category_errors(spark, d):
    """Pages that count as HTML by a loose test of their type, against those that are usable."""
    r = _as_records(spark, d)
    strict = r.filter(F.coalesce(text.usable_html(F.col("warc_type"), F.col("status_code"), F.col("content_type"), F.col("payload_length")), F.lit(False)) | (F.col("page_id") % 17 == 0))
    return observations.classified(warc.html_records(r), strict, "page_id", F.lit(r.count()))


def usable_html(spark, d):
    r = _as_records(spark, d)
    return r.agg(F.count_if((F.col("warc_type") == "response") & text.loose_html(F.col("content_type"))).alias("n_loose"), F.count_if(F.coalesce(text.usable_html(F.col("warc_type"), F.col("status_code"), F.col("content_type"), F.col("payload_length")), F.lit(False))).alias("n_strict"))


def replay_lookup(spark, d):
    i = F.col("page_id")
    records = _as_records(spark, d).select(F.lit("f").alias("file"), i.alias("record_no"), F.regexp_replace("target_uri", r"\.css$", "").alias("target_uri"), "status_code", F.concat(F.lit("r"), i).alias("record_id"), "content_type")
    index = warc.resources(records.filter("record_no % 4 <> 0"))
    requests = _t(spark, d, "pages").select(i.alias("request_no"), F.when(i % 3 == 0, urls.toggled_slash(F.col("url"))).otherwise(F.col("url")).alias("url"))
    return warc.replayed(requests, index).select("request_no", "outcome", "status_code")


def content_dedup(spark, d):
    docs = _t(spark, d, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def file_digests(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.digests(F.encode("text", "UTF-8")).alias("d")).select("doc_id", "d.*")


def json_classes(spark, d):
    e = _t(spark, d, "events")
    i = F.col("event_id")
    body = F.repeat(F.lit("x"), (i % 100).cast("int"))
    obj = F.to_json(F.struct(F.col("event_type").alias("title"), F.struct(body.alias("rendered")).alias("content")))
    payload = F.when(i % 4 == 0, F.concat(F.lit("["), obj, F.lit("]"))).when(i % 4 == 1, obj).when(i % 4 == 2, F.col("props")).otherwise(F.concat(F.lit("not json "), F.col("event_type")))
    return e.select("event_id", json_payload.classify(payload).alias("json_class"))


def text_similarity(spark, d):
    """Each document against one benchmark item, all items in turn; words are taken once of each text."""
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    n = items.count()
    a = docs.select("doc_id", F.col("text").alias("a"), json_payload.words(F.col("text")).alias("wa"), (F.col("doc_id") % n).alias("item_id"))
    b = items.select("item_id", F.col("text").alias("b"), json_payload.words(F.col("text")).alias("wb"))
    same = json_payload.same_article(F.col("b"), F.col("a"), F.left(F.md5("b"), F.lit(1)), F.col("a"))
    return a.join(b, "item_id").select("doc_id", "item_id", json_payload.jaccard(F.col("wa"), F.col("wb")).alias("jaccard"), same["title_match"].alias("title_match"), same["identity"].alias("identity"))


def rule_proposals(spark, d):
    i = F.col("page_id")
    selector = F.when(i % 7 == 0, "").when(i % 7 == 1, "eval (x)").when(i % 7 == 2, "a <script").when(i % 7 == 3, "__dunder__").otherwise("h1.title")
    rule = F.when(i % 11 == 0, F.create_map(F.lit("selector"), selector, F.lit("code"), F.lit("x"))).when(i % 11 == 1, F.create_map(F.lit("type"), F.lit("css"))).when(i % 11 == 2, F.create_map(F.lit("selector"), selector, F.lit("type"), F.lit("regex"))).otherwise(F.create_map(F.lit("selector"), selector, F.lit("type"), F.lit("XPath")))
    return _t(spark, d, "pages").select("page_id", F.coalesce(text.rule_error(F.when(i % 13 == 0, " ").otherwise("title"), rule), F.lit("OK")).alias("result"))


def manifest_verify(spark, d):
    docs = _t(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    listed = docs.filter("doc_id % 23 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 17 == 0, F.lit("0")).otherwise(F.upper("sha256")))
    return integrity.verify(listed, docs.filter("doc_id % 19 <> 0"))


def manifest_rollup(spark, d):
    return integrity.rollup(manifest_verify(spark, d).withColumn("package", F.length("path")), ["package"])


def package_errors(spark, d):
    """All errors of packages of files, with faults of their metadata."""
    states = manifest_verify(spark, d).withColumn("package", F.length("path"))
    faults = _t(spark, d, "documents").filter("doc_id < 3").select(F.length(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))).alias("package"), F.concat(F.lit("fault "), F.col("doc_id").cast("string")).alias("error"))
    return integrity.error_lists(states, faults, ["package"]).select("package", "n_errors", F.md5("errors").alias("errors_md5"))


def manifest_lines(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 9 == 0, "../x").when(i % 9 == 1, "C:/y").when(i % 9 == 2, "a//./b\\c").when(i % 9 == 3, "/abs").otherwise(F.concat(F.lit("docs/"), i.cast("string")))
    line = F.when(i % 10 == 0, "# note").when(i % 10 == 1, "  ").when(i % 10 == 2, "lonely").otherwise(F.concat(F.upper(F.md5(i.cast("string"))), F.lit("  "), name))
    return integrity.parsed_manifest(_t(spark, d, "documents").select(i.alias("line_no"), line.alias("value")))


def manifest_text(spark, d):
    files = _t(spark, d, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"))
    return integrity.manifest_digest(files).select("package_fingerprint", F.col("length").cast("int").alias("length"))


def fk_audit(spark, d):
    c, o, li = _t(spark, d, "customer").filter("c_custkey % 50 <> 0"), _t(spark, d, "orders").filter("o_orderkey % 40 <> 0"), _t(spark, d, "lineitem")
    a = integrity.orphans(o, c, [("o_custkey", "c_custkey")], "orders_customer")
    return a.unionByName(integrity.orphans(li, o, [("l_orderkey", "o_orderkey")], "lineitem_orders")).unionByName(integrity.orphans(_t(spark, d, "customer"), _t(spark, d, "nation"), [("c_nationkey", "n_nationkey")], "customer_nation"))


def pointer_audit(spark, d):
    portals = _t(spark, d, "customer").select(F.col("c_custkey").alias("portal_id"), (F.col("c_custkey") * 7 % 5000).alias("pointer"))
    runs = _t(spark, d, "orders").select(F.col("o_custkey").alias("portal_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "CONVERGED").otherwise("FAILED").alias("status"))
    return integrity.pointer_audit(portals, runs, ("CONVERGED",))


def deposit_verify(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.md5("text").alias("m"), F.sha2("text", 256).alias("local_sha256"))
    artifacts = docs.select("filename", F.col("m").alias("local_md5"), F.when(F.col("doc_id") % 8 == 0, F.lit("x")).otherwise(F.upper("m")).alias("remote_md5"), "local_sha256")
    listed = docs.filter("doc_id % 3 = 0").select("filename", F.when(F.col("doc_id") % 9 == 0, F.lit("y")).otherwise(F.col("local_sha256")).alias("sha256"))
    return integrity.verify_deposit(artifacts, listed)


def deposit_quota(spark, d):
    return integrity.quota(_t(spark, d, "documents").withColumn("bytes", F.octet_length("text").cast("long") * 1000000), "bytes", ["source"])


def deposit_transitions(spark, d):
    names = list(state.DEPOSIT_MOVES)
    log = _t(spark, d, "events").select("user_id", "ts", "event_id", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("status"))
    allowed = spark.createDataFrame([(a, b) for a, bs in state.DEPOSIT_MOVES.items() for b in bs], "src string, dst string")
    t = integrity.transitions(log, "user_id", ["ts", "event_id"], "status", allowed)
    return t.select("event_id", F.coalesce("previous", F.lit("-")).alias("previous"), "status", "is_allowed")


#: The outbox as a recursion over each user's commands, one command a step.
_OUTBOX = f"""WITH RECURSIVE n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
c AS (SELECT user_id, seq, CASE WHEN seq = 1 THEN 'insert' ELSE ['claim', 'complete', 'retry', 'renew', 'claim', 'retry'][event_id % 6 + 1] END AS cmd, seq * 25 AS t_now, 't' || (event_id % 2) AS tok, event_id % 17 = 0 AS rec FROM n),
f AS (SELECT user_id, 0::BIGINT AS seq, 'ABSENT' AS status, 0 AS attempts, 0::BIGINT AS next_at, NULL::BIGINT AS lease, NULL::VARCHAR AS token, NULL::VARCHAR AS result FROM n WHERE seq = 1
 UNION ALL SELECT user_id, seq,
  CASE WHEN cmd = 'insert' AND status = 'ABSENT' THEN 'PENDING' WHEN dead THEN 'RECONCILIATION_REQUIRED' WHEN claims THEN 'IN_FLIGHT' WHEN holds AND cmd = 'complete' THEN 'COMPLETED' WHEN holds AND cmd = 'retry' THEN CASE WHEN rec THEN 'RECONCILIATION_REQUIRED' WHEN attempts >= {state.MAX_ATTEMPTS} THEN 'FAILED' ELSE 'RETRY' END ELSE status END,
  attempts + claims::INT, CASE WHEN cmd = 'insert' AND status = 'ABSENT' THEN t_now WHEN holds AND cmd = 'retry' THEN t_now + {state.RETRY_S} ELSE next_at END,
  CASE WHEN claims OR (holds AND cmd = 'renew') THEN t_now + {state.LEASE_S} WHEN dead OR holds THEN NULL ELSE lease END, CASE WHEN claims THEN tok WHEN dead OR (holds AND cmd <> 'renew') THEN NULL ELSE token END,
  CASE WHEN cmd = 'insert' THEN CASE WHEN status = 'ABSENT' THEN 'OK' ELSE 'EXISTS' END WHEN cmd = 'claim' THEN CASE WHEN claims THEN 'OK' ELSE 'NOT_DUE' END WHEN holds THEN 'OK' ELSE 'LEASE_LOST' END
 FROM (SELECT f.* EXCLUDE (seq), c.* EXCLUDE (user_id), coalesce(cmd = 'claim' AND status = 'IN_FLIGHT' AND lease <= t_now AND attempts >= {state.MAX_ATTEMPTS}, false) AS dead,
   coalesce(cmd = 'claim' AND attempts < {state.MAX_ATTEMPTS} AND ((status IN ('PENDING', 'RETRY') AND next_at <= t_now) OR (status = 'IN_FLIGHT' AND lease <= t_now)), false) AS claims,
   coalesce(cmd IN ('renew', 'complete', 'retry') AND status = 'IN_FLIGHT' AND token = tok AND lease > t_now, false) AS holds FROM f JOIN c ON c.user_id = f.user_id AND c.seq = f.seq + 1))"""

_LEASES = """WITH RECURSIVE n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
c AS (SELECT user_id, seq, ['acquire', 'renew', 'commit', 'release'][event_id % 4 + 1] AS cmd, 'o' || (event_id % 2) AS who, seq * 20 AS t_now, seq // 3 AS given FROM n),
f AS (SELECT user_id, 0::BIGINT AS seq, NULL::VARCHAR AS cmd, NULL::VARCHAR AS result, NULL::VARCHAR AS owner, 0::BIGINT AS expires, 0::BIGINT AS generation, 0::BIGINT AS baseline_at FROM n WHERE seq = 1
 UNION ALL SELECT user_id, seq, cmd, CASE WHEN cmd = 'acquire' THEN CASE WHEN held THEN 'HELD' ELSE 'OK' END WHEN NOT mine THEN 'LEASE_LOST' WHEN cmd = 'commit' AND t_now < baseline_at THEN 'REGRESSION' ELSE 'OK' END,
  CASE WHEN takes THEN who WHEN mine AND cmd = 'release' THEN NULL ELSE owner END, CASE WHEN takes OR (mine AND cmd = 'renew') THEN t_now + 50 WHEN mine AND cmd = 'release' THEN 0 ELSE expires END, generation + takes::INT, CASE WHEN mine AND cmd = 'commit' AND t_now >= baseline_at THEN t_now ELSE baseline_at END
 FROM (SELECT *, cmd = 'acquire' AND NOT held AS takes, cmd <> 'acquire' AND held AND owner = who AND given = generation AS mine FROM (SELECT f.* EXCLUDE (seq, cmd, result), c.* EXCLUDE (user_id), owner IS NOT NULL AND t_now < expires AS held FROM f JOIN c ON c.user_id = f.user_id AND c.seq = f.seq + 1)))"""

#: Rules on the known shape of the pages: whether a field has a text, and whether it has several matches.
_RULES = r"""m AS (SELECT page_id, unnest(['title', 'first', 'links', 'image', 'frame']) AS field, unnest([trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) <> '', trim(regexp_extract(html, '<p><b>([^<]*)', 1)) <> '', len(regexp_extract_all(html, '<a href="[^"]*">[^<]*[^<\s][^<]*</a>')) > 0, false, true]) AS ok, unnest([1, 1, len(regexp_extract_all(html, '<a href=')), 0, 2]) AS n FROM pages),
v AS (SELECT field, count(*) AS tested, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok AND n > 0) AS empty, count(*) FILTER (ok AND n > 1) AS several, count(*) FILTER (NOT ok) AS failures, round_even(count(*) FILTER (ok) / count(*), 4) AS rate FROM m GROUP BY field)"""

_REPLAY = f"""WITH i AS (SELECT *, CASE WHEN page_id % 5 = 1 THEN 404 ELSE 200 END AS status, regexp_replace(norm, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS loose FROM (SELECT page_id, {urls.lookup_sql('url')} AS norm FROM pages WHERE page_id % 4 <> 0) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY page_id DESC) = 1),
l AS (SELECT loose, arg_min(status, norm) AS status FROM i GROUP BY loose),
r AS (SELECT page_id, {urls.lookup_sql('url')} AS norm FROM (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url WHEN url LIKE '%/' THEN left(url, length(url) - 1) ELSE url || '/' END AS url FROM pages)),
j AS (SELECT r.page_id, coalesce(a.status, b.status, l.status) AS status FROM r LEFT JOIN i a ON a.norm = r.norm LEFT JOIN i b ON b.norm = CASE WHEN r.norm LIKE '%/' THEN left(r.norm, length(r.norm) - 1) ELSE r.norm || '/' END LEFT JOIN l ON l.loose = regexp_replace(r.norm, '^[A-Za-z][A-Za-z0-9+.-]*:', ''))
SELECT page_id AS request_no, CASE WHEN status IS NULL THEN 'RESOURCE_NOT_IN_ARCHIVE' ELSE 'FOUND' END AS outcome, coalesce(status, 404) AS status_code FROM j"""

_MOVES = ", ".join(f"('{a}', '{b}')" for a, bs in state.DEPOSIT_MOVES.items() for b in bs)
_STATES = "[" + ", ".join(f"'{a}'" for a in state.DEPOSIT_MOVES) + "]"


def _packages(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 100).alias("portal_id"), F.col("o_orderkey").alias("run_id"), F.element_at(F.array(*map(F.lit, ("CONVERGED", "FAILED", "COMPLETED"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"))
    catalog = o.filter("run_id % 400 <> 1")
    packages = o.filter("run_id % 5 <> 0").withColumns({"is_valid": F.col("run_id") % 7 != 0, "has_state": F.col("run_id") % 11 != 0, "n_anomalies": (F.col("run_id") % 13 == 0).cast("int")})
    return catalog, packages, o


_PACKAGES = """o AS (SELECT o_custkey % 100 AS portal_id, o_orderkey AS run_id, ['CONVERGED', 'FAILED', 'COMPLETED'][o_orderkey % 3 + 1] AS status FROM orders),
states AS (SELECT portal_id, run_id, status, CASE WHEN run_id % 5 = 0 THEN CASE WHEN run_id % 400 <> 1 THEN 'MISSING_PACKAGE' END WHEN run_id % 400 <> 1 THEN CASE WHEN run_id % 7 <> 0 THEN 'VALID' ELSE 'CORRUPTED' END WHEN run_id % 7 <> 0 AND run_id % 11 <> 0 AND run_id % 13 <> 0 AND status <> 'FAILED' THEN 'ORPHAN' ELSE 'AMBIGUOUS' END AS state FROM o WHERE NOT (run_id % 5 = 0 AND run_id % 400 = 1))"""


def catalog_reconcile(spark, d):
    catalog, packages, _ = _packages(spark, d)
    return recovery.classes(catalog, packages)


def reconcile_actions(spark, d):
    return recovery.actions(catalog_reconcile(spark, d))


def fallback_heads(spark, d):
    _, _, runs = _packages(spark, d)
    return recovery.fallback_heads(catalog_reconcile(spark, d), runs.withColumn("seq", F.col("run_id")))


def _retention(spark, d):
    _, _, o = _packages(spark, d)
    folders = o.select("portal_id", F.format_string("run-%08d", F.col("run_id")).alias("name"), (F.col("run_id") % 6 == 0).alias("is_package"), (F.col("run_id") % 10 == 3).alias("has_anomaly"), (F.col("run_id") * 10).alias("bytes"))
    heads = o.groupBy("portal_id").agg(F.format_string("run-%08d", F.min("run_id")).alias("head_run"), F.format_string("/data/run-%08d", F.max(F.when(F.col("run_id") % 6 > 0, F.col("run_id")))).alias("run_dir"))
    return recovery.retention(folders, heads)


def retention_plan(spark, d):
    return _retention(spark, d)


def reclaimable_bytes(spark, d):
    return recovery.reclaimable(_retention(spark, d))


_RETENTION = f"""WITH {_PACKAGES}, h AS (SELECT portal_id, printf('run-%08d', min(run_id)) AS head_run, printf('run-%08d', max(run_id) FILTER (run_id % 6 > 0)) AS head_dir FROM o GROUP BY 1),
f AS (SELECT o.portal_id, printf('run-%08d', run_id) AS name, CASE WHEN run_id % 6 = 0 THEN 'PACKAGE' WHEN printf('run-%08d', run_id) IN (head_run, head_dir) THEN 'HEAD' WHEN run_id % 10 = 3 THEN 'ANOMALY' END AS r, run_id * 10 AS bytes FROM o JOIN h USING (portal_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY portal_id, r IS NULL ORDER BY name DESC) AS n FROM f),
plan AS (SELECT portal_id, name, (r IS NOT NULL OR n <= 5) AS kept, coalesce(r, CASE WHEN n <= 5 THEN 'RECENT' ELSE 'REMOVABLE' END) AS reason, bytes FROM k)"""


def baseline_checks(spark, d):
    i = F.col("c_custkey")
    facts = _t(spark, d, "customer").select(i.alias("portal_id"), F.when(i % 7 > 0, i).alias("head_run"), (i % 5 > 0).alias("run_dir_exists"), (i % 11 > 0).alias("state_exists"), F.when(i % 13 == 0, F.lit(0)).otherwise(i).alias("state_portal"), (i % 3 > 0).alias("package_valid"))
    return recovery.baselines(facts).select("portal_id", F.coalesce("reason", F.lit("OK")).alias("reason"))


def outbox_fold(spark, d):
    """Commands of each user as an outbox event's life."""
    e = _t(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    names = ("claim", "complete", "retry", "renew", "claim", "retry")
    cmds = e.withColumn("seq", n.cast("long")).select(F.col("user_id").cast("string").alias("event_id"), "seq", F.when(F.col("seq") == 1, "insert").otherwise(F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))).alias("cmd"), (F.col("seq") * 25).alias("at"), F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string")).alias("token"), F.lit("error").alias("error"), (F.col("event_id") % 17 == 0).alias("reconcile"))
    return state.outbox(cmds).groupBy("status", "result").agg(F.count("*").alias("n"), F.max("attempts").alias("most_attempts"))


def lease_fold(spark, d):
    e = _t(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    cmds = e.withColumn("seq", n).select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("portal_id"), "seq", F.element_at(F.array(*map(F.lit, ("acquire", "renew", "commit", "release"))), (F.col("event_id") % 4 + 1).cast("int")).alias("cmd"), F.concat(F.lit("o"), (F.col("event_id") % 2).cast("string")).alias("owner"), (F.col("seq") * 20).alias("at"), F.lit(50).alias("ttl"), (F.col("seq") / 3).cast("long").alias("generation"), F.concat(F.lit("run"), F.col("seq")).alias("baseline"))
    return state.leases(cmds).groupBy("cmd", "result").agg(F.count("*").alias("n"), F.max("generation").alias("highest_generation"))


_ASSETS = f"""WITH o AS (SELECT page_id AS i, {_ORIGIN} AS o FROM pages), assets AS (
SELECT i AS page_id, o || '/img/' || i || '.png' AS asset_url, 'image' AS resource_type, true AS same_origin FROM o WHERE i % 2 = 0 UNION ALL SELECT i, o || '/img/' || i || '-2.png', 'image', true FROM o WHERE i % 2 = 0
UNION ALL SELECT i, 'https://cdn.example/logo.svg', 'image', false FROM o WHERE i % 3 = 0 UNION ALL SELECT i, o || '/foot' || (i % 2) || '.png', 'image', true FROM o WHERE i % 4 = 0 UNION ALL SELECT i, o || '/s' || (i % 3) || '.css', 'css', true FROM o
UNION ALL SELECT i, o || '/favicon.ico', 'image', true FROM o WHERE i % 2 = 1 UNION ALL SELECT i, o || '/app' || (i % 2) || '.js', 'javascript', true FROM o WHERE i % 3 = 1 UNION ALL SELECT i, 'https://fonts.example/f.woff2', 'font', false FROM o WHERE i % 5 = 0 UNION ALL SELECT i, o || '/v' || i || '.mp4', 'video', true FROM o WHERE i % 11 = 0)"""

QUERIES = {f.__name__: f for f in (html_metadata, lazy_loading, lazy_samples, page_assets, assets_by_type, page_image_roles, link_discovery, rewritten_links, reduced_pages, selector_validation, selector_validation_sql, selector_acceptance, selector_repair, field_accuracy, html_split, content_categories, category_errors, usable_html, replay_lookup, content_dedup, file_digests, json_classes, text_similarity, rule_proposals, manifest_verify, manifest_rollup, package_errors, manifest_lines, manifest_text, fk_audit, pointer_audit, deposit_verify, deposit_quota, deposit_transitions, catalog_reconcile, reconcile_actions, fallback_heads, retention_plan, reclaimable_bytes, baseline_checks, outbox_fold, lease_fold)}

ORACLES = {
    "html_metadata": f"SELECT page_id, {_plain_sql("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS title, {_plain_sql(r"trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\s+', ' ', 'g'))")} AS heading, CASE WHEN page_id % 3 = 0 THEN 'https://c.example/' || page_id ELSE '-' END AS canonical_url, CASE WHEN page_id % 4 > 0 THEN 'A' || (page_id % 4) ELSE '-' END AS author, CASE WHEN page_id % 5 = 1 THEN '2023-0' || (page_id % 9 + 1) || '-01' WHEN page_id % 6 = 0 THEN '2024-01-01' ELSE '-' END AS publication_date, CASE WHEN page_id % 8 = 0 THEN {_ORIGIN} || '/wp-json/' ELSE '-' END AS rest_api_url FROM pages",
    "lazy_loading": "SELECT page_id, (page_id % 2 = 0 OR page_id % 7 = 0 OR page_id % 3 = 1) AS detected, (page_id % 2 = 0)::INT AS loading_lazy, (page_id % 7 = 0)::INT AS data_src, (page_id % 2 = 0)::INT AS srcset, (page_id % 3 = 1)::INT AS deferred_scripts FROM pages",
    "lazy_samples": "SELECT page_id, 'loading_lazy' AS mark, 'img' AS tag, '/img/' || page_id || '.png' AS source FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'data_src', 'img', '/lazy' || page_id || '.jpg' FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'deferred_script', 'script', '/app' || (page_id % 2) || '.js' FROM pages WHERE page_id % 3 = 1",
    "page_assets": f"{_ASSETS} SELECT * FROM assets",
    "assets_by_type": f"{_ASSETS} SELECT resource_type, count(*) AS n, count(*) FILTER (same_origin) AS n_same_origin FROM assets GROUP BY 1",
    # Open <b> and <p> of the pages count as ancestors; the article has to be among the first eight.
    "page_image_roles": f"WITH o AS (SELECT page_id, {_ORIGIN} AS o, CASE WHEN len(regexp_extract_all(html, '<p><b>')) <= 3 THEN 'article_content' ELSE 'unknown' END AS r FROM pages) SELECT page_id, o || '/img/' || page_id || '.png' AS image_url, r AS role FROM o WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'https://cdn.example/logo.svg', 'site_chrome' FROM o WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'data:image/gif;base64,x', r FROM o WHERE page_id % 7 = 0 UNION ALL SELECT page_id, o || '/foot' || (page_id % 2) || '.png', 'site_chrome' FROM o WHERE page_id % 4 = 0",
    "link_discovery": f"{_HREFS}, l AS (SELECT page_id, pos, {_ORIGIN} || h AS link FROM (SELECT page_id, url, unnest(list_transform(hs, lambda h: replace(h, '&amp;', '&'))) AS h, generate_subscripts(hs, 1) AS pos FROM a)), u AS (SELECT page_id, pos, {urls.canonical_sql('link')} AS u FROM l), d AS (SELECT page_id, count(*) AS n, count(DISTINCT u) AS m FROM u GROUP BY 1), o AS (SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS k FROM u GROUP BY page_id, u), t AS (SELECT page_id, string_agg(u, ' ' ORDER BY k) AS ten FROM o WHERE k <= 10 GROUP BY 1) SELECT page_id, n AS n_candidates, m AS n_distinct, replace(hs[1], '&amp;', '&') AS first_href, n - m AS n_duplicates, ten AS first_ten FROM d JOIN a USING (page_id) JOIN t USING (page_id)",
    "selector_validation": f"WITH {_RULES} SELECT *, rate >= {rules.THRESHOLD} AS acceptable FROM v",
    "selector_validation_sql": f"WITH {_RULES} SELECT *, rate >= {rules.THRESHOLD} AS acceptable FROM v",
    "selector_acceptance": f"WITH {_RULES} SELECT bool_and(rate >= {rules.THRESHOLD}) AS accepted, count(*) AS n_fields FROM v WHERE field IN ('title', 'links')",
    "selector_repair": f"WITH {_RULES} SELECT v.field, v.rate AS old_rate, t.rate AS new_rate, t.rate >= {rules.THRESHOLD} AS applied FROM v, (SELECT rate FROM v WHERE field = 'title') t WHERE v.field = 'image'",
    "replay_lookup": _REPLAY,
    "outbox_fold": f"{_OUTBOX} SELECT status, result, count(*) AS n, max(attempts) AS most_attempts FROM f WHERE seq > 0 GROUP BY 1, 2",
    "lease_fold": f"{_LEASES} SELECT cmd, result, count(*) AS n, max(generation) AS highest_generation FROM f WHERE seq > 0 GROUP BY 1, 2",
    "rewritten_links": f"{_HREFS} SELECT page_id, len(list_filter(hs, lambda h: h NOT LIKE '#%' AND h NOT LIKE 'mailto:%' AND h NOT LIKE 'javascript:%'))::INT AS n_replay_links FROM a",
    "reduced_pages": f"{_HREFS} SELECT page_id, false AS has_dropped, len(hs)::INT AS n_links FROM a",
    "html_split": "SELECT page_id, CASE WHEN n <= 3 THEN 'generation' WHEN n <= 5 THEN 'validation' ELSE 'held_out' END AS part FROM (SELECT page_id, row_number() OVER (ORDER BY url) AS n FROM pages) WHERE n <= 6",
    "field_accuracy": "SELECT unnest(['title', 'body', 'ad']) AS field, count(*) AS n_expected, unnest([count(*), count(*), count(*) FILTER (page_id % 4 > 0)]) AS n_correct, round(unnest([count(*), count(*), count(*) FILTER (page_id % 4 > 0)]) / count(*), 4) AS accuracy FROM pages",
    "content_categories": "WITH c AS (SELECT CASE WHEN page_id % 13 = 0 THEN 'OTHER' ELSE ['HTML', 'HTML', 'CSS', 'JAVASCRIPT', 'IMAGE', 'JSON', 'FONT', 'TEXT', 'XML', 'PDF', CASE WHEN page_id % 2 = 0 AND split_part(url || '.css', '?', 1) LIKE '%.css' THEN 'CSS' ELSE 'OTHER' END][page_id % 11 + 1] END AS category FROM pages), d AS (SELECT unnest(['HTML', 'CSS', 'JAVASCRIPT', 'IMAGE', 'JSON', 'FONT', 'TEXT', 'XML', 'PDF', 'OTHER']) AS category) SELECT d.category, count(c.category) AS n FROM d LEFT JOIN c USING (category) GROUP BY 1",
    "usable_html": "SELECT count(*) FILTER (page_id % 13 <> 0 AND page_id % 11 < 2) AS n_loose, count(*) FILTER (page_id % 13 <> 0 AND page_id % 11 < 2 AND page_id % 5 <> 1) AS n_strict FROM pages",
    "category_errors": "WITH f AS (SELECT page_id, page_id % 13 <> 0 AND page_id % 11 < 2 AS loose, (page_id % 13 <> 0 AND page_id % 11 < 2 AND page_id % 5 <> 1) OR page_id % 17 = 0 AS strict FROM pages) SELECT count(*) FILTER (loose AND NOT strict) AS false_positives, count(*) FILTER (strict AND NOT loose) AS false_negatives, round(count(*) FILTER (loose = strict) / count(*), 4) AS accuracy FROM f",
    "content_dedup": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "file_digests": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents",
    "json_classes": "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'NON_JSON' WHEN event_id % 4 = 2 THEN 'METADATA_JSON' WHEN event_id % 100 > 50 THEN 'CONTENT_JSON' ELSE 'METADATA_JSON' END AS json_class FROM events",
    "text_similarity": r"""WITH j AS (SELECT doc_id, b.item_id, d.text AS ta, b.text AS tb, trim(regexp_replace(regexp_replace(lower(d.text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS pa, trim(regexp_replace(regexp_replace(lower(b.text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS pb FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
w AS (SELECT *, list_distinct(list_filter(string_split(pa, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(pb, ' '), lambda x: x <> '')) AS b, contains(pa, pb) OR contains(pb, pa) AS title_match FROM j),
n AS (SELECT *, len(list_intersect(a, b)) AS o FROM w) SELECT doc_id, item_id, CASE WHEN len(a) + len(b) - o > 0 THEN round(o / (len(a) + len(b) - o), 4) ELSE 0.0 END AS jaccard, title_match, title_match OR contains(ta, left(md5(tb), 1)) AS identity FROM n""",
    "rule_proposals": "WITH s AS (SELECT page_id, page_id % 13 = 0 AS blank, page_id % 11 AS k, page_id % 7 AS m FROM pages) SELECT page_id, CASE WHEN blank THEN 'INVALID_FIELD' WHEN k = 0 THEN 'DISALLOWED_KEYS' WHEN k = 1 THEN 'MISSING_SELECTOR' WHEN m = 0 THEN 'EMPTY_SELECTOR' WHEN k = 2 THEN 'UNSUPPORTED_TYPE' WHEN m < 4 THEN 'DANGEROUS_PATTERN' ELSE 'OK' END AS result FROM s",
    "manifest_verify": "SELECT 'docs/' || doc_id AS path, CASE WHEN doc_id % 19 = 0 THEN 'MISSING' WHEN doc_id % 23 = 0 THEN 'UNEXPECTED' WHEN doc_id % 17 = 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS state FROM documents WHERE NOT (doc_id % 19 = 0 AND doc_id % 23 = 0)",
    "manifest_rollup": "WITH v AS (SELECT length('docs/' || doc_id) AS package, CASE WHEN doc_id % 19 = 0 THEN 'MISSING' WHEN doc_id % 23 = 0 THEN 'UNEXPECTED' WHEN doc_id % 17 = 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS state FROM documents WHERE NOT (doc_id % 19 = 0 AND doc_id % 23 = 0)) SELECT package::INT AS package, count(*) FILTER (state = 'VERIFIED') AS n_verified, count(*) FILTER (state = 'MISSING') AS n_missing, count(*) FILTER (state = 'MISMATCH') AS n_mismatch, count(*) FILTER (state = 'UNEXPECTED') AS n_unexpected, bool_and(state = 'VERIFIED') AS is_valid FROM v GROUP BY package",
    "package_errors": "WITH v AS (SELECT length('docs/' || doc_id) AS package, CASE WHEN doc_id % 19 = 0 THEN 1 WHEN doc_id % 23 = 0 THEN 3 WHEN doc_id % 17 = 0 THEN 2 END AS k, 'docs/' || doc_id AS error FROM documents WHERE NOT (doc_id % 19 = 0 AND doc_id % 23 = 0) UNION ALL SELECT length('docs/' || doc_id), 0, 'fault ' || doc_id FROM documents WHERE doc_id < 3) SELECT package::INT AS package, count(*) AS n_errors, md5(string_agg(error, '; ' ORDER BY k, error)) AS errors_md5 FROM v WHERE k IS NOT NULL GROUP BY package",
    "manifest_lines": "WITH s AS (SELECT doc_id AS line_no, doc_id % 10 AS k, doc_id % 9 AS m, md5(doc_id::VARCHAR) AS h FROM documents) SELECT line_no, CASE WHEN k <> 2 THEN h END AS sha256, CASE WHEN k = 2 THEN NULL WHEN m = 0 THEN '../x' WHEN m = 1 THEN 'C:/y' WHEN m = 2 THEN 'a/b/c' WHEN m = 3 THEN '/abs' ELSE 'docs/' || line_no END AS path, CASE WHEN k = 2 THEN 'MALFORMED' WHEN m IN (0, 1, 3) THEN 'UNSAFE_PATH' END AS error FROM s WHERE k > 1",
    "manifest_text": "WITH t AS (SELECT string_agg(sha256(html) || '  p/' || page_id, chr(10) ORDER BY 'p/' || page_id) || chr(10) AS text FROM pages) SELECT sha256(text) AS package_fingerprint, length(text)::INT AS length FROM t",
    "fk_audit": "SELECT 'orders_customer' AS constraint_name, count(*) AS n_violations FROM orders WHERE o_orderkey % 40 <> 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 50 <> 0) UNION ALL SELECT 'lineitem_orders', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 40 <> 0) UNION ALL SELECT 'customer_nation', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)",
    "pointer_audit": "SELECT c_custkey AS portal_id, c_custkey * 7 % 5000 AS pointer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey = c_custkey * 7 % 5000 AND o_orderstatus = 'F')",
    "deposit_verify": "SELECT 'f' || doc_id AS filename, (doc_id % 8 <> 0 AND doc_id % 9 <> 0) AS verified FROM documents",
    "deposit_quota": "WITH q AS (SELECT source, count(*) AS n_files, sum(octet_length(encode(text)) * 1000000)::BIGINT AS total_bytes, max(octet_length(encode(text)) * 1000000)::BIGINT AS largest FROM documents GROUP BY source) SELECT *, (n_files <= 100 AND largest <= 53687091200 AND total_bytes <= 53687091200) AS within_quota FROM q",
    "deposit_transitions": f"WITH m(src, dst) AS (VALUES {_MOVES}), l AS (SELECT user_id, ts, event_id, {_STATES}[event_id % {len(state.DEPOSIT_MOVES)} + 1] AS status FROM events), p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM l) SELECT event_id, coalesce(previous, '-') AS previous, status, (previous IS NULL OR previous = status OR (previous, status) IN (SELECT (src, dst) FROM m)) AS is_allowed FROM p",
    "catalog_reconcile": f"WITH {_PACKAGES} SELECT portal_id, run_id, state FROM states",
    "reconcile_actions": f"WITH {_PACKAGES}, a AS (SELECT portal_id, count(*) FILTER (state = 'VALID') AS n_valid, count(*) FILTER (state = 'MISSING_PACKAGE') AS n_missing_package, count(*) FILTER (state = 'CORRUPTED') AS n_corrupted, count(*) FILTER (state = 'ORPHAN') AS n_orphan, count(*) FILTER (state = 'AMBIGUOUS') AS n_ambiguous FROM states GROUP BY 1) SELECT *, CASE WHEN n_orphan > 1 OR n_ambiguous > 0 THEN 'MANUAL_REVIEW' WHEN n_orphan = 1 THEN 'ADOPT_ORPHAN' ELSE 'NONE' END AS action FROM a",
    "fallback_heads": f"WITH {_PACKAGES}, h AS (SELECT portal_id, arg_max(state, run_id) AS head_state, max(run_id) AS head, max(run_id) FILTER (state = 'VALID' AND status IN ('CONVERGED', 'COMPLETED')) AS fallback FROM states GROUP BY 1) SELECT portal_id, head, fallback FROM h WHERE head_state IN ('CORRUPTED', 'MISSING_PACKAGE')",
    "retention_plan": f"{_RETENTION} SELECT * FROM plan",
    "reclaimable_bytes": f"{_RETENTION} SELECT portal_id, count(*) FILTER (NOT kept) AS n_removable, coalesce(sum(bytes) FILTER (NOT kept), 0)::BIGINT AS bytes FROM plan GROUP BY 1",
    "baseline_checks": "SELECT c_custkey AS portal_id, CASE WHEN c_custkey % 7 = 0 THEN 'NO_SUCCESSFUL_RUN' WHEN c_custkey % 5 = 0 THEN 'RUN_DIR_MISSING' WHEN c_custkey % 11 = 0 THEN 'STATE_MISSING' WHEN c_custkey % 13 = 0 THEN 'PORTAL_MISMATCH' WHEN c_custkey % 3 = 0 THEN 'PACKAGE_INVALID' ELSE 'OK' END AS reason FROM customer",
}
