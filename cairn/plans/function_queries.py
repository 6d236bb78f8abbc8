"""Queries on scalar functions, archives and packages, each over its whole table; files go to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import crawl, graph, integrity, rules, state
from ..sources import config, packages, snapshots, state_json, stores, warc, warc_index
from . import log_queries


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark, kind: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def url_properties(spark, d):
    """Keys, links and classes of each page's URL."""
    u, i = F.col("url"), F.col("page_id")
    mime = F.when(i % 3 == 0, "text/html; charset=utf-8").when(i % 3 == 1, "text/css").when(i % 3 == 2, F.lit(None))
    odd = F.concat(F.when(i % 5 == 0, "DATA:").when(i % 5 == 1, " blob:").otherwise(""), u, F.lit("#top"))
    named = F.concat(F.element_at(F.split(u, "\\?"), 1), F.when(i % 4 == 0, ".svg").when(i % 4 == 1, ".CSS?v=1").otherwise(""))
    return _t(spark, d, "pages").select("page_id", urls.url_hash(u).alias("url_hash"), text.record_id(u).alias("record_id"), urls.replay_url(F.lit("http://r"), F.concat(F.lit("http://a b/"), i.cast("string"), F.lit("?q=ä&x=~*"))).alias("replay_url"), urls.topic_link(F.when(i % 3 > 0, F.concat(F.lit("https://h/support/topic/"), i.cast("string")))).alias("is_topic"), urls.asset_kept(odd).alias("kept"), urls.without_fragment(odd).alias("bare"), text.is_html(mime, named).alias("is_html"), text.is_css(mime, named).alias("is_css"))


def article_links(spark, d):
    """Whether a page's absolute URL names an article of an archive, under host, exclusion, prefix and root."""
    u = F.col("url")
    hosts = ("a.example.com", "b.example.org")
    own = F.concat(F.lit("https://"), F.when(F.col("page_id") % 4 < 2, hosts[0]).when(F.col("page_id") % 4 == 2, hosts[1]).otherwise("c.example.net"), F.when(F.col("page_id") % 5 == 0, "/news/").when(F.col("page_id") % 5 == 1, "/News/Tag/").otherwise("/news"), F.when(F.col("page_id") % 3 == 0, "").otherwise(urls.path(u)))
    return _t(spark, d, "pages").select("page_id", urls.valid_article(own, hosts, ("/tag/",), ("/news/",), "/news/archive").alias("is_article"))


def resolved_links(spark, d):
    """References of several shapes against each page's URL."""
    i = F.col("page_id")
    n = i.cast("string")
    ref = F.element_at(F.array(F.concat(F.lit("/r/"), n), F.concat(F.lit("https://o.example/"), n), F.concat(F.lit("//p.example/"), n), F.lit("?k=1"), F.lit("")), (i % 5 + 1).cast("int"))
    return _t(spark, d, "pages").select("page_id", urls.resolved(F.col("url"), ref).alias("link_url"))


def run_names(spark, d):
    """Names of runs and times as text, there and back; some times can't be parsed."""
    i = F.col("o_orderkey")
    shown = text.utc_text(F.col("o_orderdate"))
    started = F.when(i % 10 == 0, F.concat(F.lit("odd "), i.cast("string"))).otherwise(shown)
    return _t(spark, d, "orders").select("o_orderkey", text.run_id(started, F.lit(text.config_hash({"b": 1, "a": "é"}))).alias("run_id"), shown.alias("shown"), text.utc_time(started).alias("parsed"))


def answer_bodies(spark, d):
    """Answers with and without a code fence, secrets masked."""
    i = F.col("event_id")
    answer = F.when(i % 3 == 0, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n``` end"))).when(i % 3 == 1, F.concat(F.lit("```\n"), "props", F.lit("```"))).otherwise(F.concat(F.lit("  "), F.col("props"), F.lit("\n")))
    token = F.concat(F.lit("k"), (i % 10000).cast("string"))
    return _t(spark, d, "events").select("event_id", text.unfenced(answer).alias("body"), text.masked(F.concat(F.lit("key "), token, F.lit(" of "), token), token).alias("masked"))


def contained_paths(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("docs/", "./docs//", "a\\b\\", "../", "/", "C:", "docs/../", "  ", "x/./"))), (i % 9 + 1).cast("int")), F.when(i % 9 == 7, "").otherwise(i.cast("string")))
    return _t(spark, d, "documents").select("doc_id", F.coalesce(text.contained_path(path), F.lit("-")).alias("path"))


def page_marks(spark, d):
    """Post numbers, next and canonical links and the first choices of image sets, from marks put before each page."""
    i = F.col("page_id")
    n = i.cast("string")
    mark = F.concat(F.lit('<i id="post-'), n, F.lit('"></i><i id="post-7"></i><i id="post-'), n, F.lit('"></i>'), F.when(i % 2 == 0, F.concat(F.lit('<a class="page next" href="/p/'), n, F.lit('">n</a>'))).otherwise('<a class="nextish" href="/q">'), F.when(i % 3 == 0, F.concat(F.lit('<link rel="canonical" href="/c/'), n, F.lit('">'))).otherwise(""))
    page = F.concat(mark, "html")
    return _t(spark, d, "pages").select("page_id", F.array_join(text.post_ids(page), ",").alias("posts"), F.coalesce(text.next_link(page), F.lit("-")).alias("next_link"), F.coalesce(text.canonical_link(page), F.lit("-")).alias("canonical_link"), F.array_join(text.srcset_urls(F.concat(F.lit(" /a"), n, F.lit(".png 1x,/b.png  2x,, /c.png"))), " ").alias("choices"))


def etags_and_leases(spark, d):
    i = F.col("event_id")
    tag = F.when(i % 4 == 0, "").when(i % 4 == 1, F.lit(None)).when(i % 4 == 2, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.col("event_type"))
    expired = text.lease_expired(F.when(i % 5 > 0, F.lit("o")), F.when(i % 7 > 0, i * 3), F.lit(9000).cast("long"))
    return _t(spark, d, "events").select("event_id", F.coalesce(text.stripped_etag(tag), F.lit("-")).alias("stripped"), text.quoted_etag(tag).alias("quoted"), expired.alias("expired"))


def deposit_records(spark, d):
    docs, i = _t(spark, d, "documents"), F.col("doc_id")
    deposits = docs.select(i.alias("run_id"), F.col("source").alias("title"), F.col("lang").alias("description"), F.array("source", "lang").alias("creators"), F.when(i % 3 == 0, "OPEN").when(i % 3 == 1, "secret").alias("access"), F.array(F.lit("WARC")).alias("formats"), F.array("lang").alias("domains"), F.concat(F.lit("1."), (i % 4).cast("string")).alias("version"))
    return crawl.deposit_record(deposits).select("run_id", "metadata.title", "metadata.access_right", F.array_join(F.transform("metadata.creators", lambda c: c["name"]), "|").alias("creators"), F.array_join("metadata.keywords", "|").alias("keywords"))


def deposit_listing(spark, d):
    """Of each source the ten deposits submitted last, and their files by name."""
    docs = _t(spark, d, "documents").select("source", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), (F.col("doc_id") * 7919 % 10007).alias("submitted_at"), "doc_id")
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("submitted_at"), "doc_id"))
    by_name = F.row_number().over(Window.partitionBy("source").orderBy("filename"))
    return docs.withColumns({"place": n, "name_place": by_name}).filter("place <= 10").select("source", "place", "filename", "name_place")


def remote_verify(spark, d):
    """Expected files against objects, by the bytes that are there and not by what the store says of them."""
    docs = _t(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("body"), "doc_id")
    expected = docs.select("path", F.sha2("body", 256).alias("sha256"))
    objects = docs.filter("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("content"))
    return integrity.verify(expected, objects.select("path", F.sha2("content", 256).alias("sha256")))


def max_frontier(spark, d):
    """Most nodes that wait at once below each root, breadth first."""
    nodes, _ = graph.traverse(*log_queries._edges(spark, d), 2)
    return graph.frontier(nodes)


def object_store(spark, d):
    """Conditional writes of each user's objects, folded in their order."""
    e, i = _t(spark, d, "events"), F.col("event_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    cmds = e.withColumn("seq", n).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "seq", F.element_at(F.array(*map(F.lit, ("put_new", "put_if_match", "put_if_match", "get", "put_if_match", "delete"))), (i % 6 + 1).cast("int")).alias("cmd"), (F.col("seq") / 3).cast("long").alias("etag"))
    return state.objects(cmds)


def visit_policy(spark, d):
    """The visits that a policy makes to many recorded portals; each portal is a schedule of its own."""
    e = _t(spark, d, "events").select((F.col("user_id") % 200).alias("portal_id"), (F.col("event_id") % 5 + 1).cast("int").alias("page"), "event_id", F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("u"))
    log = e.withColumn("visit_no", F.row_number().over(Window.partitionBy("portal_id", "page").orderBy("event_id")))
    log = log.filter("visit_no <= 5").select("portal_id", "page", "visit_no", F.array("u").alias("urls"))
    return crawl.visit_schedules(log, "ROBUST", 5).groupBy("portal_id", "phase").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


def warc_roundtrip(spark, d):
    """Fetched pages written as WARC files and read again: failed and empty fetches go, the body is what was written."""
    i = F.col("page_id")
    fetched = _t(spark, d, "pages").select("url", F.when(i % 10 == 0, 0).when(i % 10 == 1, 404).otherwise(200).alias("status_code"), F.when(i % 4 == 0, "text/html; charset=utf-8").when(i % 4 == 1, "application/xhtml+xml").otherwise("text/css").alias("content_type"), F.when(i % 4 < 2, "html").otherwise("css").alias("resource_type"), F.when(i % 13 == 0, F.lit("")).otherwise(F.col("html")).cast("binary").alias("payload"))
    path = _folder(spark, "warc")
    warc.write(warc.harvest(fetched), path)
    rows = warc.read(spark, path)
    return rows.select("target_uri", "status_code", "content_type", F.col("payload_length").alias("size"), F.sha2("payload", 256).alias("payload_sha256"), F.md5(F.encode(warc.decoded("payload"), "UTF-8")).alias("text_md5"), (text.loose_html(F.col("content_type"))).alias("is_html"))


def warc_validation(spark, d):
    """Whether each file of an archive can be read to its end, on the executors: whole ones, one that is cut inside its second record, an empty one, and one that is not there."""
    pages = _t(spark, d, "pages").select(F.col("url").alias("uri"), F.when(F.col("page_id") % 3 == 0, "text/css").otherwise("text/html").alias("content_type"), F.col("html").cast("binary").alias("payload"), "page_id")
    path = _folder(spark, "warc")
    warc.write(pages.drop("page_id"), path)
    system, folder = stores.store(path)
    one, two = (warc.encoded(r["uri"], 200, r["content_type"], bytes(r["payload"]), compress=False) for r in pages.orderBy("page_id").limit(2).collect())
    for name, data in (("cut.warc", one + two[:-20]), ("empty.warc", b"")):
        with system.open_output_stream(f"{folder}/{name}") as out:
            out.write(data)
    expected = spark.createDataFrame([(f"{folder}/missing.warc",)], "file string")
    found = warc.validations(spark, path, expected)
    kind = F.coalesce(F.element_at(F.split("error", ":"), 1), F.lit("VALID"))
    return found.groupBy(kind.alias("outcome")).agg(F.when(F.first("valid"), F.lit(None)).otherwise(F.count("*")).alias("n_faulty"), F.sum("total").alias("n_records"), F.sum("html").alias("n_html"))


def archive_index(spark, d):
    """Every record of an archive found by its offset: files are cut in small ranges, the index is stored by URL, and each payload is read by a seek."""
    i = F.col("page_id")
    pages = _t(spark, d, "pages").select(F.col("url").alias("uri"), F.when(i % 4 == 0, 404).otherwise(200).alias("status_code"), F.when(i % 3 == 0, "text/css").otherwise("text/html").alias("content_type"), F.col("html").cast("binary").alias("payload"))
    path = _folder(spark, "warc")
    warc.write(pages.filter("status_code = 200"), f"{path}/compressed")
    warc.write(pages.filter("status_code = 404"), f"{path}/plain", compress=False)
    index = warc_index.build(spark, path, _folder(spark, "walks"), 1 << 16)
    where = _folder(spark, "index")
    warc_index.save(index, where)
    rows = warc_index.fetch(warc_index.load(spark, where))
    return rows.select("target_uri", "status_code", "content_type", "payload_length", F.sha2("payload", 256).alias("payload_sha256"))


def container_pages(spark, d):
    """Page lists of containers, in the order of URLs and of the pages of one URL, read on the executors; some lines are broken, no objects, or without a URL."""
    i = F.col("page_id")
    line = F.when(i % 7 == 0, F.concat(F.lit("{broken "), i.cast("string"))).when(i % 7 == 1, F.to_json(F.array("url"))).when(i % 7 == 2, F.to_json(F.struct(i.alias("title")))).otherwise(F.to_json(F.struct("url", i.cast("string").alias("title"))))
    rows = _t(spark, d, "pages").select(F.concat(F.lit("c"), (i % 5).cast("string")).alias("container"), line.alias("page_line"), F.col("url").alias("uri"), i.alias("seq"), F.col("html").cast("binary").alias("payload"))
    path = _folder(spark, "containers")
    written = warc.write_containers(rows, path).agg(F.sum("n_pages")).first()[0]
    found = warc.container_pages(spark, path).select(F.regexp_extract("file", "([^/]*)[.]wacz$", 1).alias("container"), "line_no", F.coalesce("url", F.lit("-")).alias("url"), F.coalesce("title", F.lit("-")).alias("title"), F.coalesce("error", F.lit("-")).alias("error"))
    return found.withColumn("n_written", F.lit(written).cast("bigint"))


def package_roundtrip(spark, d):
    """A sealed package of two tables: state of its files by table, and rows read back."""
    path = _folder(spark, "package")
    tables = {"orders": _t(spark, d, "orders"), "pages": _t(spark, d, "pages")}
    states = packages.write(tables, path, {"run": "r1"})
    by = states.groupBy(F.element_at(F.split("path", "/"), 1).alias("name")).agg(F.bool_and(F.col("state") == "VERIFIED").alias("verified"))
    n = [spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name in tables]
    return by.join(n[0].unionByName(n[1]), "name")


def replay_pages(spark, d):
    """Pages with their links led through the replay server, style sheets' links included."""
    i = F.col("page_id")
    css = F.concat(F.lit("<style>a{background:url('/i/"), i.cast("string"), F.lit(".png')} b{background:url(data:x)}</style></head>"))
    pages = _t(spark, d, "pages").select("page_id", "url", F.replace("html", F.lit("</head>"), css).alias("html"))
    shown = html.page_rewritten(pages)
    return shown.select("page_id", F.regexp_extract("replay_html", r"url\('([^']*)'\)", 1).alias("css_link"), F.contains("replay_html", F.lit("url(data:x)")).alias("data_kept"))


def point_lookup(spark, d):
    """The first record of a URL that has two, in an archive of all pages and some of them again; and a URL that is nowhere. Both by a stored index and one seek."""
    pages = _t(spark, d, "pages").select(F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"), F.lit(200).alias("status_code"))
    again = pages.filter(F.col("uri").contains("a")).withColumns({"payload": F.lit("again").cast("binary"), "status_code": F.lit(404)})
    path = _folder(spark, "warc")
    warc.write(pages, f"{path}/a")
    warc.write(again, f"{path}/b")
    where = _folder(spark, "index")
    warc_index.save(warc_index.build(spark, path, _folder(spark, "walks")), where)
    index = warc_index.load(spark, where)
    url = _t(spark, d, "pages").agg(F.max(F.when(F.col("url").contains("a"), F.col("url")))).first()[0]
    found = [warc_index.lookup(index, u).select("target_uri", "status_code", F.sha2("payload", 256).alias("payload_sha256")) for u in (url, "https://nowhere/")]
    return found[0].unionByName(found[1])


def stored_html(spark, d):
    """Articles of state documents that keep their page, under three names of which the first counts."""
    i = F.col("page_id")
    doc = F.struct(F.concat(F.lit("p"), (i % 5).cast("string")).alias("portal_id"), F.lit("r").alias("run_id"), F.create_map("url", F.struct(F.col("url").alias("canonical_url"), F.when(i % 4 == 0, F.create_map(F.lit("raw_html"), F.lit("raw"), F.lit("html"), F.lit("h"))).when(i % 4 == 1, F.create_map(F.lit("html"), F.lit("h"), F.lit("html_content"), F.lit("c"))).when(i % 4 == 2, F.create_map(F.lit("html_content"), F.lit("c"))).alias("metadata"))).alias("articles"))
    path = _folder(spark, "states")
    _t(spark, d, "pages").select(F.to_json(doc).alias("value")).write.text(path)
    # One document per line here; a state file of its own is read by read_states.
    docs = spark.read.text(path).select(F.from_json("value", state_json.STATE).alias("s")).select("s.*")
    return state_json.stored_html(docs).select("portal_id", "url", "html")


def rule_file(spark, d):
    """Rules read from a file, checked field by field, and run on all pages."""
    shown = config.parse_rules("selectors:\n  title:\n    selector: article h1\n  links:\n    selector: //nav/ul/li/a\n    type: xpath\n  none: h6.x\nmetadata:\n  version: 3\n  acceptance_threshold: 0.8\n")
    again = config.parse_rules(config.rules_text(shown))
    found = rules.validate(_t(spark, d, "pages"), again["selectors"], again["threshold"])
    return found.select("field", "tested", "successful", "acceptable", F.lit(again["version"]).alias("version"))


def backup_restore(spark, d):
    """Tables copied away and back; a second restore over them is refused."""
    base = _folder(spark, "backup")
    _t(spark, d, "customer").write.parquet(f"{base}/customer")
    packages.backup(spark, {"customer": f"{base}/customer"}, f"{base}/copy")
    packages.restore(spark, f"{base}/copy", {"customer": f"{base}/back"})
    try:
        packages.restore(spark, f"{base}/copy", {"customer": f"{base}/back"})
        refused = False
    except FileExistsError:
        refused = True
    return spark.read.parquet(f"{base}/back").select("c_custkey", "c_name", F.lit(refused).alias("refused"))


def snapshot_versions(spark, d):
    """Two versions of a set of tables, and a writer who built on an old one."""
    path = _folder(spark, "versions")
    region, nation = _t(spark, d, "region"), _t(spark, d, "nation")
    first = snapshots.publish(spark, {"region": region, "nation": nation}, path)
    second = snapshots.publish(spark, {"region": region.filter("r_regionkey > 1"), "nation": nation.filter("n_regionkey > 1")}, path, after=first)
    try:
        snapshots.publish(spark, {"region": region}, path, after=first)
        refused = False
    except snapshots.Conflict:
        refused = True
    rows = [snapshots.read(spark, path, t, v).agg(F.lit(t).alias("name"), F.lit(v).alias("version"), F.count("*").alias("n_rows")) for t in ("region", "nation") for v in (first, second)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumns({"is_current": F.col("version") == snapshots.current(spark, path), "refused": F.lit(refused)})


QUERIES = {f.__name__: f for f in (url_properties, article_links, resolved_links, run_names, answer_bodies, contained_paths, page_marks, etags_and_leases, deposit_records, deposit_listing, remote_verify, max_frontier, object_store, visit_policy, warc_roundtrip, warc_validation, archive_index, container_pages, package_roundtrip, replay_pages, point_lookup, stored_html, rule_file, backup_restore, snapshot_versions)}

_HASH = text.config_hash({"b": 1, "a": "é"})
#: The objects' fold as a recursion over each user's commands.
_OBJECTS = """WITH RECURSIVE n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
c AS (SELECT user_id, seq, ['put_new', 'put_if_match', 'put_if_match', 'get', 'put_if_match', 'delete'][event_id % 6 + 1] AS cmd, seq // 3 AS etag FROM n),
f AS (SELECT user_id, 0::BIGINT AS seq, NULL::VARCHAR AS cmd, NULL::VARCHAR AS result, 0::BIGINT AS version, false AS there FROM n WHERE seq = 1
 UNION ALL SELECT f.user_id, c.seq, c.cmd, CASE WHEN c.cmd = 'put_new' THEN CASE WHEN there THEN 'CONFLICT' ELSE 'OK' END WHEN NOT there THEN 'NOT_FOUND' WHEN c.cmd = 'put_if_match' AND etag <> version THEN 'PRECONDITION_FAILED' ELSE 'OK' END,
  version + ((c.cmd = 'put_new' AND NOT there) OR (c.cmd = 'put_if_match' AND there AND etag = version))::INT, CASE WHEN c.cmd = 'put_new' THEN true WHEN c.cmd = 'delete' THEN false ELSE there END FROM f JOIN c ON c.user_id = f.user_id AND c.seq = f.seq + 1)"""

ORACLES = {
    "url_properties": "WITH p AS (SELECT *, page_id AS i, CASE page_id % 5 WHEN 0 THEN 'DATA:' WHEN 1 THEN ' blob:' ELSE '' END || url || '#top' AS odd, CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/css' END AS mime FROM pages) SELECT page_id, sha256(url) AS url_hash, '<urn:uuid:' || left(sha256(url), 16) || '>' AS record_id, 'http://r/replay?url=http%3A%2F%2Fa%20b%2F' || page_id || '%3Fq%3D%C3%A4%26x%3D~%2A' AS replay_url, i % 3 > 0 AS is_topic, i % 5 > 1 AS kept, split_part(odd, '#', 1) AS bare, coalesce(mime LIKE 'text/html%', false) AND i % 4 <> 0 AS is_html, coalesce(mime = 'text/css', false) OR i % 4 = 1 AS is_css FROM p",
    "article_links": f"WITH p AS (SELECT page_id AS i, CASE WHEN page_id % 3 = 0 THEN '' ELSE lower(regexp_extract(url, '{urls._PATH}', 1)) END AS rest FROM pages), q AS (SELECT i, CASE i % 5 WHEN 0 THEN '/news/' WHEN 1 THEN '/news/tag/' ELSE '/news' END || rest AS p FROM p) SELECT i AS page_id, (i % 4 < 3 AND NOT contains(p, '/tag/') AND p NOT IN ('/news/archive') AND p LIKE '/news/%' AND trim(replace(p, '/news/', ''), '/') <> '') AS is_article FROM q",
    "resolved_links": "WITH p AS (SELECT page_id AS i, url, regexp_extract(url, '^[^/]*//[^/?#]*', 0) AS o FROM pages) SELECT i AS page_id, CASE i % 5 WHEN 0 THEN o || '/r/' || i WHEN 1 THEN 'https://o.example/' || i WHEN 2 THEN split_part(url, '//', 1) || '//p.example/' || i WHEN 3 THEN regexp_extract(url, '^[^?#]*', 0) || '?k=1' ELSE url END AS link_url FROM p",
    "run_names": f"WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS shown, o_orderkey % 10 = 0 AS odd, o_orderdate FROM orders) SELECT o_orderkey, 'run-' || CASE WHEN odd THEN 'odd ' || o_orderkey ELSE strftime(o_orderdate, '%Y%m%dT%H%M%SZ') END || '-{_HASH}' AS run_id, shown, CASE WHEN NOT odd THEN strptime(shown, '%Y-%m-%dT%H:%M:%SZ') END AS parsed FROM r",
    "answer_bodies": r"WITH e AS (SELECT event_id AS i, props, 'k' || (event_id % 10000) AS t FROM events) SELECT i AS event_id, regexp_replace(props, '^\s+|\s+$', '', 'g') AS body, CASE WHEN length(t) >= 4 THEN 'key *** of ***' ELSE 'key ' || t || ' of ' || t END AS masked FROM e",
    "contained_paths": "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'docs/' || doc_id WHEN 1 THEN 'docs/' || doc_id WHEN 2 THEN 'a/b/' || doc_id WHEN 8 THEN 'x/' || doc_id ELSE '-' END AS path FROM documents",
    "page_marks": "SELECT page_id, CASE WHEN page_id = 7 THEN '7' ELSE page_id || ',7' END AS posts, CASE WHEN page_id % 2 = 0 THEN '/p/' || page_id ELSE '-' END AS next_link, CASE WHEN page_id % 3 = 0 THEN '/c/' || page_id ELSE '-' END AS canonical_link, '/a' || page_id || '.png /b.png /c.png' AS choices FROM pages",
    "etags_and_leases": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE event_type END AS stripped, CASE WHEN event_id % 4 < 2 THEN '' ELSE '\"' || event_type || '\"' END AS quoted, (event_id % 5 = 0 OR event_id % 7 = 0 OR 9000 >= event_id * 3) AS expired FROM events",
    "deposit_records": "SELECT doc_id AS run_id, source AS title, CASE WHEN doc_id % 3 = 0 THEN 'open' ELSE 'restricted' END AS access_right, source || '|' || lang AS creators, 'web-archiving|corpus-linguistics|software-version:1.' || (doc_id % 4) || '|' || lang || '|WARC' AS keywords FROM documents",
    "deposit_listing": "WITH r AS (SELECT source, 'f' || doc_id AS filename, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 10007 DESC, doc_id) AS n, row_number() OVER (PARTITION BY source ORDER BY 'f' || doc_id) AS m FROM documents) SELECT source, n::INT AS place, filename, m::INT AS name_place FROM r WHERE n <= 10",
    "remote_verify": "SELECT 'docs/' || doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'MISSING' WHEN doc_id % 11 = 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS state FROM documents",
    "max_frontier": f"WITH RECURSIVE {log_queries._EDGES}, k AS (SELECT node, path[1] AS root, path[len(path) - 1] AS parent, depth, row_number() OVER (PARTITION BY path[1] ORDER BY depth, ord) AS k FROM tree), n AS (SELECT p.root, p.k, count(c.node) AS n FROM k p LEFT JOIN k c ON c.root = p.root AND c.parent = p.node AND c.depth = p.depth + 1 GROUP BY 1, 2), w AS (SELECT root, 1 + sum(n) OVER (PARTITION BY root ORDER BY k) - k AS w FROM n) SELECT root, greatest(max(w), 1)::INT AS max_frontier FROM w GROUP BY root",
    "object_store": f"{_OBJECTS} SELECT 'u' || user_id AS path, seq, cmd, result, version, there FROM f WHERE seq > 0",
    "warc_roundtrip": "SELECT url AS target_uri, CASE WHEN page_id % 10 = 1 THEN 404 ELSE 200 END AS status_code, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/xhtml+xml' ELSE 'text/css' END AS content_type, octet_length(encode(html)) AS size, sha256(html) AS payload_sha256, md5(html) AS text_md5, page_id % 4 < 2 AS is_html FROM pages WHERE page_id % 10 <> 0 AND page_id % 13 <> 0",
    "warc_validation": "SELECT 'VALID' AS outcome, NULL::BIGINT AS n_faulty, count(*) AS n_records, count(*) FILTER (page_id % 3 <> 0) AS n_html FROM pages UNION ALL (SELECT 'PARSE_ERROR', 1, 1, (page_id % 3 <> 0)::INT FROM pages ORDER BY page_id LIMIT 1) UNION ALL SELECT unnest(['EMPTY_FILE', 'FILE_NOT_FOUND']), 1, 0, 0",
    "archive_index": "SELECT url AS target_uri, CASE WHEN page_id % 4 = 0 THEN 404 ELSE 200 END AS status_code, CASE WHEN page_id % 3 = 0 THEN 'text/css' ELSE 'text/html' END AS content_type, octet_length(encode(html)) AS payload_length, sha256(html) AS payload_sha256 FROM pages",
    "container_pages": "SELECT 'c' || (page_id % 5) AS container, (1 + row_number() OVER (PARTITION BY page_id % 5 ORDER BY encode(url), page_id))::INT AS line_no, CASE WHEN page_id % 7 > 2 THEN url ELSE '-' END AS url, CASE WHEN page_id % 7 > 2 THEN page_id::VARCHAR ELSE '-' END AS title, ['NOT_JSON', 'NOT_AN_OBJECT', 'NO_URL', '-', '-', '-', '-'][page_id % 7 + 1] AS error, (SELECT count(*) FROM pages) AS n_written FROM pages",
    "package_roundtrip": "SELECT 'orders' AS name, true AS verified, count(*) AS n_rows FROM orders UNION ALL SELECT 'pages', true, count(*) FROM pages",
    "point_lookup": "SELECT max(url) AS target_uri, 200 AS status_code, sha256(arg_max(html, (url, -page_id))) AS payload_sha256 FROM pages WHERE contains(url, 'a')",
    "stored_html": "SELECT 'p' || (page_id % 5) AS portal_id, url, ['raw', 'h', 'c'][page_id % 4 + 1] AS html FROM pages WHERE page_id % 4 < 3",
    "rule_file": "SELECT 'title' AS field, count(*) AS tested, count(*) FILTER (trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) <> '') AS successful, successful >= 0.8 * tested AS acceptable, 3 AS version FROM pages UNION ALL SELECT 'links', count(*), count(*) FILTER (len(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*[^<\\s][^<]*</a>')) > 0) AS s, s >= 0.8 * count(*), 3 FROM pages UNION ALL SELECT 'none', count(*), 0, false, 3 FROM pages",
    "backup_restore": "SELECT c_custkey, c_name, true AS refused FROM customer",
    "snapshot_versions": "SELECT 'region' AS name, v AS version, count(*) FILTER (v = 1 OR r_regionkey > 1) AS n_rows, v = 2 AS is_current, true AS refused FROM region, (SELECT unnest([1, 2]) AS v) GROUP BY v UNION ALL SELECT 'nation', v, count(*) FILTER (v = 1 OR n_regionkey > 1), v = 2, true FROM nation, (SELECT unnest([1, 2]) AS v) GROUP BY v",
    "replay_pages": "WITH p AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*', 0) || '/i/' || page_id || '.png' AS u FROM pages) SELECT page_id, '/replay?url=' || replace(replace(replace(u, '%', '%25'), ':', '%3A'), '/', '%2F') AS css_link, true AS data_kept FROM p",
}
