"""Queries on observation logs, run tables and graphs, derived from the driver's tables; each has its twin in DuckDB's SQL unless it is a fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, ledger, observations

ROOTS = "EUROPE"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _visits(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("page"), "ts", F.col("event_type").alias("set_fp"), F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("ordered_fp"))


def stability_islands(spark, d):
    s = observations.stability(_visits(spark, d), "page", ["ts", "event_id"], "set_fp", "ordered_fp")
    return s.select("event_id", "page", "visit_no", "change_type", "stable_count", "is_stable")


_ISLANDS = """v AS (SELECT event_id, user_id AS page, ts, event_type AS s, event_type || (event_id % 2) AS o FROM events),
m AS (SELECT *, row_number() OVER w AS visit_no, CASE WHEN row_number() OVER w = 1 THEN 'FIRST_VISIT' WHEN s <> lag(s) OVER w THEN 'ARTICLE_SET_CHANGED' WHEN o <> lag(o) OVER w THEN 'ORDER_CHANGED_ONLY' ELSE 'NO_CHANGE' END AS change_type FROM v WINDOW w AS (PARTITION BY page ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN change_type IN ('FIRST_VISIT', 'ARTICLE_SET_CHANGED') THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY ts, event_id) AS island FROM m),
st AS (SELECT event_id, page, ts, visit_no::INT AS visit_no, change_type, (row_number() OVER (PARTITION BY page, island ORDER BY ts, event_id))::INT AS stable_count FROM i)"""


def visit_budget(spark, d):
    b = observations.within_budget(_visits(spark, d), ["ts", "event_id"], 20, ["page"])
    return b.select("event_id", "page", "request_no", "exhausted")


def request_phases(spark, d):
    phase = F.element_at(F.array(*map(F.lit, ("INITIAL", "HEAD_VERIFICATION", "RECONCILIATION", "FINAL_VERIFICATION"))), (F.col("event_id") % 4 + 1).cast("int"))
    return observations.by_phase(_visits(spark, d).withColumn("phase", phase), ["page"], "phase")


def convergence(spark, d):
    s = observations.stability(_visits(spark, d), "page", ["ts", "event_id"], "set_fp")
    last = ledger.latest(s, ["page"], [F.desc("ts"), F.desc("event_id")]).withColumn("portal", F.col("page") % 50)
    return observations.converged(last, ["portal"], F.col("visit_no") > 40, F.lit(True))


def head_verification(spark, d):
    """Each page as the head of a portal of its own, read again after the first hundred requests."""
    return observations.heads_verified(_visits(spark, d), "page", ["ts", "event_id"], "set_fp", F.col("event_id") > 100)


def boundary_revisits(spark, d):
    s = observations.stability(_visits(spark, d), "page", ["ts", "event_id"], "set_fp")
    changed = s.filter("change_type = 'ARTICLE_SET_CHANGED'").select("page").distinct()
    return observations.revisits(changed, "page", s.groupBy("page").agg(F.count("*").alias("n")), 67)


def retry_summary(spark, d):
    e = _t(spark, d, "events").select((F.col("event_id") % 4).alias("attempt"), F.element_at(F.array(*map(F.lit, (200, 429, 503, 404, 401))), (F.col("event_id") % 5 + 1).cast("int")).alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 90).alias("retry_after"))
    e = e.withColumns({"reason": text.retry_class(F.col("status")), "delay": text.retry_delay(F.col("status"), F.col("attempt"), F.col("retry_after"))})
    return e.groupBy("reason").agg(F.count("*").alias("n"), F.sum("delay").alias("total_delay"), F.max("delay").alias("longest"))


def recall_precision(spark, d):
    labels = _t(spark, d, "labels")
    return observations.recall(labels.filter("quality = 1 AND doc_id % 3 <> 0").select("doc_id"), labels.filter("toxic = 0").select("doc_id"), "doc_id")


def _runs(spark, d):
    o = _t(spark, d, "orders")
    status = F.element_at(F.array(*map(F.lit, ("RUNNING", "CONVERGED", "FAILED", "FINALIZING", "COMPLETED", "INTERRUPTED"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select((F.col("o_custkey") % 100).alias("portal_id"), F.col("o_orderkey").alias("run_id"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"))


_RUNS = "runs AS (SELECT o_custkey % 100 AS portal_id, o_orderkey AS run_id, ['RUNNING', 'CONVERGED', 'FAILED', 'FINALIZING', 'COMPLETED', 'INTERRUPTED'][o_orderkey % 6 + 1] AS status, strftime(o_orderdate, '%Y-%m-%d') AS started_at FROM orders)"


def run_catalog(spark, d):
    return ledger.pointers(_runs(spark, d), ["portal_id"], "status", "run_id", "run_id").withColumn("pointer", F.col("pointer").cast("string"))


def runs_by_status(spark, d):
    return ledger.with_status(_runs(spark, d), ["FAILED", "INTERRUPTED"], [F.desc("started_at"), F.col("run_id")], 100)


def interrupted_runs(spark, d):
    return ledger.interrupted(_runs(spark, d)).orderBy("started_at", "run_id")


def recovered_runs(spark, d):
    return ledger.recovered(_runs(spark, d), F.col("run_id") % 5 == 0, F.col("run_id") % 7 != 0).select("run_id", "recovered_status")


def latest_state(spark, d):
    o = _t(spark, d, "orders")
    last = ledger.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    known = o.groupBy("o_custkey").agg(F.max_by(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.when(F.col("o_orderstatus") != "P", F.struct("o_orderdate", "o_orderkey"))).alias("last_status"), F.count("*").alias("n_observations"))
    return last.select("o_custkey", F.col("o_orderkey").alias("last_order")).join(known, "o_custkey")


def upsert_merge(spark, d):
    o = _t(spark, d, "orders")
    base = o.filter("o_orderkey % 3 <> 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_run"), F.max("o_orderkey").alias("last_run"), F.max("o_orderpriority").alias("title"), F.count("*").alias("observation_count"))
    delta = o.filter("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("first_run"), F.col("o_orderkey").alias("last_run"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("title"), F.col("o_orderkey").alias("seq"))
    return ledger.upsert(base, delta, ["o_custkey"], {"first_run": "keep", "last_run": "replace", "title": "coalesce", "observation_count": "count"}, "seq")


_UPSERT = """WITH base AS (SELECT o_custkey, min(o_orderkey) AS first_run, max(o_orderkey) AS last_run, max(o_orderpriority) AS title, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
delta AS (SELECT o_custkey, min(o_orderkey) AS first_run, max(o_orderkey) AS last_run, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS title, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT coalesce(b.o_custkey, d.o_custkey) AS o_custkey, coalesce(b.first_run, d.first_run) AS first_run, coalesce(d.last_run, b.last_run) AS last_run, coalesce(d.title, b.title) AS title, coalesce(b.n, 0) + coalesce(d.n, 0) AS observation_count FROM base b FULL JOIN delta d ON b.o_custkey = d.o_custkey"""


def registry_state(spark, d):
    p = _t(spark, d, "pages").select("url", F.lit("PENDING").alias("capture_status"), F.lit(None).cast("int").alias("http_status")).dropDuplicates(["url"])
    ev = _t(spark, d, "pages").select("url", F.col("page_id").alias("seq"), F.when(F.col("page_id") % 3 == 0, "FAILURE").otherwise("SUCCESS").alias("outcome"), F.when(F.col("page_id") % 3 == 0, 500).otherwise(200).alias("http_status"), F.lit("timeout").alias("error")).filter("page_id % 4 <> 0")
    return ledger.registry_after(p, ev).withColumn("http_status", F.col("http_status").cast("string"))


def cascade_delete(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return ledger.cascade(c, o, ["o_custkey"], c.filter("o_custkey % 4 = 0")).select("o_orderkey", "o_custkey")


def restricted_delete(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return ledger.restricted(o, ["o_custkey"], c.filter("o_custkey % 4 = 0"))


def _edges(spark, d):
    r, n = _t(spark, d, "region"), _t(spark, d, "nation")
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    node = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    e = n.select(node("r", F.col("n_regionkey")).alias("src"), node("n", F.col("n_nationkey")).alias("dst"), F.col("n_nationkey").cast("long").alias("pos"))
    e = e.unionByName(c.select(node("n", F.col("c_nationkey")).alias("src"), node("c", F.col("c_custkey")).alias("dst"), F.col("c_custkey").alias("pos")))
    e = e.unionByName(o.select(node("c", F.col("o_custkey")).alias("src"), node("o", F.col("o_orderkey")).alias("dst"), F.col("o_orderkey").alias("pos")))
    back = n.select(node("n", F.col("n_nationkey")).alias("src"), node("r", F.col("n_regionkey")).alias("dst"), F.lit(0).cast("long").alias("pos"))
    return e.unionByName(back), r.select(node("r", F.col("r_regionkey")).alias("node"))


_EDGES = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey::BIGINT AS pos FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation),
tree AS (SELECT 'r' || r_regionkey AS node, 0 AS depth, ['r' || r_regionkey] AS path, [0::BIGINT] AS ord FROM region
 UNION ALL SELECT e.dst, t.depth + 1, list_append(t.path, e.dst), list_append(t.ord, e.pos) FROM tree t JOIN edges e ON e.src = t.node WHERE t.depth < 2 AND NOT list_contains(t.path, e.dst))"""


def nav_bfs(spark, d):
    nodes, _ = graph.traverse(*_edges(spark, d), 2)
    return nodes.select("node", "depth", F.array_join("path", ">").alias("path"))


def nav_link_kinds(spark, d):
    _, links = graph.traverse(*_edges(spark, d), 2)
    return links.groupBy("kind").agg(F.count("*").alias("n"))


def nav_dfs_order(spark, d):
    nodes, _ = graph.traverse(*_edges(spark, d), 2)
    return graph.depth_first_order(nodes).select(F.element_at("path", 1).alias("root"), "node", "depth", "rank")


def nav_reach(spark, d):
    return graph.reach(*_edges(spark, d), 3)


def provenance_paths(spark, d):
    nodes, _ = graph.traverse(*_edges(spark, d), 2)
    o = _t(spark, d, "orders")
    articles = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), (F.col("o_orderkey") % 500).alias("article"))
    return graph.provenance(nodes, articles).select("article", "n_paths", F.md5("paths").alias("paths_md5"))


def redirect_chains(spark, d):
    p = _t(spark, d, "pages").select("page_id")
    n = p.count()
    target = (F.col("page_id") * 7 + 3) % n
    links = p.select(F.col("page_id").alias("node"), F.when(F.col("page_id") % 5 > 0, target).alias("target"), F.when(F.col("page_id") % 5 == 0, "CONTENT").otherwise("REDIRECT").alias("kind"))
    out = graph.chains(links, p.select(F.col("page_id").alias("start")), graph.MAX_REDIRECTS)
    return out.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "last", "reason")


_CHAINS = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), l AS (SELECT page_id AS node, CASE WHEN page_id % 5 > 0 THEN (page_id * 7 + 3) % n.n END AS target FROM pages, n),
w AS (SELECT page_id AS start, [page_id] AS path, page_id AS last FROM pages
 UNION ALL SELECT w.start, list_append(w.path, l.target), l.target FROM w JOIN l ON l.node = w.last WHERE l.target IS NOT NULL AND NOT list_contains(w.path, l.target) AND len(w.path) <= 5),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(path) DESC) = 1)
SELECT f.start, array_to_string(f.path, '>') AS path, (len(f.path) - 1)::INT AS hops, f.last, CASE WHEN l.node IS NULL THEN 'MISSING' WHEN l.target IS NULL THEN 'CONTENT' WHEN list_contains(f.path, l.target) THEN 'LOOP' ELSE 'TOO_LONG' END AS reason FROM f LEFT JOIN l ON l.node = f.last"""


def gate_sessions(spark, d):
    """Sessions of requests against pages that redirect or stand behind gates; a fold per session."""
    p = _t(spark, d, "pages").select("page_id")
    n = p.count()
    url = lambda c: F.concat(F.lit("https://h"), (c % 3).cast("string"), F.lit(".example/"), c.cast("string"))
    i = F.col("page_id")
    kind = F.when(i % 4 == 0, "GATE").when(i % 4 == 1, "REDIRECT").otherwise("CONTENT")
    responses = p.select(url(i).alias("url"), F.when(i % 11 == 2, 404).otherwise(200).alias("status_code"), kind.alias("page_type"), F.when(i % 8 == 0, "AGE_CONFIRMATION").otherwise("LOGIN").alias("gate_type"), F.when(i % 4 < 2, url((i * 3 + 1) % n)).alias("target_url"), (i % 3 == 0).alias("sets_cookie"), F.lit(None).cast("boolean").alias("in_session"), F.lit("CONFIRM").alias("interaction"), F.when(i % 6 == 2, url(i + 1)).alias("next_page_url"))
    requests = p.select(F.concat(F.lit("s"), (i % 20).cast("string")).alias("session"), i.alias("seq"), url(i).alias("url"))
    return graph.session_metrics(graph.resolve_gates(requests, responses, (), ("AGE_CONFIRMATION",)))


#: The sessions as a recursion over the pages that each request comes to; a session goes on with its next request where one ends.
_GATES = f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), rq AS (SELECT page_id % 20 AS s, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS k, page_id AS x FROM pages),
p AS (SELECT page_id AS x, (page_id * 3 + 1) % n AS target FROM pages, n),
w AS (SELECT s, k, x, [x] AS chain, 0 AS r, 0 AS g, [0, 0, 0] AS tries, 0 AS red, 0 AS gat, 0 AS loops FROM rq WHERE k = 1
 UNION ALL SELECT s, k + (NOT goes)::INT, CASE WHEN goes THEN target ELSE following END, CASE WHEN goes THEN list_append(chain, target) ELSE [following] END, CASE WHEN goes THEN r ELSE 0 END, CASE WHEN goes THEN g ELSE 0 END,
  [tries[1] + (passes AND x % 3 = 0)::INT, tries[2] + (passes AND x % 3 = 1)::INT, tries[3] + (passes AND x % 3 = 2)::INT], red + is_hop::INT, gat + is_gate::INT, loops + (NOT goes AND ((is_hop AND r <= {graph.MAX_REDIRECTS}) OR (is_gate AND g > {graph.MAX_GATES}) OR passes))::INT
 FROM (SELECT *, (is_hop AND r <= {graph.MAX_REDIRECTS} AND NOT list_contains(chain, target)) OR (passes AND (target <> x OR x % 3 = 0)) AS goes
 FROM (SELECT *, is_gate AND g <= {graph.MAX_GATES} AND x % 8 = 0 AND tries[x % 3 + 1] < {graph.MAX_ORIGIN} AS passes
 FROM (SELECT w.* EXCLUDE (r, g), w.r + (p.x IS NOT NULL AND w.x % 4 = 1 AND w.x % 11 <> 2)::INT AS r, w.g + (p.x IS NOT NULL AND w.x % 4 = 0)::INT AS g, p.x IS NOT NULL AND w.x % 4 = 1 AND w.x % 11 <> 2 AS is_hop, p.x IS NOT NULL AND w.x % 4 = 0 AS is_gate, p.target, q.x AS following
  FROM w LEFT JOIN p ON p.x = w.x LEFT JOIN rq q ON q.s = w.s AND q.k = w.k + 1 WHERE w.x IS NOT NULL))))
SELECT 's' || s AS session, (k - 1)::BIGINT AS n_requests, red::BIGINT AS n_redirects, gat::BIGINT AS n_gates, 0::BIGINT AS n_reused, loops::BIGINT AS n_loops FROM w WHERE x IS NULL"""


def _turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("h")).dropDuplicates(["conv_id", "turn"])


def thread_pages(spark, d):
    pages = _turns(spark, d).groupBy("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("page")).agg(F.array_sort(F.collect_set("h")).alias("ids"))
    pages = pages.withColumn("next_page", F.when((F.col("conv_id") + F.col("page")) % 3 > 0, F.col("page") + 1))
    kept = graph.thread_prefix(pages, "conv_id", "page", "ids", "next_page", 3)
    return kept.select("conv_id", "page", F.size("ids").alias("n_ids"))


_THREADS = """WITH t AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, md5(text) AS h FROM conversations),
p AS (SELECT conv_id, turn // 2 AS page, list_sort(list_distinct(list(h))) AS ids FROM t GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER w AS n, first_value(ids) OVER w AS first, (conv_id + page) % 3 = 0 AS stops FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY page)),
g AS (SELECT *, (n = 1 OR len(list_filter(ids, lambda x: NOT list_contains(first, x))) > 0) AS genuine FROM q),
e AS (SELECT *, coalesce(max(CASE WHEN stops OR NOT genuine THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM g)
SELECT conv_id, page::BIGINT AS page, len(ids)::INT AS n_ids FROM e WHERE ended = 0 AND genuine AND n <= 3"""


def logical_articles(spark, d):
    t = _turns(spark, d)
    w = "row_number() OVER (PARTITION BY conv_id ORDER BY turn)"
    t = t.selectExpr("conv_id", "turn", f"{w} AS pos", "lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS following")
    t = t.withColumn("next_turn", F.when((F.col("conv_id") % 7 == 0) & (F.col("pos") == 3), F.col("turn") - 1).when((F.col("conv_id") % 11 == 0) & F.col("following").isNull(), F.col("turn") + 100).otherwise(F.col("following")))
    return graph.logical_articles(t, "conv_id", "pos", "next_turn", "turn", 4)


_LOGICAL = """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations),
n AS (SELECT conv_id, turn, row_number() OVER w AS pos, lead(turn) OVER w AS f FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT *, CASE WHEN conv_id % 7 = 0 AND pos = 3 THEN turn - 1 WHEN conv_id % 11 = 0 AND f IS NULL THEN turn + 100 ELSE f END AS nt FROM n),
e AS (SELECT *, CASE WHEN nt IS NULL THEN 'LAST_PAGE_REACHED' WHEN EXISTS (SELECT 1 FROM x y WHERE y.conv_id = x.conv_id AND y.pos <= x.pos AND y.turn = x.nt) THEN 'ARTICLE_PAGE_LOOP_DETECTED' WHEN pos >= 4 THEN 'PAGE_BUDGET_EXHAUSTED' WHEN nt IS DISTINCT FROM f THEN 'NEXT_PAGE_MISSING' END AS r FROM x),
k AS (SELECT *, count(r) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)
SELECT conv_id, count(*) AS n_pages, max(r) AS reason, max(r) = 'LAST_PAGE_REACHED' AS complete FROM k WHERE b = 0 GROUP BY conv_id"""


def new_posts(spark, d):
    """Posts of each thread that its baseline (the even conversations' turns) did not have."""
    t = _turns(spark, d).select(F.col("conv_id").alias("node"), F.col("h").alias("child"))
    return graph.child_changes(t.join(_turns(spark, d).filter("turn % 2 = 0").select(F.col("conv_id").alias("node"), F.col("h").alias("child")), ["node", "child"], "left_semi"), t)


def forum_hierarchy(spark, d):
    """Posts, topics and pages per category: category, page, topic, post as four levels."""
    c = _t(spark, d, "conversations").select((F.col("conv_id") % 9).alias("category"), (F.col("conv_id") % 9 * 100 + F.col("conv_id") % 3).alias("page"), F.col("conv_id").alias("topic"), "turn")
    return graph.hierarchy(c, ["category", "page", "topic"])


def registry_by_status(spark, d):
    """Registered URLs whose capture failed, in the order of their registration."""
    state = registry_state(spark, d)
    seq = _t(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("seq"))
    return ledger.with_status(state.join(seq, "url").withColumnRenamed("capture_status", "status"), ["FAILED"], [F.col("seq")], 50).select("url", "status", "error", "seq")


QUERIES = {f.__name__: f for f in (stability_islands, visit_budget, request_phases, convergence, head_verification, boundary_revisits, retry_summary, recall_precision, run_catalog, runs_by_status, interrupted_runs, recovered_runs, latest_state, upsert_merge, registry_state, cascade_delete, restricted_delete, nav_bfs, nav_link_kinds, nav_dfs_order, nav_reach, provenance_paths, redirect_chains, gate_sessions, thread_pages, logical_articles, new_posts, forum_hierarchy, registry_by_status)}

ORACLES = {
    "stability_islands": f"WITH {_ISLANDS} SELECT event_id, page, visit_no, change_type, stable_count, stable_count >= 2 AS is_stable FROM st",
    "visit_budget": "WITH r AS (SELECT event_id, user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_id, page, n::INT AS request_no, n > 20 AS exhausted FROM r WHERE n <= 21",
    "request_phases": "SELECT user_id AS page, count(*) FILTER (event_id % 4 = 0) AS n_initial, count(*) FILTER (event_id % 4 IN (1, 3)) AS n_head, count(*) FILTER (event_id % 4 = 2) AS n_reconciliation, count(*) AS n_requests FROM events GROUP BY user_id",
    "convergence": f"WITH {_ISLANDS}, last AS (SELECT *, page % 50 AS portal FROM st QUALIFY row_number() OVER (PARTITION BY page ORDER BY ts DESC, event_id DESC) = 1) SELECT portal, count(*) AS n_pages, count(*) FILTER (stable_count >= 2) AS n_stable, (bool_and(stable_count >= 2) AND NOT bool_or(visit_no > 40)) AS converged FROM last GROUP BY portal",
    "head_verification": "WITH h AS (SELECT user_id AS page, event_id, ts, event_type AS s FROM events WHERE event_id > 100), i AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY page ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM h), g AS (SELECT *, sum(c) OVER (PARTITION BY page ORDER BY ts, event_id) AS island FROM i), n AS (SELECT *, row_number() OVER (PARTITION BY page, island ORDER BY ts, event_id) AS k FROM g), v AS (SELECT page, arg_max(k, (ts, event_id)) >= 2 AS ok, count(*) AS n FROM n GROUP BY page) SELECT p.page, coalesce(v.ok, false) AS head_verified, coalesce(v.n, 0) AS head_visits FROM (SELECT DISTINCT user_id AS page FROM events) p LEFT JOIN v USING (page)",
    "boundary_revisits": f"WITH {_ISLANDS}, ch AS (SELECT DISTINCT page FROM st WHERE change_type = 'ARTICLE_SET_CHANGED'), near AS (SELECT page FROM ch UNION SELECT page + 1 FROM ch UNION SELECT page - 1 FROM ch WHERE page > 1) SELECT page FROM near WHERE page IN (SELECT page FROM st GROUP BY page HAVING count(*) < 67)",
    "retry_summary": "WITH e AS (SELECT event_id % 4 AS a, [200, 429, 503, 404, 401][event_id % 5 + 1] AS s, CASE WHEN event_id % 2 = 0 THEN event_id % 90 END AS ra FROM events), c AS (SELECT CASE WHEN s >= 500 THEN 'RETRIABLE' WHEN s = 429 THEN 'RETRIABLE_ONCE' WHEN s = 200 THEN 'OK' ELSE 'TERMINAL' END AS reason, CASE WHEN s = 429 THEN least(coalesce(ra, 30), 60) ELSE (2 ** a)::BIGINT END AS delay FROM e) SELECT reason, count(*) AS n, sum(delay)::BIGINT AS total_delay, max(delay) AS longest FROM c GROUP BY reason",
    "recall_precision": "WITH f AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id % 3 <> 0), t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0), n AS (SELECT (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM f JOIN t USING (doc_id)) AS n_both) SELECT *, round(n_both / n_truth, 4) AS recall, round(n_both / n_found, 4) AS precision FROM n",
    "run_catalog": f"WITH {_RUNS} SELECT portal_id, count(*) AS n_runs, count(*) FILTER (status IN ('CONVERGED', 'COMPLETED')) AS n_successful, (max(run_id) FILTER (status IN ('CONVERGED', 'COMPLETED')))::VARCHAR AS pointer FROM runs GROUP BY portal_id",
    "runs_by_status": f"WITH {_RUNS} SELECT * FROM runs WHERE status IN ('FAILED', 'INTERRUPTED') ORDER BY started_at DESC, run_id LIMIT 100",
    "interrupted_runs": f"WITH {_RUNS} SELECT * FROM runs WHERE status IN ('RUNNING', 'FINALIZING')",
    "recovered_runs": f"WITH {_RUNS} SELECT run_id, CASE WHEN status = 'RUNNING' THEN 'INTERRUPTED' WHEN status = 'FINALIZING' THEN CASE WHEN run_id % 5 = 0 THEN 'CONVERGED' WHEN run_id % 7 = 0 THEN 'FAILED' ELSE 'MANUAL_REVIEW_REQUIRED' END ELSE status END AS recovered_status FROM runs",
    "latest_state": "WITH l AS (SELECT o_custkey, o_orderkey AS last_order FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), k AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS last_status, count(*) AS n_observations FROM orders GROUP BY 1) SELECT * FROM l JOIN k USING (o_custkey)",
    "upsert_merge": _UPSERT,
    "registry_state": "WITH e AS (SELECT url, page_id % 3 = 0 AS failed FROM pages WHERE page_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1) SELECT p.url, CASE WHEN failed IS NULL THEN 'PENDING' WHEN failed THEN 'FAILED' ELSE 'CAPTURED' END AS capture_status, CASE WHEN failed THEN '500' WHEN NOT failed THEN '200' END AS http_status, CASE WHEN failed THEN 'timeout' END AS error FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN e USING (url)",
    "cascade_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_custkey % 4 = 0 AND o_custkey IN (SELECT c_custkey FROM customer))",
    "restricted_delete": "SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey % 4 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
    "nav_bfs": f"WITH RECURSIVE {_EDGES} SELECT node, depth, array_to_string(path, '>') AS path FROM tree",
    "nav_link_kinds": f"WITH RECURSIVE {_EDGES}, met AS (SELECT t.depth + 1 AS depth, list_contains(t.path, e.dst) AS cyc FROM tree t JOIN edges e ON e.src = t.node) SELECT CASE WHEN cyc THEN 'CYCLE' WHEN depth > 2 THEN 'TOO_DEEP' ELSE 'NEW' END AS kind, count(*) AS n FROM met GROUP BY 1",
    "nav_dfs_order": f"WITH RECURSIVE {_EDGES} SELECT path[1] AS root, node, depth, (row_number() OVER (PARTITION BY path[1] ORDER BY list_transform(ord, lambda x: -x)))::INT AS rank FROM tree",
    "nav_reach": f"WITH RECURSIVE {_EDGES.replace('t.depth < 2', 't.depth < 3')} SELECT node, min(depth) AS depth FROM tree GROUP BY node",
    "provenance_paths": f"WITH RECURSIVE {_EDGES}, a AS (SELECT DISTINCT o_orderkey % 500 AS article, array_to_string(t.path, '>') AS path FROM orders JOIN tree t ON t.node = 'c' || o_custkey) SELECT article, count(*) AS n_paths, md5(string_agg(path, ' ' ORDER BY path)) AS paths_md5 FROM a GROUP BY article",
    "redirect_chains": _CHAINS,
    "gate_sessions": _GATES,
    "thread_pages": _THREADS,
    "logical_articles": _LOGICAL,
    "new_posts": "WITH t AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, md5(text) AS h FROM conversations) SELECT DISTINCT conv_id AS node, h AS child FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.conv_id = t.conv_id AND u.h = t.h AND u.turn % 2 = 0)",
    "registry_by_status": "WITH e AS (SELECT url, page_id % 3 = 0 AS failed FROM pages WHERE page_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1), s AS (SELECT url, min(page_id) AS seq FROM pages GROUP BY url) SELECT url, 'FAILED' AS status, 'timeout' AS error, seq FROM e JOIN s USING (url) WHERE failed ORDER BY seq LIMIT 50",
    "forum_hierarchy": "SELECT conv_id % 9 AS category, count(DISTINCT conv_id % 9 * 100 + conv_id % 3) AS n_pages, count(DISTINCT conv_id) AS n_topics, count(*) AS n_posts FROM conversations GROUP BY 1",
}
