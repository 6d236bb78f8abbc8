"""Navigation graphs and chains of pages.

Traversal expands each node once, along the path by which it was first found, so cycle and duplicate counts depend on that
path; it runs level by level with an anti-join against what is known. Chains (one successor per node) are followed by
pointer doubling: the number of rounds is the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import ordered_fold

# Limits of redirect chains, of gates in a chain, and of gates of one origin.
MAX_REDIRECTS, MAX_GATES, MAX_ORIGIN = 5, 5, 3
MAX_COMPONENT_PAGES = 10


def _stored(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def traverse(edges: DataFrame, roots: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a breadth-first traversal of edges (src, dst, pos) from roots (node).

    nodes: node, depth, path (array, itself last) and order (array of link positions along the path, by which it was
    first found). links: src, dst and `kind` of every link met: NEW, CYCLE (the target stands in the path), TOO_DEEP or
    KNOWN, tested in that order."""
    level = roots.select("node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.array(F.col("node").cast("long")).alias("order") if dict(roots.dtypes)["node"] in ("int", "bigint") else F.array(F.lit(0).cast("long")).alias("order"))
    level = _stored(level)
    nodes, links = level, None
    for depth in range(1, max_depth + 2):
        met = level.join(edges, level["node"] == edges["src"]).select("src", "dst", "pos", F.col("path").alias("_path"), F.col("order").alias("_order"))
        kind = F.when(F.array_contains("_path", F.col("dst")), "CYCLE").when(F.lit(depth > max_depth), "TOO_DEEP")
        known = nodes.select(F.col("node").alias("dst"), F.lit(True).alias("_known"))
        met = met.withColumn("kind", kind).join(known, "dst", "left")
        order = F.concat("_order", F.array(F.col("pos").cast("long")))
        open_ = F.col("kind").isNull() & F.col("_known").isNull()
        first = F.row_number().over(Window.partitionBy("dst", open_).orderBy("_order", "pos", "src")) == 1
        met = _stored(met.withColumn("kind", F.when(F.col("kind").isNotNull(), F.col("kind")).when(open_ & first, "NEW").otherwise("KNOWN")).withColumn("order", order))
        rows = met.select("src", "dst", "kind")
        links = rows if links is None else links.unionByName(rows)
        level = met.filter("kind = 'NEW'").select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("_path", F.array("dst")).alias("path"), "order")
        if level.isEmpty():
            break
        level = _stored(level)
        nodes = nodes.unionByName(level)
    return nodes, links


def depth_first_order(nodes: DataFrame) -> DataFrame:
    """nodes with `rank` in depth-first order below each root. Siblings go in reverse link order, as from a stack: a path of negated positions sorts that way, and a node comes before what lies below it."""
    key = F.transform("order", lambda x: -x)
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy(F.element_at("path", 1)).orderBy(key)))


def reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """node and least depth of what roots (node) reach over edges (src, dst), each level an anti-join against what is known: a recursive query would hold every
    path, and ends with an error beyond a fixed number of rows."""
    seen = level = _stored(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        met = level.join(edges, level["node"] == edges["src"]).select(F.col("dst").alias("node")).filter("node IS NOT NULL").distinct()
        level = _stored(met.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def chains(links: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """Follow `target` from each start: start, path, hops, last and reason, over links (node, target, kind).

    reason: LOOP (the next node stands in the path), TOO_LONG (more than max_hops), else the kind of the last node, or
    MISSING where it has no row. One join a hop, and max_hops is a small constant."""
    walk = starts.select("start", F.array("start").alias("path"), F.col("start").alias("last"), F.lit(None).cast("string").alias("reason"))
    for hop in range(max_hops + 2):
        at = links.select(F.col("node").alias("last"), "target", F.col("kind").alias("_kind"))
        j = walk.join(at, "last", "left")
        going = F.col("reason").isNull()
        end = F.when(F.col("_kind").isNull(), "MISSING").when(F.col("target").isNull(), F.col("_kind")).when(F.array_contains("path", F.col("target")), "LOOP").when(F.lit(hop >= max_hops), "TOO_LONG")
        more = going & end.isNull()
        walk = j.select("start", F.when(more, F.concat("path", F.array("target"))).otherwise(F.col("path")).alias("path"), F.when(more, F.col("target")).otherwise(F.col("last")).alias("last"), F.when(going, end).otherwise(F.col("reason")).alias("reason"))
        if hop % 4 == 3:
            walk = _stored(walk)
    return walk.select("start", "path", (F.size("path") - 1).alias("hops"), "last", "reason")


def logical_articles(pages: DataFrame, article: str, pos: str, next_url: str, url: str, max_pages: int = MAX_COMPONENT_PAGES) -> DataFrame:
    """Per article: its component pages in order, whether complete, and why the chain ended.

    pages holds each article's pages in the order of their links (pos from 1). LAST_PAGE_REACHED: a page without a link
    to a next one; ARTICLE_PAGE_LOOP_DETECTED: a link to a page seen before; PAGE_BUDGET_EXHAUSTED: max_pages read while a
    link goes on; NEXT_PAGE_MISSING: a link to a page that is not there."""
    w = Window.partitionBy(article).orderBy(pos)
    seen = F.collect_list(url).over(w.rowsBetween(Window.unboundedPreceding, 0))
    follows = F.lead(url).over(w)
    end = F.when(F.col(next_url).isNull(), "LAST_PAGE_REACHED").when(F.array_contains(seen, F.col(next_url)), "ARTICLE_PAGE_LOOP_DETECTED").when(F.col(pos) >= max_pages, "PAGE_BUDGET_EXHAUSTED").when(~F.col(next_url).eqNullSafe(follows), "NEXT_PAGE_MISSING")
    marked = pages.withColumn("_end", end)
    before = F.count("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = marked.withColumn("_before", before).filter("_before = 0")
    return kept.groupBy(article).agg(F.count("*").alias("n_pages"), F.max("_end").alias("reason"), (F.max("_end") == "LAST_PAGE_REACHED").alias("complete"))


def thread_prefix(pages: DataFrame, thread: str, page: str, ids: str, next_page: str, max_pages: int) -> DataFrame:
    """Pages of each thread that a crawl keeps: until one without a next link, one that brings no id beyond the first page's, or max_pages."""
    w = Window.partitionBy(thread).orderBy(page)
    first = F.first(ids).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    genuine = (F.row_number().over(w) == 1) | (F.size(F.array_except(F.col(ids), first)) > 0)
    marked = pages.withColumns({"genuine": genuine, "_n": F.row_number().over(w)})
    ended = F.coalesce(F.max((F.col(next_page).isNull() | ~F.col("genuine")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_e", ended).filter((F.col("_e") == 0) & F.col("genuine") & (F.col("_n") <= max_pages)).drop("_e", "_n", "genuine")


def frontier(nodes: DataFrame, depth_first: bool = False) -> DataFrame:
    """root and the most nodes that wait at once, of each root's traversal: after the k-th visit those stand in line whose parent was among the first k, less the k visited."""
    key = F.transform("order", lambda x: -x) if depth_first else F.struct("depth", "order")
    ranked = nodes.select("node", F.element_at("path", 1).alias("root"), F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"), F.row_number().over(Window.partitionBy(F.element_at("path", 1)).orderBy(key)).alias("k"))
    parents = ranked.select("root", F.col("node").alias("parent"), F.col("k").alias("at"))
    children = ranked.filter("parent IS NOT NULL").join(parents, ["root", "parent"]).groupBy("root", F.col("at").alias("k")).agg(F.count("*").alias("n"))
    steps = ranked.select("root", "k").join(children, ["root", "k"], "left")
    waiting = 1 + F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("root").orderBy("k")) - F.col("k")
    return steps.withColumn("w", waiting).groupBy("root").agg(F.greatest(F.max("w"), F.lit(1)).cast("int").alias("max_frontier"))


def traversal_report(nodes: DataFrame, links: DataFrame, articles: DataFrame, n_nodes: int, n_articles: int) -> DataFrame:
    """One row for a traversal: visits, articles found (articles: node, article), both recalls, cycles, known targets, targets too deep, repeated articles."""
    found = articles.join(nodes.select("node"), "node").agg(F.countDistinct("article").alias("n_articles"), (F.count("*") - F.countDistinct("article")).alias("duplicate_articles"))
    kinds = links.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("CYCLE", "cycles"), ("KNOWN", "duplicate_navigation"), ("TOO_DEEP", "depth_limited"))))
    share = lambda n, d: F.round(n / d, 4) if d else F.lit(0.0)
    row = nodes.agg(F.count("*").alias("requests")).crossJoin(F.broadcast(found)).crossJoin(F.broadcast(kinds))
    return row.withColumns({"article_recall": share(F.col("n_articles"), n_articles), "navigation_recall": share(F.col("requests"), n_nodes)})


def child_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Children of a node that a second reading adds, for nodes whose set of children changed. Frames are (node, child)."""
    return after.select("node", "child").distinct().join(before.select("node", "child").distinct(), ["node", "child"], "left_anti")


def hierarchy(posts: DataFrame, levels: list[str]) -> DataFrame:
    """Per value of the first level (a forum's category): how many of each level below it there are, and its rows."""
    below = [F.countDistinct(level).alias(f"n_{level}s") for level in levels[1:]]
    return posts.groupBy(levels[0]).agg(*below, F.count("*").alias("n_posts"))


def provenance(nodes: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct navigation paths of each article, over articles (node, article)."""
    paths = articles.join(nodes, "node").select("article", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")).distinct()
    return paths.groupBy("article").agg(F.count("*").alias("n_paths"), F.array_join(F.array_sort(F.collect_list("path")), " ").alias("paths"))


RESOLVED = "session string, seq long, url string, status string, redirects int, gates int, session_reused boolean, components int, complete boolean, requests int"


#: Rounds after which the parts of a reach are stored as one.
GATHER = 16


def reached(starts: DataFrame, steps: DataFrame, hops: int) -> DataFrame:
    """start and url: what each start reaches over steps (url, target) within hops steps, itself included. Each round follows the steps of what the round before has found
    first, so what is moved and stored follows the starts and not the graph; it ends when nothing new is found."""
    seen = frontier = _stored(starts.select("start", F.col("start").alias("url")).distinct())
    for n in range(1, hops + 1):
        onward = frontier.join(steps.select("url", "target"), "url").select("start", F.col("target").alias("url")).distinct()
        frontier = _stored(onward.join(seen, ["start", "url"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if n % GATHER == 0:
            seen = _stored(seen)
    return seen


def resolve_gates(requests: DataFrame, responses: DataFrame, allowed_hosts: tuple[str, ...], allowed_gates: tuple[str, ...], follow_pages: bool = False) -> DataFrame:
    """Outcome of each request (session, seq, url) against recorded responses, which a session's cookies decide.

    responses: url, in_session (the answer with or without the origin's cookie; null: either), status_code, page_type
    (CONTENT, REDIRECT, GATE), gate_type, interaction, target_url, sets_cookie, next_page_url; URLs are canonical. A session's
    requests share cookies and the origins' interaction counts, so a session is a fold in the order of seq; sessions are
    independent and spread over tasks. With follow_pages an article's next pages are resolved too, each through its gates,
    and status says why the article ended."""
    steps = responses.select("url", F.explode(F.array_compact(F.array("target_url", "next_page_url"))).alias("target")).distinct()
    hops = (MAX_REDIRECTS + MAX_GATES) * (MAX_COMPONENT_PAGES if follow_pages else 1) + 1
    pages = reached(requests.select(F.col("url").alias("start")), steps, hops).join(responses, "url")
    fields = ["url", "in_session", "status_code", "page_type", "gate_type", "interaction", "target_url", "sets_cookie", "next_page_url"]
    by_start = pages.groupBy("start").agg(F.collect_list(F.struct(*fields)).alias("pages"))
    joined = requests.join(by_start, requests["url"] == by_start["start"], "left").select("session", "seq", requests["url"], "pages")

    def step(session: GateSession, r: tuple) -> tuple:
        known: dict[str, list] = {}
        for page in () if r.pages is None else r.pages:
            known.setdefault(page["url"], []).append(page)
        return r.session, r.seq, r.url, *(session.article(r.url, known) if follow_pages else session.one(r.url, known))

    return ordered_fold(joined, "session", "seq", lambda: GateSession(allowed_hosts, allowed_gates), step, RESOLVED)


def _host(url: str) -> str:
    return url.split("://", 1)[-1].split("/", 1)[0].lower()


class GateSession:
    """Cookies and interaction counts of one session."""

    def __init__(self, hosts: tuple[str, ...], allowed: tuple[str, ...]) -> None:
        self.hosts, self.allowed = hosts, allowed
        self.cookies: set[str] = set()
        self.tries: dict[str, int] = {}
        self.redirects = self.gates = self.requests = 0
        self.reused = False

    def _begin(self) -> None:
        self.redirects = self.gates = self.requests = 0
        self.reused = False

    def _answer(self, url: str, known: dict[str, list]) -> dict | None:
        self.requests += 1
        inside = _host(url) in self.cookies
        return next((p for p in known.get(url, ()) if p["in_session"] is None or p["in_session"] == inside), None)

    def resolve(self, url: str, known: dict[str, list]) -> tuple[str, dict | None]:
        """(status, page): content, a failure, a redirect or a gate at a time, in that order."""
        chain, redirects, gates = [url], 0, 0
        while True:
            origin = _host(url)
            if self.hosts and origin not in self.hosts:
                return "OUT_OF_SCOPE_GATE_TARGET", None
            had = origin in self.cookies
            page = self._answer(url, known)
            if page is None:
                return "FETCH_FAILED", None
            kind, target = page["page_type"], page["target_url"]
            if page["sets_cookie"]:
                self.cookies.add(origin)
            if kind == "CONTENT" and page["status_code"] == 200:
                self.reused |= had and page["in_session"] is True
                return "RESOLVED", page
            if page["status_code"] in (403, 404, 500) and kind != "GATE":
                return "FETCH_FAILED", page
            if kind == "REDIRECT" or 300 <= page["status_code"] < 400:
                redirects += 1
                self.redirects += 1
                if redirects > MAX_REDIRECTS:
                    return "REDIRECT_LIMIT_EXCEEDED", page
                if not target or target in chain:
                    return "REDIRECT_LOOP_DETECTED", page
            elif kind == "GATE":
                gates += 1
                self.gates += 1
                fault = self._gate(url, page, gates)
                if fault:
                    return fault, page
                target = target or url
            else:
                return "UNKNOWN_ERROR", page
            url = target
            chain.append(url)

    def _gate(self, url: str, page: dict, gates: int) -> str | None:
        origin = _host(url)
        if gates > MAX_GATES:
            return "GATE_LOOP_DETECTED"
        if page["gate_type"] not in self.allowed:
            return "GATE_BLOCKED"
        if self.tries.get(origin, 0) >= MAX_ORIGIN:
            return "GATE_ORIGIN_BUDGET_EXHAUSTED"
        if page["interaction"] == "UNSUPPORTED":
            return "UNSUPPORTED_GATE"
        self.tries[origin] = self.tries.get(origin, 0) + 1
        return "GATE_LOOP_DETECTED" if (page["target_url"] or url) == url and not page["sets_cookie"] else None

    def _told(self, status: str, components: int, complete: bool) -> tuple:
        return status, self.redirects, self.gates, self.reused, components, complete, self.requests

    def one(self, url: str, known: dict[str, list]) -> tuple:
        self._begin()
        status, _ = self.resolve(url, known)
        return self._told(status, int(status == "RESOLVED"), status == "RESOLVED")

    def article(self, url: str, known: dict[str, list]) -> tuple:
        """The pages of an article from its first on."""
        self._begin()
        seen: list[str] = []
        while True:
            if len(seen) >= MAX_COMPONENT_PAGES:
                return self._told("PAGE_BUDGET_EXHAUSTED", len(seen), False)
            status, page = self.resolve(url, known)
            if status != "RESOLVED":
                return self._told(f"GATE_RESOLUTION_FAILED_{status}", len(seen), False)
            if page["url"] in seen:
                return self._told("ARTICLE_PAGE_LOOP_DETECTED", len(seen), False)
            seen.append(page["url"])
            if not page["next_page_url"]:
                return self._told("LAST_PAGE_REACHED", len(seen), True)
            if page["next_page_url"] in seen:
                return self._told("ARTICLE_PAGE_LOOP_DETECTED", len(seen), False)
            url = page["next_page_url"]


def session_metrics(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("session").agg(F.count("*").alias("n_requests"), F.sum("redirects").alias("n_redirects"), F.sum("gates").alias("n_gates"), F.count_if("session_reused").alias("n_reused"), F.count_if(F.col("status").contains("LOOP")).alias("n_loops"))
