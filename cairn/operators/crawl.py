"""A whole incremental run as one query over recorded pages, articles and probes; and the folds and projections around it."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprints, urls
from ..functions.text import retry_class, retry_delay
from . import observations, snapshot

# Fixed value: attempts after the first.
MAX_RETRIES = 3


@dataclass
class Run:
    """What a run leaves: the pages read, its articles, their classes against the last snapshot, and one row of figures."""

    pages: DataFrame
    articles: DataFrame
    classes: DataFrame
    summary: DataFrame


def page_states(page_log: DataFrame) -> DataFrame:
    """pos, url, status_code, article_urls (canonical), both fingerprints and next_page_url of recorded pages."""
    clean = F.transform(F.filter("article_urls", lambda u: F.coalesce(u, F.lit("")) != ""), lambda u: urls.canonical(u))
    p = page_log.withColumn("article_urls", F.coalesce(clean, F.array().cast("array<string>")))
    return p.withColumns({"ordered_fingerprint": fingerprints.of_list(F.col("article_urls")), "set_fingerprint": fingerprints.of_list_as_set(F.col("article_urls"))})


def incremental_run(page_log: DataFrame, article_log: DataFrame, probes: DataFrame, prev_pages: DataFrame, prev_articles: DataFrame, prev_head: str | None, run_id: str, prev_incomplete: bool = False, max_pages: int = 50) -> Run:
    """page_log: pos, url, status_code, article_urls, next_page_url, in the order of the links. article_log: url, status_code,
    title, published_at, author, content_hash. probes: url, status_code. prev_pages: url, set_fingerprint, next_page_url.
    prev_articles: url, first_seen_run_id, title, published_at, author, content_hash, capture_status, warc_file,
    warc_record_id, status."""
    states = page_states(page_log)
    read = snapshot.visited_pages(states, prev_pages, prev_head, prev_incomplete, max_pages)
    pages = states.join(read.select("url", "outcome"), "url")
    seen = pages.filter("outcome NOT IN ('ACCESS_GATE', 'FETCH_FAILED')").select("pos", F.posexplode("article_urls").alias("place", "url"))
    order = observations.first_seen(seen, "url", ["pos", "place"]).select("url", F.struct("pos", "place").alias("at"))
    fields = ("title", "published_at", "author", "content_hash")
    known = snapshot.carried_over(prev_articles, order, run_id, ("published_at", "author")).withColumnsRenamed({c: f"old_{c}" for c in fields})
    log = article_log.select("url", F.col("status_code").alias("_s"), *fields, F.lit(True).alias("_f"))
    a = known.join(log, "url", "left")
    gone, gated = F.col("_f") & F.col("_s").isin(404, 410), F.col("_f") & F.col("_s").isin(401, 403)
    fine = F.col("_f") & F.coalesce(F.col("_s") == 200, F.lit(True))
    yes = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(yes(gone), "REMOVED").when(yes(F.col("_f") & ~fine & ~gated), "FETCH_FAILED").otherwise(F.col("status"))
    capture = F.when(yes(gone), "REMOVED").when(yes(F.col("_f") & ~fine & ~gated), "FAILED").when(yes(fine) & F.col("content_hash").isNotNull(), "CAPTURED").otherwise(F.col("capture_status"))
    now = lambda c: F.coalesce(F.when(yes(fine), F.col(c)), F.col(f"old_{c}")).alias(c)
    a = a.select("url", status.alias("status"), capture.alias("capture_status"), "first_seen_run_id", "last_seen_run_id", *(now(c) for c in fields), yes(gated).alias("gated"))
    removed = snapshot.confirmed_removals(prev_articles, a, probes).join(prev_articles.select("url", "first_seen_run_id", "title", "content_hash"), "url")
    a = a.unionByName(removed.select("url", "status", F.lit("REMOVED").alias("capture_status"), "first_seen_run_id", F.lit(run_id).alias("last_seen_run_id"), "title", "content_hash"), allowMissingColumns=True)
    classes = snapshot.article_classes(prev_articles, a)
    gates = a.agg(F.coalesce(F.bool_or("gated"), F.lit(False)).alias("article_gate"))
    n_pages = pages.agg(F.count("*").alias("n_pages"), F.count_if(F.col("outcome") == "FETCH_FAILED").alias("n_failed_pages"), F.bool_or(F.col("outcome") == "ACCESS_GATE").alias("gate"), F.bool_or(F.col("outcome") == "BOUNDARY_RECONCILED").alias("reconciled"), F.bool_or((F.col("pos") == 1) & (F.size("article_urls") == 0) & ~F.col("outcome").isin("ACCESS_GATE", "FETCH_FAILED")).alias("empty_head"))
    n_anomalies = F.coalesce(F.col("gate"), F.lit(False)).cast("int") + F.col("article_gate").cast("int") + F.coalesce(F.col("empty_head"), F.lit(False)).cast("int")
    # One row each.
    total = snapshot.summary(classes).crossJoin(F.broadcast(n_pages)).crossJoin(F.broadcast(gates))
    total = total.withColumn("convergence", snapshot.convergence(F.lit(False), n_anomalies, F.col("n_failed_pages"), F.col("n_curr")))
    return Run(pages, a.drop("gated"), classes, total)


def retries(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Of the attempts of each URL (url, attempt from 1, status_code, retry_after, reused) those that happen, with what follows: RETRY, DONE or GIVE_UP, and the delay before the next.

    5xx and failures without a status are repeated, 429 once, all else ends. A reused article costs no request."""
    w = Window.partitionBy("url").orderBy("attempt")
    kind = retry_class(F.col("status_code"))
    a = attempts.withColumn("_k", kind).withColumn("_429", F.sum((F.col("status_code") == 429).cast("int")).over(w))
    again = (F.col("_k") == "RETRIABLE") | ((F.col("_k") == "RETRIABLE_ONCE") & (F.coalesce("_429", F.lit(0)) <= 1))
    a = a.withColumn("next_step", F.when(~again, F.when(F.col("_k") == "RETRIABLE_ONCE", "GIVE_UP").otherwise("DONE")).when(F.col("attempt") > max_retries, "GIVE_UP").otherwise("RETRY"))
    ended = F.coalesce(F.max((F.col("next_step") != "RETRY").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = a.withColumn("_e", ended).filter("_e = 0")
    delay = F.when(F.col("next_step") == "RETRY", retry_delay(F.col("status_code"), F.col("attempt"), F.col("retry_after"))).otherwise(F.lit(0).cast("long"))
    return a.select("url", "attempt", "status_code", "next_step", delay.alias("delay"), F.when(F.coalesce("reused", F.lit(False)), 0).otherwise(1).alias("cost"))


def projected(control: DataFrame, catalogs: DataFrame, runs: DataFrame) -> DataFrame:
    """Per portal the head that the catalogue gets from the committed baseline, unless the catalogue's own is newer. control: portal_id, baseline. catalogs: portal_id, head. runs: portal_id, run_id, started_at."""
    at = lambda c: runs.select("portal_id", F.col("run_id").alias(c), F.col("started_at").alias(f"{c}_at"))
    j = control.join(catalogs, "portal_id", "left").join(at("baseline"), ["portal_id", "baseline"], "left").join(at("head"), ["portal_id", "head"], "left")
    newer = F.coalesce((F.col("head") != F.col("baseline")) & (F.col("head_at") > F.col("baseline_at")), F.lit(False))
    return j.select("portal_id", F.when(F.col("baseline").isNull() | newer, F.col("head")).otherwise(F.col("baseline")).alias("head"), (F.col("baseline").isNotNull() & ~newer).alias("projected"))


def hydrated(control: DataFrame, catalogs: DataFrame) -> DataFrame:
    """The baseline that a new node starts from: the control record's where it has one, else the catalogue's."""
    j = control.select("portal_id", "baseline").join(catalogs.select("portal_id", "head"), "portal_id", "full_outer")
    return j.select("portal_id", F.coalesce("baseline", "head").alias("baseline"), F.when(F.col("baseline").isNotNull(), "CONTROL").when(F.col("head").isNotNull(), "CATALOG").otherwise("NONE").alias("origin"))


def quarantined(ledger: DataFrame, packages: DataFrame, reason: Column) -> DataFrame:
    """ledger with a line for each package that is not valid and not yet listed; nothing is deleted."""
    new = packages.filter(~F.col("is_valid")).select("portal_id", "run_id", reason.alias("reason"))
    return ledger.unionByName(new.join(ledger, ["portal_id", "run_id"], "left_anti"))


def deposit_actions(packages: DataFrame, receipts: DataFrame) -> DataFrame:
    """What a deposit of each package (portal_id, run_id, fingerprint, is_valid) does, given its receipt (portal_id, run_id, package_fingerprint, status) if there is one."""
    r = receipts.select("portal_id", "run_id", "package_fingerprint", F.col("status").alias("_s"), F.lit(True).alias("_r"))
    j = packages.join(r, ["portal_id", "run_id"], "left")
    action = (
        F.when(F.col("_r") & ~F.col("package_fingerprint").eqNullSafe(F.col("fingerprint")), "RECONCILE_CHANGED_PACKAGE")
        .when(F.col("_r") & F.col("_s").isin("VERIFIED", "PUBLISHED"), "RETURN_RECEIPT")
        .when(F.col("_r"), "RESUME_DRAFT")
        .when(F.col("is_valid"), "CREATE_DRAFT")
        .otherwise("REJECT_INVALID_PACKAGE")
    )
    return j.select("portal_id", "run_id", action.alias("action"))


def deposit_record(deposits: DataFrame) -> DataFrame:
    """Repository metadata of deposits (title, description, creators, access, formats, domains, version, run_id)."""
    access = F.lower("access")
    access = F.when(access.isin("open", "embargoed", "restricted", "closed"), access).otherwise("restricted")
    words = F.concat(F.array(F.lit("web-archiving"), F.lit("corpus-linguistics"), F.concat(F.lit("software-version:"), "version")), "domains", "formats")
    return deposits.select("run_id", F.struct("title", F.lit("dataset").alias("upload_type"), "description", F.transform("creators", lambda c: F.struct(c.alias("name"))).alias("creators"), access.alias("access_right"), words.alias("keywords")).alias("metadata"))


def migrations(current: int, steps: dict[int, str], supported: int) -> list[str]:
    """Statements of the versions above `current`, in order; a store newer than supported is an error."""
    if current > supported:
        raise ValueError(f"store has version {current}; {supported} is supported")
    return [steps[v] for v in sorted(steps) if current < v <= supported]


def visit_schedule(log: pd.DataFrame, profile: str, pages: int) -> pd.DataFrame:
    """The visits that a policy makes to a recorded simulator (page, visit_no, urls; a visit that was not recorded repeats the one before).

    INITIAL: each page once in order; then changed pages with their neighbours, and pages seen too seldom, first come first
    served. With ROBUST_HEAD_VERIFIED the head is read again at the end (HEAD_VERIFICATION); if it has changed, it and its
    neighbours follow (RECONCILIATION), and the head once more. The profile bounds the visits of a page and all requests.

    A simulator's log is a few dozen rows; this is the scheduling loop that live crawls run on the driver."""
    most, _, required = observations.PROFILES[profile]
    budget = observations.request_budget(profile, pages)
    recorded = {(r.page, r.visit_no): list(r.urls) for r in log.itertuples(index=False)}
    visits: dict[int, int] = {}
    stable: dict[int, int] = {}
    sets: dict[int, frozenset] = {}
    made: list[tuple] = []

    def visit(page: int, phase: str) -> bool | None:
        """Whether the page changed; None if it may not or cannot be read."""
        number = visits.get(page, 0) + 1
        known = max((v for p, v in recorded if p == page and v <= number), default=None)
        if number > most or known is None or len(made) >= budget:
            return None
        found = frozenset(recorded[page, known])
        changed = page in sets and sets[page] != found
        stable[page] = 1 if page not in sets or changed else stable[page] + 1
        sets[page], visits[page] = found, number
        made.append((len(made) + 1, phase, page, number, sorted(found), changed))
        return changed

    def work(queue: list[int], phase: str, again: bool) -> None:
        while queue and len(made) < budget:
            page = queue.pop(0)
            if visit(page, phase):
                queue += [p for p in (page, page + 1, page - 1) if 1 <= p <= pages and p not in queue]
            if not queue and again:
                again = False
                queue += [p for p in sets if stable[p] < required]

    work(list(range(1, pages + 1)), "INITIAL", True)
    if profile == "ROBUST_HEAD_VERIFIED":
        while visit(1, "HEAD_VERIFICATION"):
            work([1, 2], "RECONCILIATION", False)
    return pd.DataFrame(made, columns=["request_no", "phase", "page", "visit_no", "urls", "changed"])


def visit_schedules(log: DataFrame, profile: str, pages: int) -> DataFrame:
    """`visit_schedule` of every portal of a log (portal_id, page, visit_no, urls); portals spread over tasks, and a portal's log is as small as its simulator."""
    kind = log.schema["portal_id"].dataType.simpleString()

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = visit_schedule(rows, profile, pages)
        made.insert(0, "portal_id", key[0])
        return made.astype({"changed": bool})

    return log.groupBy("portal_id").applyInPandas(one, f"portal_id {kind}, request_no int, phase string, page int, visit_no int, urls array<string>, changed boolean")
