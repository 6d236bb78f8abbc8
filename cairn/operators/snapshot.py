"""What changed between two snapshots of an archive.

Articles: url, status, content_hash, title, published_at, author. Pages: url, ordered_fingerprint,
unordered_fingerprint, next_page_url, previous_page_url. Orders: url, pos. One portal and one run each; a portal column
can be added to `keys` to compare many at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PAGES = 5


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def article_classes(prev: DataFrame, curr: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """keys and `change` of every URL of either snapshot, by one full outer join: NEW, NOT_OBSERVED, REMOVED, FETCH_FAILED, CONTENT_CHANGED, METADATA_CHANGED or UNCHANGED, in that precedence; and whether it is confirmed as removed."""
    cols = ["status", "content_hash", "title", "published_at", "author"]
    p = prev.select(*keys, F.lit(True).alias("_p"), *(F.col(c).alias(f"p_{c}") for c in cols))
    c = curr.select(*keys, F.lit(True).alias("_c"), *(F.col(c).alias(f"c_{c}") for c in cols))
    meta = ["title", "published_at", "author"]
    differs = F.lit(False)
    for m in meta:
        differs |= _blank(f"p_{m}") != _blank(f"c_{m}")
    known = lambda side: F.concat(*(_blank(f"{side}_{m}") for m in meta)) != ""
    content = (_blank("p_content_hash") != "") & (_blank("c_content_hash") != "") & (F.col("p_content_hash") != F.col("c_content_hash"))
    change = (
        F.when(F.col("_p").isNull(), "NEW")
        .when(F.col("_c").isNull(), "NOT_OBSERVED")
        .when(F.col("c_status") == "REMOVED", "REMOVED")
        .when(F.col("c_status") == "FETCH_FAILED", "FETCH_FAILED")
        .when(content, "CONTENT_CHANGED")
        .when(differs & known("p") & known("c"), "METADATA_CHANGED")
        .otherwise("UNCHANGED")
    )
    return p.join(c, list(keys), "full_outer").select(*keys, change.alias("change"), F.coalesce(F.col("c_status") == "REMOVED", F.lit(False)).alias("confirmed_removed"))


def partial_scope(n_prev_pages: int | Column, n_curr_pages: int | Column) -> Column:
    """Whether a run saw too little of the archive to call what it missed missing."""
    p, c = (F.lit(x) if isinstance(x, int) else x for x in (n_prev_pages, n_curr_pages))
    return (c < p) | (c < LEAST_PAGES)


def page_changes(prev: DataFrame, curr: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """keys and `change` of every page of curr: NEW_PAGE, MEMBERSHIP_CHANGED, ORDER_CHANGED, PAGINATION_CHANGED or UNCHANGED. Pages of prev alone are not reported."""
    cols = ["unordered_fingerprint", "ordered_fingerprint", "next_page_url", "previous_page_url"]
    p = prev.select(*keys, F.lit(True).alias("_p"), *(F.col(c).alias(f"p_{c}") for c in cols))
    moved = ~F.col("next_page_url").eqNullSafe(F.col("p_next_page_url")) | ~F.col("previous_page_url").eqNullSafe(F.col("p_previous_page_url"))
    change = (
        F.when(F.col("_p").isNull(), "NEW_PAGE")
        .when(~F.col("unordered_fingerprint").eqNullSafe(F.col("p_unordered_fingerprint")), "MEMBERSHIP_CHANGED")
        .when(~F.col("ordered_fingerprint").eqNullSafe(F.col("p_ordered_fingerprint")), "ORDER_CHANGED")
        .when(moved, "PAGINATION_CHANGED")
        .otherwise("UNCHANGED")
    )
    return curr.join(p, list(keys), "left").select(*keys, change.alias("change"))


def thread_page_changes(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """The forum variant, on the ordered fingerprint alone: NEW_PAGE, UNCHANGED or CHANGED."""
    p = prev.select("url", F.lit(True).alias("_p"), F.col("ordered_fingerprint").alias("_f"))
    change = F.when(F.col("_p").isNull(), "NEW_PAGE").when(F.col("ordered_fingerprint").eqNullSafe(F.col("_f")), "UNCHANGED").otherwise("CHANGED")
    return curr.join(p, "url", "left").select("url", change.alias("change"))


def reordered(prev: DataFrame, curr: DataFrame, portal: str | None = None) -> DataFrame:
    """URLs common to both orders whose place among the common ones differs. Orders are (url, pos[, portal]); with a portal column each portal is its own task's window."""
    keys = [portal] if portal else []
    common = prev.select(*keys, "url", F.col("pos").alias("p")).join(curr.select(*keys, "url", F.col("pos").alias("c")), [*keys, "url"])
    w = Window.partitionBy(*keys)
    ranked = common.select(*keys, "url", F.row_number().over(w.orderBy("p", "url")).alias("i"), F.row_number().over(w.orderBy("c", "url")).alias("j"))
    return ranked.filter("i <> j").select(*keys, "url", F.col("i").alias("prev_place"), F.col("j").alias("curr_place"))


def head_changed(prev: Column, curr: Column) -> Column:
    """Whether two head fingerprints, both known, differ."""
    return F.coalesce((prev != "") & (curr != "") & (prev != curr), F.lit(False))


def summary(classes: DataFrame) -> DataFrame:
    """One row with the number of URLs of each class, and of both snapshots."""
    n = lambda c: F.count_if(F.col("change") == c)
    names = ("NEW", "UNCHANGED", "CONTENT_CHANGED", "METADATA_CHANGED", "NOT_OBSERVED", "FETCH_FAILED", "REMOVED")
    return classes.agg(F.count_if(F.col("change") != "NEW").alias("n_prev"), F.count_if(F.col("change") != "NOT_OBSERVED").alias("n_curr"), *(n(c).alias(f"n_{c.lower()}") for c in names))


def anomalies(classes: DataFrame, n_reordered: DataFrame, first_page_urls: DataFrame) -> DataFrame:
    """One row with three flags. n_reordered and first_page_urls are one-row frames with column n."""
    s = summary(classes).crossJoin(F.broadcast(n_reordered.select(F.col("n").alias("n_reordered")))).crossJoin(F.broadcast(first_page_urls.select(F.col("n").alias("n_first"))))
    common = F.col("n_prev") - F.col("n_not_observed")
    flags = {
        "collapsed": (F.col("n_prev") >= 10) & (F.col("n_curr") < F.col("n_prev") * 0.5),
        "empty_head": F.coalesce(F.col("n_first") == 0, F.lit(False)),
        "massive_reorder": (common >= 10) & (F.col("n_reordered") > common * 0.8),
    }
    out = s.select("n_prev", "n_curr", common.alias("n_common"), "n_reordered", *(v.alias(k) for k, v in flags.items()))
    return out.withColumn("manual_review", F.col("collapsed") | F.col("empty_head") | F.col("massive_reorder"))


def carried_over(prev: DataFrame, curr: DataFrame, run_id: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Current articles with what is known of them from before: first seen, title, hash, archive record, and the columns `more`; a capture made before counts as REUSED."""
    p = prev.select("url", *(F.col(c).alias(f"p_{c}") for c in ("first_seen_run_id", "title", "content_hash", "warc_file", "warc_record_id", "capture_status", *more)), F.lit(True).alias("_p"))
    j = curr.select("url").join(p, "url", "left")
    capture = F.when(F.col("p_capture_status").isin("CAPTURED", "REUSED"), "REUSED").otherwise(F.coalesce("p_capture_status", F.lit("CAPTURED")))
    return j.select("url", F.coalesce("p_first_seen_run_id", F.lit(run_id)).alias("first_seen_run_id"), F.lit(run_id).alias("last_seen_run_id"), F.when(F.col("_p"), "UNCHANGED").otherwise("NEW").alias("status"), capture.alias("capture_status"), *(F.col(f"p_{c}").alias(c) for c in ("title", "content_hash", "warc_file", "warc_record_id", *more)))


def confirmed_removals(prev: DataFrame, curr: DataFrame, probes: DataFrame) -> DataFrame:
    """URLs of prev that curr lacks and whose probe answered 404 or 410; a probe without a status counts as 404."""
    missing = prev.select("url").join(curr.select("url"), "url", "left_anti")
    return missing.join(probes, "url").filter(F.coalesce(F.col("status_code"), F.lit(404)).isin(404, 410)).select("url", F.lit("REMOVED").alias("status"))


def visited_pages(pages: DataFrame, prev: DataFrame, prev_head: str | None, prev_incomplete: bool, max_pages: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pages that an incremental crawl reads, from the page log (pos from 1, url, status_code, set_fingerprint, next_page_url).

    It ends at an access gate; at an unchanged head, unless the last run was cut short; at a later page that equals its
    former self; or at max_pages completed ones. A failed page is read but not counted. Column `outcome` says what each
    page did; the page at which the crawl ends is included. With keys (a portal's, say) many logs are cut at once, each a
    window of its own; prev_head is then a column prev_head of pages."""
    head = F.col("prev_head") if keys else F.lit(prev_head)
    p = prev.select(*keys, "url", F.col("set_fingerprint").alias("p_set"), F.col("next_page_url").alias("p_next"), F.lit(True).alias("_p"))
    j = pages.join(p, [*keys, "url"], "left")
    failed = F.coalesce(F.col("status_code") != 200, F.lit(False))
    gate = F.col("status_code").isin(401, 403)
    same_next = F.col("_p").isNotNull() & F.col("next_page_url").eqNullSafe(F.col("p_next"))
    head_same = (F.col("pos") == 1) & head.isNotNull() & F.lit(not prev_incomplete) & same_next & F.col("set_fingerprint").eqNullSafe(head)
    match = (F.col("pos") > 1) & same_next & (F.col("set_fingerprint") == F.col("p_set"))
    outcome = F.when(gate, "ACCESS_GATE").when(failed, "FETCH_FAILED").when(head_same | match, "BOUNDARY_RECONCILED").otherwise("COMPLETE")
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("outcome", outcome)
    ended = F.coalesce(F.max(F.col("outcome").isin("ACCESS_GATE", "BOUNDARY_RECONCILED").cast("int")).over(w), F.lit(0))
    dead = F.coalesce(F.max((F.col("outcome") == "FETCH_FAILED").cast("int")).over(w), F.lit(0))
    counted = F.coalesce(F.sum((~F.col("outcome").isin("ACCESS_GATE", "FETCH_FAILED")).cast("int")).over(w), F.lit(0))
    # The link to the next page is read from the page itself, so a failed page ends the chain too.
    return j.withColumns({"_e": ended, "_d": dead, "_n": counted}).filter((F.col("_e") == 0) & (F.col("_d") == 0) & (F.col("_n") < max_pages)).select(*keys, "pos", "url", "outcome")


def convergence(budget_exhausted: Column, n_anomalies: Column, n_errors: Column, n_articles: Column) -> Column:
    return F.when(budget_exhausted, "BUDGET_EXHAUSTED").when(n_anomalies > 0, "MANUAL_REVIEW_REQUIRED").when((n_errors > 0) & (n_articles == 0), "FAILED").otherwise("CONVERGED")
