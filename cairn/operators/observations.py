"""The observation log of archive pages: visits, stability, ledgers, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Profile -> (visits a page, requests for p pages as (factor, extra), stable observations required).
PROFILES = {"NAIVE": (1, (1, 2), 1), "PRECISION": (2, (3, 0), 2), "ROBUST": (4, (5, 0), 2), "ROBUST_HEAD_VERIFIED": (5, (6, 0), 2)}


def request_budget(profile: str, pages: int) -> int:
    factor, extra = PROFILES[profile][1]
    return factor * pages + extra


def stability(obs: DataFrame, page: str, order: Sequence[str], set_fp: str, ordered_fp: str | None = None, required: int = 2) -> DataFrame:
    """obs with visit_no, change_type, stable_count and is_stable.

    The count starts at 1, grows while the set stays the same (a change of order alone does not matter) and starts again
    when it changes: islands of equal sets in each page's visits. A page is stable once the count reaches `required`."""
    w = Window.partitionBy(page).orderBy(*order)
    before = F.lag(set_fp).over(w)
    first = F.row_number().over(w) == 1
    changed = ~F.col(set_fp).eqNullSafe(before)
    kind = F.when(first, "FIRST_VISIT").when(changed, "ARTICLE_SET_CHANGED")
    if ordered_fp:
        kind = kind.when(~F.col(ordered_fp).eqNullSafe(F.lag(ordered_fp).over(w)), "ORDER_CHANGED_ONLY")
    marked = obs.withColumns({"visit_no": F.row_number().over(w), "change_type": kind.otherwise("NO_CHANGE")})
    marked = marked.withColumn("_island", F.sum(F.col("change_type").isin("FIRST_VISIT", "ARTICLE_SET_CHANGED").cast("int")).over(w))
    inside = Window.partitionBy(page, "_island").orderBy(*order)
    return marked.withColumn("stable_count", F.row_number().over(inside)).withColumn("is_stable", F.col("stable_count") >= required).drop("_island")


def head_verified(obs: DataFrame, page: str, head: Column, order: Sequence[str], set_fp: str, after: Column, required: int = 2) -> DataFrame:
    """One row: whether the head's last run of equal sets, among its visits after the traversal, has the required length."""
    seen = stability(obs.filter((F.col(page) == head) & after), page, order, set_fp, required=required)
    last = F.max_by("stable_count", F.struct(*order))
    return seen.agg(F.coalesce(last >= required, F.lit(False)).alias("head_verified"), F.count("*").alias("head_visits"))


def heads_verified(obs: DataFrame, portal: str, order: Sequence[str], set_fp: str, after: Column, required: int = 2) -> DataFrame:
    """`head_verified` of every portal, whose observations are those of its head: portal, head_verified, head_visits; a portal without visits after its traversal has none and is not verified."""
    seen = stability(obs.filter(after), portal, order, set_fp, required=required)
    found = seen.groupBy(portal).agg((F.max_by("stable_count", F.struct(*order)) >= required).alias("_ok"), F.count("*").alias("_n"))
    every = obs.select(portal).distinct().join(found, portal, "left")
    return every.select(portal, F.coalesce("_ok", F.lit(False)).alias("head_verified"), F.coalesce("_n", F.lit(0)).alias("head_visits"))


def ledger(items: DataFrame, key: str, page: str, visit: str) -> DataFrame:
    """Per item: first and last visit, distinct pages, times seen."""
    return items.groupBy(key).agg(F.min(visit).alias("first_visit"), F.max(visit).alias("last_visit"), F.countDistinct(page).alias("n_pages"), F.count("*").alias("n_seen"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.col(visit), F.col(page)))), lambda r: r[page].cast("string")), ",").alias("pages"))


def duplicates(items: DataFrame, key: str) -> DataFrame:
    return items.agg(F.count("*").alias("n_seen"), F.countDistinct(key).alias("n_distinct"), (F.count(key) - F.countDistinct(key)).alias("n_duplicates"))


def first_seen(items: DataFrame, key: str, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The first row of each key: an order-preserving distinct."""
    w = Window.partitionBy(*group, key).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def new_per_page(items: DataFrame, key: str, page: str, order: Sequence[str]) -> DataFrame:
    """Per page: items, and those never seen before in the order of requests."""
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("_new", (F.row_number().over(w) == 1).cast("long")).groupBy(page).agg(F.count("*").alias("n_items"), F.sum("_new").alias("n_new"))


def within_budget(requests: DataFrame, order: Sequence[str], budget: int, group: Sequence[str]) -> DataFrame:
    """Requests of each group up to the budget; the one after it is kept as the mark that the budget ran out."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return requests.withColumn("request_no", n).filter(F.col("request_no") <= budget + 1).withColumn("exhausted", F.col("request_no") > budget)


def by_phase(requests: DataFrame, group: Sequence[str], phase: str) -> DataFrame:
    n = lambda *names: F.count_if(F.col(phase).isin(*names))
    return requests.groupBy(*group).agg(n("INITIAL").alias("n_initial"), n("HEAD_VERIFICATION", "FINAL_VERIFICATION").alias("n_head"), n("RECONCILIATION").alias("n_reconciliation"), F.count("*").alias("n_requests"))


def converged(last_visits: DataFrame, group: Sequence[str], exhausted: Column, queue_empty: Column) -> DataFrame:
    """Per group of pages (with their last is_stable): whether all are stable, nothing waits, and the budget held."""
    ok = F.bool_and("is_stable") & ~F.bool_or(exhausted) & F.bool_and(queue_empty)
    return last_visits.groupBy(*group).agg(F.count("*").alias("n_pages"), F.count_if("is_stable").alias("n_stable"), F.coalesce(ok, F.lit(False)).alias("converged"))


def revisits(changed: DataFrame, page: str, visits: DataFrame, max_visits: int) -> DataFrame:
    """Pages to read again: each changed page and its neighbours that exist, below the visit cap. visits has (page, n)."""
    near = changed.select(F.explode(F.array(F.col(page), F.col(page) + 1, F.when(F.col(page) > 1, F.col(page) - 1))).alias(page)).filter(F.col(page).isNotNull()).distinct()
    return near.join(visits, page).filter(F.col("n") < max_visits).select(page)


def recall(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """One row: sizes, overlap, recall and precision (four digits; 0 where there is nothing)."""
    j = found.select(key).distinct().withColumn("_f", F.lit(1)).join(truth.select(key).distinct().withColumn("_t", F.lit(1)), key, "full_outer")
    n = j.agg(F.count("_f").alias("n_found"), F.count("_t").alias("n_truth"), F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()).alias("n_both"))
    share = lambda d: F.when(F.col(d) > 0, F.round(F.col("n_both") / F.col(d), 4)).otherwise(F.lit(0.0))
    return n.withColumns({"recall": share("n_truth"), "precision": share("n_found")})


def classified(found: DataFrame, truth: DataFrame, key: str, total: Column) -> DataFrame:
    """One row: false positives, false negatives and the accuracy over `total` rows (four digits; 0 of none)."""
    j = found.select(key).distinct().withColumn("_f", F.lit(1)).join(truth.select(key).distinct().withColumn("_t", F.lit(1)), key, "full_outer")
    n = j.agg(F.count_if(F.col("_t").isNull()).alias("false_positives"), F.count_if(F.col("_f").isNull()).alias("false_negatives"))
    return n.withColumn("accuracy", F.when(total > 0, F.round((total - F.col("false_positives") - F.col("false_negatives")) / total, 4)).otherwise(F.lit(0.0)))
