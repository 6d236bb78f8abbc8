"""Extraction rules on current pages: validation, acceptance, repair."""

from __future__ import annotations

import copy
import json
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dom import parse
from ..functions.html import extract, page_fields

# Fixed value: share of pages on which a rule must hold.
THRESHOLD = 0.9


def validate(pages: DataFrame, rules: dict[str, dict[str, str]], threshold: float = THRESHOLD, key: str = "page_id") -> DataFrame:
    """Per field: pages tested, successes, rate (four digits), empty ones, several matches, failures, acceptable."""
    found = page_fields(pages, rules, key)
    per = found.groupBy("field").agg(
        F.count("*").alias("tested"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success") & F.col("error").eqNullSafe("EMPTY_TEXT")).alias("empty"),
        F.count_if(F.col("success") & (F.col("match_count") > 1)).alias("several"),
        F.count_if(~F.col("success")).alias("failures"),
    )
    rate = F.bround(F.col("successful") / F.col("tested"), 4)
    return per.withColumn("rate", rate).withColumn("acceptable", F.col("rate") >= threshold)


class PageFields:
    """SQL table function page_fields(html, rules): field, value, success, error and match_count of every rule on a page. rules: JSON text, a map from field to selector and type; it may differ
    from row to row. A page is parsed once for all rules; a null or blank page fails every rule, null rules give no rows."""

    def __init__(self) -> None:
        self.text, self.rules = None, {}

    def eval(self, html: str, rules: str):
        if rules is None:
            return
        if rules != self.text:
            self.text, self.rules = rules, json.loads(rules)
        root = parse(html, True) if html and html.strip() else None
        for field, rule in self.rules.items():
            got = extract(root, rule.get("selector", ""), rule.get("type", "css").lower()) if root else {"value": None, "success": False, "error": "NO_HTML", "match_count": 0}
            yield field, got["value"], got["success"], got["error"], got["match_count"]


def register(spark: SparkSession) -> None:
    """Make page_fields known to SQL: SELECT ... FROM pages, LATERAL page_fields(html, '{...}')."""
    spark.udtf.register("page_fields", F.udtf(PageFields, returnType="field string, value string, success boolean, error string, match_count int", useArrow=True))


def accepted(validated: DataFrame) -> DataFrame:
    """One row: whether every field is acceptable; an empty rule set is."""
    return validated.agg(F.coalesce(F.bool_and("acceptable"), F.lit(True)).alias("accepted"), F.count("*").alias("n_fields"))


def field_accuracy(found: DataFrame, truth: DataFrame, substring_fields: tuple[str, ...] = ("body",)) -> DataFrame:
    """Per field: expected values, and those met: equal, or contained for long texts. truth: key, field, expected."""
    j = truth.join(found, [truth.columns[0], "field"], "left")
    met = F.when(F.col("field").isin(*substring_fields), F.contains(F.coalesce("value", F.lit("")), F.col("expected"))).otherwise(F.col("value").eqNullSafe(F.col("expected")))
    n = j.groupBy("field").agg(F.count("*").alias("n_expected"), F.count_if(met).alias("n_correct"))
    return n.withColumn("accuracy", F.round(F.col("n_correct") / F.col("n_expected"), 4))


class RuleSource(ABC):
    """Where new rules come from."""

    @abstractmethod
    def propose(self, field: str, samples: list[str]) -> dict[str, str] | None: ...


class FixedRules(RuleSource):
    """Rules from a given table."""

    def __init__(self, rules: dict[str, dict[str, str]]) -> None:
        self.rules = rules

    def propose(self, field: str, samples: list[str]) -> dict[str, str] | None:
        return self.rules.get(field)


def repair(pages: DataFrame, config: dict, source: RuleSource, approved: bool, threshold: float = THRESHOLD, n_samples: int = 3) -> tuple[dict, list[dict]]:
    """(config, report): fields whose rule fails get a proposal, which is validated on the same pages; it is taken if it holds and was approved. A change raises the version and is kept in the history.

    What comes to the driver is a row per field and n_samples pages for the proposer."""
    rules = config["selectors"]
    state = {r["field"]: r for r in validate(pages, rules, threshold).collect()}
    broken = sorted(f for f in rules if not (f in state and state[f]["acceptable"]))
    if not broken:
        return config, []
    samples = [r["html"] for r in pages.orderBy(pages.columns[0]).select("html").limit(n_samples).collect()]
    proposals = {f: p for f in broken if (p := source.propose(f, samples))}
    checked = {r["field"]: r for r in validate(pages, proposals, threshold).collect()} if proposals else {}
    new, report = copy.deepcopy(config), []
    for f in broken:
        ok = f in checked and checked[f]["acceptable"]
        report.append({"field": f, "old_rate": state[f]["rate"] if f in state else 0.0, "new_rate": checked[f]["rate"] if f in checked else 0.0, "applied": bool(ok and approved)})
        if ok and approved:
            new.setdefault("history", []).append({"field": f, "rule": rules[f]})
            new["selectors"][f] = proposals[f]
    if any(r["applied"] for r in report):
        new["version"] = new.get("version", 1) + 1
    return new, report
