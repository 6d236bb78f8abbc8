"""Fingerprints of URL lists: in order, and as a set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered(url: Column, pos: Column) -> Column:
    """Aggregate: SHA-256 of the non-empty URLs in the order of pos, joined by line feeds; repeats stay."""
    rows = F.array_sort(F.collect_list(F.when(F.coalesce(url, F.lit("")) != "", F.struct(pos.alias("p"), url.alias("u")))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["u"]), "\n"), 256)


def as_set(url: Column) -> Column:
    """Aggregate: SHA-256 of the distinct non-empty URLs in code-point order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(F.when(url != "", url))), "\n"), 256)


def of_list(urls: Column) -> Column:
    """SHA-256 of an array of URLs in its order."""
    return F.sha2(F.array_join(F.filter(urls, lambda u: u != ""), "\n"), 256)


def of_list_as_set(urls: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.filter(urls, lambda u: u != ""))), "\n"), 256)


def child_links(urls: Column) -> Column:
    """Struct of both fingerprints of a node's child links, which are trimmed only."""
    trimmed = F.filter(F.transform(urls, lambda u: F.trim(u)), lambda u: u != "")
    return F.struct(of_list(trimmed).alias("ordered"), of_list_as_set(trimmed).alias("as_set"))
