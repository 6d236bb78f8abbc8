"""JSON payloads: content or metadata, and likeness to a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_BODY = 50


def _text(v: Column, path: str) -> Column:
    """String at a path if it is one."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def _truthy(v: Column, path: str) -> Column:
    """Whether a value is there and neither empty, zero nor false; the text "0" or "false" is a text like any other."""
    at = F.try_variant_get(v, path, "variant")
    kind, shown = F.schema_of_variant(at), F.try_variant_get(v, path, "string")
    number = F.coalesce(shown.try_cast("double") != 0, F.lit(True))
    out = F.when(kind == "STRING", shown != "").when(kind == "BOOLEAN", shown == "true").when(kind == "VOID", F.lit(False)).when(kind.startswith("ARRAY"), shown != "[]").when(kind.startswith("OBJECT"), shown != "{}").otherwise(number)
    return F.coalesce(at.isNotNull() & out, F.lit(False))


def classify(text: Column) -> Column:
    """NON_JSON, METADATA_JSON or CONTENT_JSON: one object (or a list of one) with a body of over LEAST_BODY characters, and a title, slug or id."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    single = F.try_variant_get(v, "$[0]", "variant")
    only = F.try_variant_get(v, "$[1]", "variant").isNull() & F.schema_of_variant(single).startswith("OBJECT")
    post = F.when(kind.startswith("ARRAY") & only, single).when(kind.startswith("OBJECT"), v)
    trimmed = lambda c: F.length(F.regexp_replace(c, r"^\s+|\s+$", ""))
    # A body is looked for in the first place that holds a value of its kind.
    has_rendered = F.try_variant_get(post, "$.content.rendered", "variant").isNotNull()
    body = F.when(has_rendered, _text(post, "$.content.rendered")).when(F.coalesce(trimmed(_text(post, "$.content")), F.lit(0)) > LEAST_BODY, _text(post, "$.content")).otherwise(_text(post, "$.body"))
    named = _truthy(post, "$.title") | _truthy(post, "$.slug") | _truthy(post, "$.id")
    content = (F.coalesce(trimmed(body), F.lit(0)) > LEAST_BODY) & named
    return F.when(v.isNull() | ~(kind.startswith("ARRAY") | kind.startswith("OBJECT")), "NON_JSON").when(post.isNotNull() & content, "CONTENT_JSON").otherwise("METADATA_JSON")


def plain(text: Column) -> Column:
    """Lower case, words and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain(text), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words, four digits; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, F.round(both / either, 4)).otherwise(F.lit(0.0))


def same_article(html_title: Column, json_title: Column, slug: Column, canonical: Column) -> Column:
    """Struct of title_match (either title holds the other; an empty one always does) and identity (or the slug stands in the canonical URL)."""
    h, j = plain(F.coalesce(html_title, F.lit(""))), plain(F.coalesce(json_title, F.lit("")))
    title = F.contains(h, j) | F.contains(j, h)
    return F.struct(title.alias("title_match"), (title | F.contains(F.coalesce(canonical, F.lit("")), F.coalesce(slug, F.lit("")))).alias("identity"))
