"""Scalar functions on strings, digests, times and codes, all native."""

from __future__ import annotations

import json
from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a rule may hold, and what it must not.
RULE_TYPES = ("css", "xpath")
RULE_KEYS = ("selector", "type", "description")
RULE_DANGERS = (r"\b__\w+__\b", r"\bimport\b", r"\beval\b", r"\bexec\b", "<script")
# Base MIME types by category, and file name endings for what they leave open.
MIME_CATEGORIES = (
    ("HTML", ("text/html", "application/xhtml+xml")),
    ("CSS", ("text/css",)),
    ("JAVASCRIPT", ("application/javascript", "text/javascript", "application/x-javascript")),
    ("JSON", ("application/json", "text/json")),
    ("FONT", ("application/font-woff", "application/font-woff2", "application/x-font-ttf")),
    ("TEXT", ("text/plain", "text/markdown")),
    ("XML", ("application/xml", "text/xml")),
    ("PDF", ("application/pdf",)),
)
URL_CATEGORIES = (("CSS", ("css",)), ("JAVASCRIPT", ("js",)), ("IMAGE", ("png", "jpg", "jpeg", "gif", "webp", "svg", "ico")), ("JSON", ("json",)), ("TEXT", ("txt", "md")))
CATEGORIES = ("HTML", "CSS", "JAVASCRIPT", "IMAGE", "JSON", "FONT", "TEXT", "XML", "PDF", "OTHER")


def digests(content: Column) -> Column:
    """Struct of md5, sha256 and size; one scan of the content serves all."""
    return F.struct(F.md5(content).alias("md5"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"))


def config_hash(config: dict) -> str:
    """First eight hex digits of the SHA-256 of the JSON text with sorted keys."""
    return sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:8]


def run_id(started: Column, config: Column) -> Column:
    """run-<compact UTC time>-<config hash>; a time that cannot be parsed stays as it is."""
    parsed = F.try_to_timestamp(started)
    return F.concat(F.lit("run-"), F.coalesce(F.date_format(parsed, "yyyyMMdd'T'HHmmss'Z'"), started), F.lit("-"), config)


def base_mime(mime: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(mime, F.lit("")), F.lit(";"), F.lit(1))))


def loose_html(mime: Column) -> Column:
    m = F.lower(F.coalesce(mime, F.lit("")))
    return F.contains(m, F.lit("text/html")) | F.contains(m, F.lit("xhtml"))


def usable_html(record_type: Column, status: Column, mime: Column, size: Column) -> Column:
    """A response with no or a 2xx status, an HTML type and a body."""
    return (record_type == "response") & (status.isNull() | status.between(200, 299)) & base_mime(mime).isin("text/html", "application/xhtml+xml") & (size > 0)


def content_category(record_type: Column, mime: Column, url: Column) -> Column:
    """Category by MIME type, by the URL's ending where the type is unknown; other records than responses are OTHER."""
    m = base_mime(mime)
    out = F.when(record_type != "response", "OTHER")
    for name, types in MIME_CATEGORIES:
        out = out.when(m.isin(*types), name)
    out = out.when(m.startswith("image/"), "IMAGE").when(m.startswith("font/"), "FONT")
    ending = F.lower(F.regexp_extract(F.split_part(url, F.lit("?"), F.lit(1)), r"\.([A-Za-z0-9]+)$", 1))
    for name, ends in URL_CATEGORIES:
        out = out.when(ending.isin(*ends), name)
    return out.otherwise("OTHER")


def is_html(mime: Column, url: Column) -> Column:
    return loose_html(mime) & ~F.lower(url).endswith(".svg")


def is_css(mime: Column, url: Column) -> Column:
    return F.contains(F.lower(F.coalesce(mime, F.lit(""))), F.lit("text/css")) | F.lower(F.split_part(url, F.lit("?"), F.lit(1))).endswith(".css")


def unfenced(text: Column) -> Column:
    """The body of the first Markdown code fence, or the text."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(body != "", body).otherwise(text), r"^\s+|\s+$", "")


def rule_error(field: Column, rule: Column) -> Column:
    """Code of the first fault of an extraction rule (map<string,string>), or null."""
    selector, kind = rule["selector"], F.lower(F.coalesce(rule["type"], F.lit("css")))
    danger = F.lit(False)
    for pattern in RULE_DANGERS:
        danger |= selector.rlike("(?i)" + pattern)
    return (
        F.when(F.coalesce(F.trim(field), F.lit("")) == "", "INVALID_FIELD")
        .when(rule.isNull(), "NOT_A_RULE")
        .when(F.size(F.array_except(F.map_keys(rule), F.array(*map(F.lit, RULE_KEYS)))) > 0, "DISALLOWED_KEYS")
        .when(selector.isNull(), "MISSING_SELECTOR")
        .when(F.trim(selector) == "", "EMPTY_SELECTOR")
        .when(~kind.isin(*RULE_TYPES), "UNSUPPORTED_TYPE")
        .when(danger, "DANGEROUS_PATTERN")
    )


def contained_path(path: Column) -> Column:
    """The normalised relative path, or null if it is blank, absolute, on a drive, or leaves its root."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    bad = (F.trim(p) == "") | F.contains(p, F.lit("\x00")) | p.startswith("/") | p.rlike("^[A-Za-z]:") | F.exists(parts, lambda x: x == "..") | (F.size(parts) == 0)
    return F.when(~F.coalesce(bad, F.lit(True)), F.array_join(parts, "/"))


def manifest_line(line: Column) -> Column:
    """Struct (sha256, path, error) of a line; all null for blank lines and comments."""
    t = F.trim(line)
    digest, name = F.regexp_extract(t, r"^(\S+)\s+(.+)$", 1), F.regexp_extract(t, r"^(\S+)\s+(.+)$", 2)
    skip = (t == "") | t.startswith("#")
    return F.struct(F.when(~skip & (digest != ""), F.lower(digest)).alias("sha256"), F.when(~skip & (digest != ""), name).alias("path"), F.when(~skip & (digest == ""), F.lit("MALFORMED")).alias("error"))


def srcset_urls(srcset: Column) -> Column:
    urls = F.transform(F.split(srcset, ","), lambda c: F.regexp_extract(c, r"^\s*(\S+)", 1))
    return F.filter(urls, lambda u: u != "")


def post_ids(html: Column) -> Column:
    """Distinct post numbers in the order of the page."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'id="post-(\d+)"'), F.lit(1)))


def next_link(html: Column) -> Column:
    """href of the first anchor whose class holds `next`."""
    tag = F.regexp_extract(html, r'(?i)(<a\b[^>]*class="[^"]*\bnext\b[^"]*"[^>]*>)', 1)
    return F.nullif(F.regexp_extract(tag, r'(?i)href="([^"]*)"', 1), F.lit(""))


def canonical_link(html: Column) -> Column:
    tag = F.regexp_extract(html, r'(?i)(<link\b[^>]*rel="canonical"[^>]*>)', 1)
    return F.nullif(F.regexp_extract(tag, r'(?i)href="([^"]*)"', 1), F.lit(""))


def stripped_etag(etag: Column) -> Column:
    return F.regexp_replace(etag, '^"+|"+$', "")


def quoted_etag(etag: Column) -> Column:
    return F.when(F.coalesce(etag, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit('"'), stripped_etag(etag), F.lit('"')))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_time(text: Column) -> Column:
    """Timestamp of either ISO format in use; null if it is none."""
    return F.try_to_timestamp(text)


def lease_expired(owner: Column, expires: Column, now: Column) -> Column:
    return owner.isNull() | expires.isNull() | (now >= expires)


def masked(text: Column, token: Column, mark: str = "***") -> Column:
    """text with a token of four or more characters replaced."""
    return F.when(F.length(token) >= 4, F.replace(text, token, F.lit(mark))).otherwise(text)


def retry_delay(status: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds before an attempt is repeated: for 429 at most a minute, half of one by default; else a power of two."""
    return F.when(status == 429, F.least(F.coalesce(retry_after, F.lit(30)), F.lit(60)).cast("long")).otherwise(F.pow(F.lit(2.0), attempt).cast("long"))


def retry_class(status: Column) -> Column:
    """How a fetch went: OK, RETRIABLE (5xx, none), RETRIABLE_ONCE (429) or TERMINAL."""
    return F.when(status.isNull() | (status >= 500) | (status == 0), "RETRIABLE").when(status == 429, "RETRIABLE_ONCE").when(status.between(200, 299), "OK").otherwise("TERMINAL")


def record_id(url: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.left(F.sha2(url, 256), F.lit(16)), F.lit(">"))


def deposit_access(access: Column, known: Sequence[str] = ("open", "embargoed", "restricted", "closed")) -> Column:
    return F.when(F.lower(access).isin(*known), F.lower(access)).otherwise("restricted")


def deposit_errors(title: Column, description: Column, creators: Column, domains: Column, formats: Column, manifest: Column, access: Column, embargo: Column) -> Column:
    """Codes of the faults of a deposit's metadata: short or missing texts, empty lists, no manifest, an embargo without its date."""
    length = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = [
        (length(title) < 5, "TITLE_TOO_SHORT"),
        (none(creators), "NO_CREATOR"),
        (length(description) < 20, "DESCRIPTION_TOO_SHORT"),
        (none(domains), "NO_SOURCE_DOMAIN"),
        (none(formats), "NO_ARCHIVE_FORMAT"),
        (blank(manifest), "NO_CHECKSUM_MANIFEST"),
        (F.coalesce(access == "embargoed", F.lit(False)) & blank(embargo), "NO_EMBARGO_DATE"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in checks)), lambda x: x.isNotNull())


def rounded(x: Column, digits: int = 4) -> Column:
    return F.bround(x, digits)
