"""URL functions as native Columns; each has a twin in DuckDB's SQL (`*_sql`) that the oracles use."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Query keys that only track, patterns of the link classifier and of the article filter.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid")
NAV_EXCLUDED = ("/login", "/privacy", "/contact", "/author", "/tag", "/ads", "/promo")
NAV_ARTICLE = ("/article/", "/post/", "/item_", "/article_")

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_HOST = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_PARAMS = "(;[^/]*)$"
_EDGES = r"^\s+|\s+$"


def _lit(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def _joined(scheme: Column, netloc: Column, rest: Column, query: Column) -> Column:
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), rest, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encoded(x: Column) -> Column:
    """Form encoding that leaves letters, digits and _ . - ~ as they are."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column, strip_tracking: bool = True) -> Column:
    """Canonical article URL: scheme and host in lower case, no trailing slashes, no fragment, no tracking keys, query pairs decoded, sorted and encoded again. Null gives ''."""
    t = F.regexp_replace(F.coalesce(url, F.lit("")), _EDGES, "")
    whole = path(t)
    params = F.regexp_extract(whole, _PARAMS, 1)
    base = F.left(whole, F.length(whole) - F.length(params))
    base = F.when(base == "", F.lit("/")).when((base != "/") & base.endswith("/"), F.regexp_replace(base, "/+$", "")).otherwise(base)
    pairs = F.filter(F.split(F.regexp_extract(t, _QUERY, 1), "&"), lambda p: p != "")
    split = F.transform(pairs, lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    if strip_tracking:
        split = F.filter(split, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS))
    query = F.array_join(F.transform(F.array_sort(split), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(_joined(F.lower(F.regexp_extract(t, _SCHEME, 1)), host(t), _rooted(F.concat(base, F.when(params == ";", F.lit("")).otherwise(params)), host(t)), query))


def _rooted(rest: Column, netloc: Column) -> Column:
    """A path after a host begins with a slash unless it is empty."""
    return F.when((netloc != "") & (rest != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest)


def canonical_sql(u: str) -> str:
    t = f"regexp_replace(coalesce({u}, ''), '{_EDGES}', '', 'g')"
    whole = f"regexp_extract({t}, '{_PATH}', 1)"
    params = f"regexp_extract({whole}, '{_PARAMS}', 1)"
    base = f"left({whole}, length({whole}) - length({params}))"
    base = f"CASE WHEN {base} = '' THEN '/' WHEN {base} <> '/' AND {base} LIKE '%/' THEN regexp_replace({base}, '/+$', '') ELSE {base} END"
    rest = f"({base}) || CASE WHEN {params} = ';' THEN '' ELSE {params} END"
    rest = f"CASE WHEN regexp_extract({t}, '{_HOST}', 1) <> '' AND ({rest}) <> '' AND NOT ({rest}) LIKE '/%' THEN '/' || ({rest}) ELSE {rest} END"
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    pairs = f"list_filter(string_split(regexp_extract({t}, '{_QUERY}', 1), '&'), lambda p: p <> '')"
    split = f"list_transform({pairs}, lambda p: {{'k': {dec(chr(114) + 'egexp_extract(p, ' + chr(39) + '^([^=]*)' + chr(39) + ', 1)')}, 'v': {dec(chr(114) + 'egexp_extract(p, ' + chr(39) + '^[^=]*=(.*)$' + chr(39) + ', 1)')}}})"
    kept = f"list_filter({split}, lambda p: NOT list_contains({_lit(TRACKING_KEYS)}, lower(p.k)))"
    query = f"array_to_string(list_transform(list_sort({kept}), lambda p: {enc('p.k')} || '=' || {enc('p.v')}), '&')"
    scheme, netloc = f"lower(regexp_extract({t}, '{_SCHEME}', 1))", f"lower(regexp_extract({t}, '{_HOST}', 1))"
    return f"(CASE WHEN coalesce({u}, '') = '' THEN '' ELSE (CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END) || (CASE WHEN {netloc} <> '' THEN '//' || {netloc} ELSE '' END) || ({rest}) || (CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END) END)"


def lookup(url: Column) -> Column:
    """Key of an archive index: no fragment, scheme and host in lower case, no default port; trailing slash and query stay."""
    t = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), "^([^#]*)", 1), _EDGES, "")
    scheme, netloc = F.lower(F.regexp_extract(t, _SCHEME, 1)), host(t)
    standard = ((scheme == "http") & netloc.endswith(":80")) | ((scheme == "https") & netloc.endswith(":443"))
    netloc = F.when(standard, F.regexp_replace(netloc, ":[0-9]+$", "")).otherwise(netloc)
    rest = F.when(path(t) == "", F.lit("/")).otherwise(path(t))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(_joined(scheme, netloc, rest, F.regexp_extract(t, _QUERY, 1)))


def lookup_sql(u: str) -> str:
    t = f"regexp_replace(regexp_extract(coalesce({u}, ''), '^([^#]*)', 1), '{_EDGES}', '', 'g')"
    scheme, netloc = f"lower(regexp_extract({t}, '{_SCHEME}', 1))", f"lower(regexp_extract({t}, '{_HOST}', 1))"
    cut = f"CASE WHEN ({scheme} = 'http' AND {netloc} LIKE '%:80') OR ({scheme} = 'https' AND {netloc} LIKE '%:443') THEN regexp_replace({netloc}, ':[0-9]+$', '') ELSE {netloc} END"
    p, q = f"regexp_extract({t}, '{_PATH}', 1)", f"regexp_extract({t}, '{_QUERY}', 1)"
    return f"(CASE WHEN coalesce({u}, '') = '' THEN '' ELSE (CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END) || (CASE WHEN {netloc} <> '' THEN '//' || ({cut}) ELSE '' END) || (CASE WHEN {p} = '' THEN '/' ELSE {p} END) || (CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END) END)"


def toggled_slash(url: Column) -> Column:
    """The alias of an index key: with a trailing slash where there is none, and without where there is one."""
    return F.when(url.endswith("/"), F.regexp_replace(url, "/$", "")).otherwise(F.concat(url, F.lit("/")))


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def replay_url(base: Column, url: Column) -> Column:
    """base + /replay?url= + url, percent-encoded throughout."""
    return F.concat(base, F.lit("/replay?url="), F.replace(_encoded(url), F.lit("+"), F.lit("%20")))


def link_class(url: Column, allowed_hosts: Sequence[str], excluded: Sequence[str] = NAV_EXCLUDED, article: Sequence[str] = NAV_ARTICLE) -> Column:
    """EXCLUDED, OUT_OF_SCOPE, ARTICLE_NODE or ARCHIVE_NODE; a relative URL is in scope."""
    h, p = host(url), F.lower(path(url))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(p, x)) if words else F.lit(False)
    foreign = (h != "") & ~h.isin(*allowed_hosts) if allowed_hosts else F.lit(False)
    return F.when(F.coalesce(url, F.lit("")) == "", "EXCLUDED").when(foreign, "OUT_OF_SCOPE").when(some(excluded), "EXCLUDED").when(some(article), "ARTICLE_NODE").otherwise("ARCHIVE_NODE")


def valid_article(url: Column, allowed_hosts: Sequence[str], excluded: Sequence[str], prefixes: Sequence[str], base_path: str, root: str = "/news/") -> Column:
    """Whether an absolute URL names an article of an archive: host, exclusions, prefix, and something beyond the root."""
    h, p, u = host(url), F.lower(path(url)), F.lower(url)
    base = base_path.lower()
    out = F.coalesce(url, F.lit("")) != ""
    if allowed_hosts:
        out &= h.isin(*allowed_hosts)
    for x in excluded:
        out &= ~F.contains(p, F.lit(x)) & ~F.contains(u, F.lit(x))
    out &= (p != base) & (p != base.rstrip("/"))
    starts = F.lit(False)
    for x in prefixes:
        starts |= p.startswith(x.lower())
    return F.coalesce(out & starts & (F.regexp_replace(F.replace(p, F.lit(root), F.lit("")), "^/+|/+$", "") != ""), F.lit(False))


def asset_kept(url: Column) -> Column:
    """Whether an asset URL is fetched at all: no empty, data:, blob: or javascript: URLs."""
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), _EDGES, ""))
    return (u != "") & ~u.rlike("^(data|blob|javascript):")


def without_fragment(url: Column) -> Column:
    return F.regexp_extract(url, "^([^#]*)", 1)


@F.pandas_udf(StringType())
def resolved(base: pd.Series, reference: pd.Series) -> pd.Series:
    """RFC 3986 resolution of reference against base; null where either is null."""
    return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, reference, strict=True)], dtype=object)


def robots_allowed(agent: str):
    """A function of (robots, url): whether the site's robots text lets `agent` fetch the URL; a text that could not be had (null) allows all."""

    @F.pandas_udf(BooleanType())
    def allowed(robots: pd.Series, url: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}

        def one(text: str | None, u: str | None) -> bool:
            if text is None or u is None:
                return True
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            return parsers[text].can_fetch(agent, u)

        return pd.Series([one(t, u) for t, u in zip(robots, url, strict=True)])

    return allowed


def topic_link(url: Column, marker: str = "/support/topic/") -> Column:
    return F.contains(F.coalesce(url, F.lit("")), F.lit(marker))
