"""Scalar functions against the standard library and on hard values."""

import hashlib
import random
from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from cairn.functions import dom, fingerprints, html, json_payload, text, urls


def plain_canonical(raw):
    if not raw:
        return ""
    p = urlparse(raw.strip())
    path = p.path or "/"
    path = path.rstrip("/") if path != "/" and path.endswith("/") else path
    query = {k: v for k, v in parse_qs(p.query, keep_blank_values=True).items() if k.lower() not in urls.TRACKING_KEYS}
    return urlunparse((p.scheme.lower(), p.netloc.lower(), path, p.params, urlencode(sorted((k, x) for k, v in query.items() for x in v)), ""))


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


URLS = [None, "", "  ", "HTTP://Example.COM:80", "https://a.b/x//", "https://a.b//", "https://a.b/x?b=2&a=1&a=0&utm_SOURCE=q", "https://a.b/?ref=1&fbclid=2", "https://a.b/p;v=1?x", "https://a.b/p/;v=1", "https://a.b/c?k=a%20b&z=%C3%A9+1&e=", "/rel/path/#frag", "page?x=~*._-", "https://A.b/Q?x=1#f?y=2", "mailto:x@y.z", "//host/p/", "https://a.b/?a=%2B%26%3D"]


def test_canonical_equals_library(spark):
    rng = random.Random(1)
    bits = ["?", "&", "=", "a", "B", "/", "//", "utm_term", "ref", "%20", "+", "~", "*", ";", "#", "1"]
    values = URLS + ["https://h.X" + "".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(400)]
    assert column(spark, values, urls.canonical) == [plain_canonical(v) for v in values]


def test_lookup_url(spark):
    values = ["HTTP://A.b:80/x/?q=2&p=1#f", "https://A.b:443", "https://a.b:80/", "", None, "http://a.b/%41"]
    assert column(spark, values, urls.lookup) == ["http://a.b/x/?q=2&p=1", "https://a.b/", "https://a.b:80/", "", "", "http://a.b/%41"]


def test_resolution_and_replay(spark):
    rows = [("https://a.b/c/d?e", "../x"), ("https://a.b/c/", "//h/y"), ("https://a.b/c", "?q"), ("https://a.b", None)]
    got = spark.createDataFrame(rows, "b string, r string").select(urls.resolved("b", "r").alias("u")).collect()
    assert [r["u"] for r in got] == [urljoin(*r) if r[1] is not None else None for r in rows]
    assert column(spark, ["https://a.b/é ~?x=*"], lambda c: urls.replay_url(F.lit("http://s"), c)) == [html.replay_link("https://a.b/é ~?x=*", "http://s")]


def test_link_classes(spark):
    values = ["", None, "https://x.y/post/1", "https://in.z/login/a", "https://in.z/post/a", "/archive/2", "https://IN.z/post/"]
    got = column(spark, values, lambda c: urls.link_class(c, ["in.z"]))
    assert got == ["EXCLUDED", "EXCLUDED", "OUT_OF_SCOPE", "EXCLUDED", "ARTICLE_NODE", "ARCHIVE_NODE", "ARTICLE_NODE"]


def test_valid_article(spark):
    f = lambda c: urls.valid_article(c, ["w.org"], ["/news/tag", "#"], ["/news/"], "/news/all-posts/")
    values = ["https://w.org/news/2026/a/", "https://w.org/news/", "https://w.org/news/tag/x", "https://o.org/news/a", "https://w.org/news/all-posts", "https://w.org/about", None]
    assert column(spark, values, f) == [True, False, False, False, False, False, False]


def test_fingerprints(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "a"), (4, ""), (5, None)], "p long, u string")
    r = df.agg(fingerprints.ordered(F.col("u"), F.col("p")).alias("o"), fingerprints.as_set(F.col("u")).alias("s")).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r["o"], r["s"]) == (sha("a\nb\na"), sha("a\nb"))
    assert column(spark, [["b", " a ", "a", ""]], lambda c: fingerprints.child_links(c)["as_set"], "array<string>") == [sha("a\nb")]


def test_json_classes(spark):
    body = "x" * 51
    values = [None, "nope", "3", "[]", "[1,2]", '{"content":{"rendered":"%s"},"id":4}' % body, '[{"content":"%s","title":"t"}]' % body, '{"content":{"rendered":"%s"}}' % body, '{"body":"%s","slug":"s"}' % body, '{"content":{"rendered":"short"},"id":1}', '{"content":"   %s   ","id":1}' % ("x" * 50)]
    assert column(spark, values, json_payload.classify) == ["NON_JSON", "NON_JSON", "NON_JSON", "METADATA_JSON", "METADATA_JSON", "CONTENT_JSON", "CONTENT_JSON", "METADATA_JSON", "CONTENT_JSON", "METADATA_JSON", "METADATA_JSON"]


def test_similarity(spark):
    r = spark.createDataFrame([("Ein  Tag, schön!", "tag schön x", "", "")], "a string, b string, c string, d string")
    got = r.select(json_payload.jaccard(json_payload.words(F.col("a")), json_payload.words(F.col("b"))).alias("j"), json_payload.jaccard(json_payload.words(F.col("c")), json_payload.words(F.col("d"))).alias("z"), json_payload.same_article(F.lit(""), F.lit("T"), F.lit("s"), F.lit("u"))["title_match"].alias("m")).first()
    assert (got["j"], got["z"], got["m"]) == (0.5, 0.0, True)


def test_paths_and_manifest_lines(spark):
    assert column(spark, ["a/./b\\c", "../x", "/abs", "C:/x", "\\\\srv\\x", "", " ", "a//b", None, "a/../b"], text.contained_path) == ["a/b/c", None, None, None, None, None, None, "a/b", None, None]
    got = column(spark, ["ABC  p q", "# c", "", "lonely"], lambda c: text.manifest_line(c))
    assert [tuple(r) for r in got] == [("abc", "p q", None), (None, None, None), (None, None, None), (None, None, "MALFORMED")]


def test_rule_errors(spark):
    values = [{"selector": "h1"}, {"selector": " "}, {"type": "css"}, {"selector": "h1", "type": "XPATH"}, {"selector": "h1", "type": "re"}, {"selector": "h1", "x": "y"}, {"selector": "important"}, {"selector": "import os"}, {"selector": "a <SCRIPT"}, None]
    got = column(spark, values, lambda c: text.rule_error(F.lit("f"), c), "map<string,string>")
    assert got == [None, "EMPTY_SELECTOR", "MISSING_SELECTOR", None, "UNSUPPORTED_TYPE", "DISALLOWED_KEYS", None, "DANGEROUS_PATTERN", "DANGEROUS_PATTERN", "NOT_A_RULE"]


def test_small_functions(spark):
    assert column(spark, ["```json\n{\"a\":1}\n``` tail", "plain "], text.unfenced) == ['{"a":1}', "plain"]
    assert column(spark, ["a.png 1x, b.png 2x,,"], text.srcset_urls) == [["a.png", "b.png"]]
    assert column(spark, ['<i id="post-3"><i id="post-1"><i id="post-3">'], text.post_ids) == [["3", "1"]]
    assert column(spark, ['<a class="x next" href="/p2">', "<a href=q>"], text.next_link) == ["/p2", None]
    assert column(spark, ['"e"', "e", "", None], text.quoted_etag) == ['"e"', '"e"', "", ""]
    assert column(spark, ["2026-01-02T03:04:05Z", "junk"], lambda c: text.run_id(c, F.lit("ab"))) == ["run-20260102T030405Z-ab", "run-junk-ab"]
    assert column(spark, [429, 500, 404, None], lambda c: text.retry_delay(c, F.lit(3), F.lit(100)), "int") == [60, 8, 8, 8]
    assert column(spark, ["secret abc"], lambda c: text.masked(c, F.lit("abc"))) == ["secret abc"]
    assert column(spark, ["secret abcd"], lambda c: text.masked(c, F.lit("abcd"))) == ["secret ***"]
    assert text.config_hash({"b": 1, "a": "é"}) == hashlib.sha256('{"a": "é", "b": 1}'.encode()).hexdigest()[:8]
    assert column(spark, ["open", "odd", None], text.deposit_access) == ["open", "restricted", "restricted"]


def test_deposit_errors(spark):
    """The seven rules, each alone and all at once."""
    fine = ("  A title ", " d" * 12, ["c"], ["x.org"], ["WARC"], "sums", "open", None)
    faults = [(0, "  abc  ", "TITLE_TOO_SHORT"), (0, None, "TITLE_TOO_SHORT"), (1, "short" + " " * 30, "DESCRIPTION_TOO_SHORT"), (2, [], "NO_CREATOR"), (2, None, "NO_CREATOR"), (3, [], "NO_SOURCE_DOMAIN"), (4, None, "NO_ARCHIVE_FORMAT"), (5, "", "NO_CHECKSUM_MANIFEST"), (6, "embargoed", "NO_EMBARGO_DATE")]
    rows = [fine, ("A title", "d" * 20, [""], ["x"], ["y"], " ", "odd", None), (*fine[:6], "embargoed", "2030-01-01"), (None,) * 8] + [(*fine[:i], value, *fine[i + 1 :]) for i, value, _ in faults]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string, c array<string>, s array<string>, f array<string>, m string, a string, e string")
    got = [r["x"] for r in df.orderBy("i").select(text.deposit_errors(*(F.col(c) for c in "tdcsfmae")).alias("x")).collect()]
    assert got[:4] == [[], [], [], ["TITLE_TOO_SHORT", "NO_CREATOR", "DESCRIPTION_TOO_SHORT", "NO_SOURCE_DOMAIN", "NO_ARCHIVE_FORMAT", "NO_CHECKSUM_MANIFEST"]]
    assert got[4:] == [[code] for *_, code in faults]


def test_names_that_look_empty_count(spark):
    body = "x" * 60
    named = lambda name: '{"content": "%s", %s}' % (body, name)
    yes = ['"title": "0"', '"slug": "false"', '"title": "{}"', '"id": 7', '"title": {"rendered": ""}', '"id": true', '"slug": [0]', '"id": 0.5']
    no = ['"title": ""', '"id": 0', '"id": 0.0', '"slug": false', '"title": null', '"title": {}', '"slug": []', '"other": 1']
    got = column(spark, [named(x) for x in yes + no], json_payload.classify)
    assert got == ["CONTENT_JSON"] * len(yes) + ["METADATA_JSON"] * len(no)


def test_lazy_samples_are_the_first_five():
    root = dom.parse("".join(f'<img loading="lazy" src="{i}.png" data-src="d{i}">' for i in range(7)) + '<iframe data-lazy="z"></iframe><script async src="s.js"></script><script>x</script>')
    got = html.lazy_samples(root)
    assert [s for kind, _, s in got if kind == "loading_lazy"] == [f"{i}.png" for i in range(5)]
    assert [s for kind, _, s in got if kind == "data_src"] == [f"d{i}" for i in range(5)] and got[-1] == ("deferred_script", "script", "s.js")


PAGE = """<html><head><title> Page </title><link rel="canonical" href="/c"><link rel="stylesheet" href="s.css"><link rel="shortcut icon" href="f.ico"><link rel="preload" as="font" href="f.woff2">
<meta property="article:published_time" content="2026-01-01"><meta name="author" content="Meta Author"><link rel="https://api.w.org/" href="/wp-json/"><script>var a = "</p>";</script><script src="lazyload.js"></script></head>
<body><header><img src="brand.png"></header><article class="entry-content"><h1>The <b>Head</b></h1><p class="lead">One<p>Two</p><img src="a.png#x" srcset="b.png 2x" loading="lazy"><img data-src="z.png"><span class="byline">By Me</span></article>
<div class="post"><h2 class="title"><a href="/p1">t</a></h2><a href="/p2">u</a></div><a href="/p3">v</a><video src="m.mp4"><source src="n.mp4"></video><!-- gone --></body></html>"""


def test_page_metadata():
    got = html.metadata(dom.parse(PAGE), "https://h.x/a/")
    assert got == {"title": "Page", "heading": "TheHead", "publication_date": "2026-01-01", "author": "Meta Author", "canonical_url": "/c", "rest_api_url": "https://h.x/wp-json/"}


def test_page_parts():
    root = dom.parse(PAGE)
    assert html.lazy_loading(root) == {"detected": True, "loading_lazy": 1, "data_src": 1, "srcset": 1, "deferred_scripts": 1}
    assert [(a["url"].rsplit("/", 1)[1], a["resource_type"]) for a in html.assets(root, "https://h.x/")] == [("brand.png", "image"), ("a.png", "image"), ("b.png", "image"), ("s.css", "css"), ("f.ico", "image"), ("lazyload.js", "javascript"), ("f.woff2", "font"), ("m.mp4", "video"), ("n.mp4", "video")]
    assert html.images(root, "https://h.x/") == [{"url": "https://h.x/brand.png", "role": "site_chrome"}, {"url": "https://h.x/a.png", "role": "article_content"}]
    assert html.candidate_links(root) == ["/p1", "/p1", "/p2", "/p1", "/p2", "/p3"]
    small = html.reduced(PAGE)
    assert "<script" not in small and "gone" not in small and 'class="lead"' in small and "src=" not in small


@pytest.mark.parametrize(
    ("selector", "kind", "value", "count"),
    [("h1", "css", "The Head", 1), ("article > p", "css", "One\n\nTwo", 2), ("p.lead, span[class^=by]", "css", "One\n\nBy Me", 2), ("p:nth-child(2)", "css", "One", 1), ("h1 + p", "css", "One", 1), ("h1 ~ span", "css", "By Me", 1), ("a:not([href='/p1'])", "css", "u\n\nv", 2), ("//article/p[2]", "xpath", "Two", 1), ("//a[@href='/p2']/text()", "xpath", "u", 1), ("//a/@href", "xpath", "/p1\n\n/p2\n\n/p3", 3), ("//span[contains(@class,'line')]", "xpath", "By Me", 1)],
)
def test_rules_on_a_page(selector, kind, value, count):
    got = html.extract(dom.parse(PAGE, implied=True), selector, kind)
    assert (got["value"], got["match_count"], got["success"]) == (value, count, True)


@pytest.mark.parametrize(("selector", "kind", "error"), [("", "css", "EMPTY_SELECTOR"), ("h9", "css", "NO_MATCH"), ("p[", "css", "BAD_SELECTOR css"), ("//p[last()]", "xpath", "BAD_SELECTOR xpath"), ("img", "css", "EMPTY_TEXT")])
def test_rule_faults(selector, kind, error):
    got = html.extract(dom.parse(PAGE), selector, kind)
    assert not got["success"] and error in got["error"]


def test_rewriting():
    page = '<base href="/b/"><body style="background:url(x.png)"><a href="#t">1</a><a href="y">2</a><img src="data:z" srcset="p 1x, q 2x"></body>'
    got = html.rewrite(page, "https://h.x/a", "", "<div>banner</div>")
    assert "<base" not in got and '<a href="#t">' in got and "replay?url=https%3A%2F%2Fh.x%2Fb%2Fy" in got and 'src="data:z"' in got and got.count("replay?url=") == 4 and "<body" in got.split("banner")[0]


def test_deep_and_broken_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 10
    assert dom.parse(deep).text() == "x" and dom.parse(deep).html().endswith("</div>")
    assert dom.parse("</p><b>a<i>b</b>c</i>").text() == "abc"
    assert html.reduced("") == "" and dom.parse("<p>a<br>b").text("|") == "a|b"


def test_rows_of_pages_are_given_out_in_runs():
    import pyarrow as pa

    from cairn.functions import html

    pages = pa.RecordBatch.from_pydict({"page_id": pa.array([*range(29), None], pa.int64()), "url": ["http://a/"] * 30, "html": ["<p>" + "x" * 100_000] * 28 + [None, "<p>y"]})
    read = []
    runs = html._tables(iter([pages]), ["url", "html"], "pos int, size string", lambda url, page: read.append(page) or ([] if page is None else [(0, str(len(page))), (1, url)]))
    first = next(runs)
    assert len(read) < 15 and first.schema.names == ["page_id", "pos", "size"]
    rows = [r for b in (first, *runs) for r in b.to_pylist()]
    assert len(rows) == 58 and rows[0] == {"page_id": 0, "pos": 0, "size": "100003"} and rows[-1] == {"page_id": None, "pos": 1, "size": "http://a/"}
