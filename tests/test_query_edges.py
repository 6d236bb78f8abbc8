"""Queries against their SQL on small tables of their own: cut character references, URLs that several pages share."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.plans import catalogue
from cairn.sources import warc
from tests.test_queries import rows

PAGE = "<!DOCTYPE html><html><head><title>{0}</title></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><div class=\"ad\">{1}</div><article><h1>{0}</h1><p><b>{0}<br></p></article><footer>f</footer></body></html>"


def compared(spark, folder, name, pages):
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want, got = con.sql(catalogue.oracle_sql()[name]).df(), catalogue.queries()[name](spark, str(folder)).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(want, columns) == rows(got, columns)
    return got


TEXTS = ("a &amp;&amp; b &amp", "cut &am", "&lt;x&gt &quot;q&quot", "&amp;lt; twice", "plain")


@pytest.mark.parametrize("name", ["html_metadata", "field_accuracy"])
def test_cut_references(spark, tmp_path, name):
    got = compared(spark, tmp_path, name, [(i, f"http://a/{i}", PAGE.format(t, t[::-1] if t == "plain" else t)) for i, t in enumerate(TEXTS)])
    if name == "html_metadata":
        assert sorted(got["title"]) == sorted(["a && b &", "cut &am", '<x> "q"', "&lt; twice", "plain"])
    else:
        assert dict(zip(got["field"], got["n_correct"], strict=True)) == {"title": 5, "body": 5, "ad": 3}


def test_pages_of_one_url_have_their_order(spark, tmp_path):
    compared(spark, tmp_path, "container_pages", [(i, f"http://a/{i % 2}", "<p>x</p>") for i in reversed(range(60))])
    lines = spark.createDataFrame([("c", "http://a/", n, f'{{"url": "u{n}"}}') for n in (3, 1, 2, 0)], "container string, uri string, n int, page_line string").coalesce(1).withColumn("payload", F.lit(b"x"))
    warc.write_containers(lines, str(tmp_path / "by_line")).collect()
    warc.write_containers(lines.withColumn("seq", -F.col("n")), str(tmp_path / "by_seq")).collect()
    for folder, want in (("by_line", "u0 u1 u2 u3"), ("by_seq", "u3 u2 u1 u0")):
        assert " ".join(r["url"] for r in warc.container_pages(spark, str(tmp_path / folder)).orderBy("line_no").collect()) == want
