"""The offset index of archives: the same for every size of ranges, exact on archives inside archives, look-ups that read one record."""

import gzip
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cairn.sources import stores, warc, warc_index

FIELDS = ["file", "offset", "length", "inner_no", "record_no", "warc_type", "target_uri", "status_code", "payload_length", "error"]


def request(uri):
    head = f"WARC/1.0\r\nWARC-Type: request\r\nWARC-Target-URI: {uri}\r\nContent-Length: 4\r\n\r\n"
    return head.encode() + b"GET \r\n\r\n"


def archives(folder):
    """Files of several kinds, and the records that each holds: (file, target_uri, payload)."""
    rng, want = random.Random(3), []
    body = lambda n: bytes(rng.randrange(256) for _ in range(n))
    nested = b"".join(warc.encoded(f"http://in.x/{i}", 200, "text/html", body(40), compress=False) for i in range(20))
    for kind in ("plain", "gz", "one", "nested", "nested_gz"):
        name = str(folder / f"{kind}.warc{'' if kind in ('plain', 'nested') else '.gz'}")
        parts = []
        for i in range(25):
            uri = f"http://H.x:80/{kind}/{i % 20}#f"
            payload = body(rng.randrange(0, 900))
            if kind.startswith("nested") and i % 6 == 2:
                payload = nested if kind == "nested" else b"".join(warc.encoded(f"http://in.x/{j}", 200, "text/html", body(40)) for j in range(20))
            parts.append(warc.encoded(uri, 200 + i % 3, "text/html", payload, compress=kind in ("gz", "nested_gz")))
            want.append((name, uri, payload))
            if i % 5 == 0:
                extra = request(uri)
                parts.append(gzip.compress(extra) if kind in ("gz", "nested_gz") else extra)
        data = b"".join(parts)
        (folder / name.rsplit("/", 1)[1]).write_bytes(gzip.compress(data) if kind == "one" else data)
    return want


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    return folder, archives(folder)


def rows_of(index):
    return sorted((tuple(r[c] for c in FIELDS) for r in index.collect()), key=str)


def test_index_does_not_depend_on_ranges(spark, archive, tmp_path):
    folder, want = archive
    whole = warc_index.build(spark, str(folder), str(tmp_path / "w0"), 1 << 30)
    rows = rows_of(whole)
    for i, size in enumerate((500, 4000)):
        assert rows_of(warc_index.build(spark, f"file:{folder}", str(tmp_path / f"w{i + 1}"), size)) == rows
    got = warc_index.fetch(whole.filter("warc_type = 'response'"))
    assert sorted((r["file"], r["target_uri"], bytes(r["payload"])) for r in got.collect()) == sorted(want)
    scanned = warc.read(spark, str(folder), all_records=True)
    number = lambda df: sorted((r["file"], r["record_no"], r["target_uri"], r["payload_length"]) for r in df.collect())
    assert number(whole) == number(scanned)


def test_nested_archives_are_walked_as_a_whole(spark, archive, tmp_path):
    folder, _ = archive
    warc_index.build(spark, str(folder), str(tmp_path / "w"), 700)
    again = {r["file"].rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "w" / "whole")).select("file").distinct().collect()}
    assert "nested.warc" in again and "one.warc.gz" not in again and "plain.warc" not in again


def test_faulty_files_keep_what_stands_before_the_fault(spark, tmp_path):
    good = [warc.encoded(f"http://a/{i}", 200, "text/html", b"x" * 50) for i in range(4)]
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "cut.warc.gz").write_bytes(b"".join(good)[:-20])
    (folder / "junk.warc.gz").write_bytes(good[0] + good[1] + b"no member at all" + good[2])
    (folder / "odd.warc").write_bytes(b"not an archive\r\n\r\n")
    (folder / "empty.warc").write_bytes(b"")
    (folder / "padded.warc.gz").write_bytes(good[0] + b"\0" * 300 + good[1] + b"\0" * 9)
    for i, size in enumerate((60, 1 << 20)):
        index = warc_index.build(spark, str(folder), str(tmp_path / f"w{i}"), size)
        n = {r["f"]: (r["good"], r["bad"]) for r in index.groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad")).collect()}
        assert n == {"cut.warc.gz": (3, 1), "junk.warc.gz": (2, 1), "odd.warc": (0, 1), "padded.warc.gz": (2, 0)}
        assert warc_index.fetch(index).count() == 7
    assert warc_index.build(spark, str(tmp_path / "nothing"), str(tmp_path / "w9")).count() == 0


def test_a_lookup_reads_one_record(spark, tmp_path):
    pages = spark.range(3000).select(F.concat(F.lit("http://h.x/"), F.md5(F.col("id").cast("string"))).alias("uri"), F.encode(F.repeat(F.sha2(F.col("id").cast("string"), 256), 30), "UTF-8").alias("payload"), F.lit(200).alias("status_code"))
    warc.write(pages.repartition(3), str(tmp_path / "a"))
    index = warc_index.build(spark, str(tmp_path / "a"), str(tmp_path / "w"), 100_000)
    warc_index.save(index, str(tmp_path / "i"), 4)
    stored = warc_index.load(spark, str(tmp_path / "i"))
    asked = pages.limit(1).first()
    found = warc_index.lookup(stored, asked["uri"])
    [row] = found.collect()
    assert bytes(row["payload"]) == bytes(asked["payload"]) and row["bytes_read"] < 1 << 17
    files = [stores.Raw(f).size() for f, _ in stores.listed(str(tmp_path / "a"), (".gz",))]
    assert sum(files) > 1 << 17
    narrow = stored.filter(F.col("norm_uri") == row["norm_uri"])
    narrow.collect()
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(norm_uri," in plan
    # Sorted by URL: one of the index's files can hold it, by the statistics that the scan uses.
    spans = stored.groupBy(F.input_file_name().alias("f")).agg(F.min("norm_uri").alias("a"), F.max("norm_uri").alias("b")).collect()
    assert len(spans) >= 2 and sum(s["a"] <= row["norm_uri"] <= s["b"] for s in spans) == 1
    assert warc_index.lookup(stored, "http://nowhere/").collect() == []
    some = pages.limit(5).select(F.col("uri").alias("url"), F.lit(1).alias("n"))
    assert sorted(bytes(r["payload"]) for r in warc_index.answers(some, stored).collect()) == sorted(bytes(r["payload"]) for r in pages.limit(5).collect())


def test_page_lists_keep_bad_lines_apart(spark, tmp_path):
    lines = ['{"format": "json-pages-1.0"}', '{"url": "http://a/", "title": "T"}', "{broken", "", '["url"]', '{"title": "no url"}', '{"url": "http://b/"}']
    with zipfile.ZipFile(tmp_path / "c.wacz", "w") as z:
        z.writestr(warc.PAGES, "\n".join(lines))
    with zipfile.ZipFile(tmp_path / "none.wacz", "w") as z:
        z.writestr("archive/x.warc", b"")
    (tmp_path / "broken.wacz").write_bytes(b"PK no")
    got = sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["url"], r["title"], r["error"]) for r in warc.container_pages(spark, str(tmp_path)).collect())
    assert got == sorted([("c.wacz", 2, "http://a/", "T", None), ("c.wacz", 3, None, None, "NOT_JSON"), ("c.wacz", 5, None, None, "NOT_AN_OBJECT"), ("c.wacz", 6, None, None, "NO_URL"), ("c.wacz", 7, "http://b/", None, None), ("broken.wacz", None, None, None, "BROKEN_CONTAINER")])


def test_written_containers_are_read_back(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("container"), F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("uri"), F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"))
    rows = rows.withColumn("page_line", F.to_json(F.struct(F.col("uri").alias("url"))))
    path = str(tmp_path / "w")
    assert sorted((r["file"].rsplit("/", 1)[1], r["n_pages"]) for r in warc.write_containers(rows, path).collect()) == [("c0.wacz", 20), ("c1.wacz", 20), ("c2.wacz", 20)]
    assert sorted(r["url"] for r in warc.container_pages(spark, path).collect()) == sorted(r["uri"] for r in rows.collect())
    assert warc.read(spark, path).filter("target_uri = 'http://x/7'").first()["payload"] == b"7"
    assert json.loads(rows.first()["page_line"])["url"].startswith("http://x/")


def test_index_after_functions_of_its_neighbours_were_used(spark, archive, tmp_path):
    """What is sent to executors must not drag in functions that hold a handle of this session."""
    folder, want = archive
    assert warc.read(spark, str(folder)).select(warc.decoded("payload").alias("t")).filter("t IS NOT NULL").count() == len(want)
    index = warc_index.build(spark, str(folder), str(tmp_path / "w"), 3000)
    assert warc_index.fetch(index.filter("warc_type = 'response'")).count() == len(want)
