"""WARC and WACZ files as a Spark data source on the standard library: `spark.read.format("warc")`, and a writer.

Options of the reader: `path` (a file, a folder or a glob), `records` = response (default) or all, `payload` = true (default)
or false: without payload the bytes are skipped, not kept; `limit`: a file is left after so many rows. One partition per file; records are read one after another, so
a file never has to fit in memory, and a limit stops the reading. Files lie in any store that `stores` opens, by the executors' own reads;
`warc_index` cuts large files in ranges and finds single records.

Later records of a URL win (`latest`); a malformed status is null; a missing content type is null.
"""

from __future__ import annotations

import contextlib
import glob
import gzip
import hashlib
import io
import json
import os
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import text, urls
from . import stores

SCHEMA = "file string, record_no int, warc_type string, target_uri string, record_id string, warc_date string, status_code int, content_type string, headers map<string,string>, payload_length bigint, payload binary"


def _header_block(stream) -> list[bytes] | None:
    """Lines up to an empty one; None at the end of the stream."""
    lines: list[bytes] = []
    while True:
        line = stream.readline()
        if not line:
            return lines or None
        line = line.rstrip(b"\r\n")
        if not line:
            if lines:
                return lines
            continue  # blank lines between records
        lines.append(line)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, sep, value = line.decode("utf-8", "replace").partition(":")
        if sep:
            out[name.strip()] = value.strip()
    return out


def _get(fields: dict[str, str], name: str) -> str | None:
    return next((v for k, v in fields.items() if k.lower() == name.lower()), None)


def records(stream, name: str, keep_payload: bool = True, all_records: bool = False) -> Iterator[tuple]:
    """Rows of a WARC stream, from its uncompressed bytes. Record numbers count every record, from 1."""
    number = 0
    while (head := _header_block(stream)) is not None:
        number += 1
        if not head[0].startswith(b"WARC/"):
            raise ValueError(f"{name}: record {number} does not begin with a WARC version")
        fields = _fields(head[1:])
        length = int(_get(fields, "Content-Length") or 0)
        kind = _get(fields, "WARC-Type") or ""
        if kind != "response" and not all_records:
            _skip(stream, length)
            continue
        status = mime = None
        headers: dict[str, str] = {}
        used = 0
        if kind == "response":
            block: list[bytes] = []
            while used < length:
                line = stream.readline(length - used)
                used += len(line)
                if not line or line in (b"\r\n", b"\n"):
                    break
                block.append(line.rstrip(b"\r\n"))
            if block:
                part = block[0].split(None, 2)
                status = int(part[1]) if len(part) > 1 and part[1].isdigit() else None
                headers = _fields(block[1:])
                mime = _get(headers, "Content-Type")
        left = length - used
        payload = _read(stream, left) if keep_payload else _skip(stream, left)
        yield (name, number, kind, _get(fields, "WARC-Target-URI"), _get(fields, "WARC-Record-ID"), _get(fields, "WARC-Date"), status, mime, headers, left, payload)


def _read(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise EOFError("a record ends before its length")
    return data


def _skip(stream, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 16)))
        if not got:
            raise EOFError("a record ends before its length")
        n -= got


def _opened(raw, name: str):
    return gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw) if isinstance(raw, io.RawIOBase) else raw


SUFFIXES = (".warc", ".warc.gz", ".wacz")


def files_of(path: str) -> list[str]:
    """WARC and WACZ files below a path or a glob (of local files), sorted."""
    if any(c in path for c in "*?["):
        return sorted(f for f in glob.glob(path.removeprefix("file:"), recursive=True) if f.endswith(SUFFIXES))
    return [f for f, _ in stores.listed(path, SUFFIXES)]


def read_file(path: str, keep_payload: bool = True, all_records: bool = False) -> Iterator[tuple]:
    with stores.Raw(path) as raw:
        if not path.endswith(".wacz"):
            yield from records(_opened(raw, path), path, keep_payload, all_records)
            return
        with zipfile.ZipFile(raw) as z:
            for member in sorted(z.namelist()):
                if member.startswith("archive/") and member.endswith((".warc", ".warc.gz")):
                    with z.open(member) as inner:
                        yield from records(_opened(inner, member), f"{path}!{member}", keep_payload, all_records)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.all = options.get("records", "response").lower() == "all"
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in files_of(self.path)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            yield from islice(read_file(partition.path, self.payload, self.all), self.limit)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    """One file per partition, under a temporary name until the job commits."""

    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        self.folder, self.names, self.gzip, self.overwrite = options["path"], names, options.get("compression", "gzip") == "gzip", overwrite

    def write(self, rows: Iterator) -> _Written:
        system, folder = stores.store(self.folder)
        system.create_dir(folder, recursive=True)
        path = f"{folder.rstrip('/')}/_part-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else "")
        n = 0
        with system.open_output_stream(path, compression=None) as out:
            for row in rows:
                record = row.asDict()
                out.write(encoded(record["uri"], record.get("status_code") or 200, record.get("content_type") or "text/html; charset=utf-8", bytes(record["payload"] or b""), record.get("record_id"), record.get("warc_date"), record.get("warc_headers") or {}, self.gzip))
                n += 1
        if not n:
            system.delete_file(path)
        return _Written(path if n else None)

    def commit(self, messages: list[_Written]) -> None:
        system, folder = stores.store(self.folder)
        if self.overwrite:
            for old in files_of(self.folder):
                system.delete_file(stores.store(old)[1])
        for m in messages:
            if m and m.path:
                system.move(m.path, f"{folder.rstrip('/')}/{os.path.basename(m.path)[1:]}")

    def abort(self, messages: list[_Written]) -> None:
        system, _ = stores.store(self.folder)
        for m in messages:
            if m and m.path:
                with contextlib.suppress(FileNotFoundError):
                    system.delete_file(m.path)


def encoded(uri: str, status: int, mime: str, payload: bytes, record_id: str | None = None, date: str | None = None, more: dict[str, str] | None = None, compress: bool = True) -> bytes:
    """One response record; a gzip member of its own if compressed. Without id and date both follow from the content, so that a repeated task writes the same bytes."""
    http = f"HTTP/1.1 {status} {'OK' if status == 200 else 'Response'}\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    record_id = record_id or f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(uri.encode() + payload).digest()[:16])}>"
    date = date or datetime.fromtimestamp(0, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}"} | (more or {}) | {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(payload))}
    data = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + http + payload + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, all_records: bool = False, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("records", "all" if all_records else "response").option("payload", str(payload).lower()).load(path)


def write(rows: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Write rows (uri, payload[, status_code, content_type, record_id, warc_date, warc_headers]); returns their provenance."""
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").option("compression", "gzip" if compress else "none").save(path)
    return rows.select("uri", F.sha2("payload", 256).alias("payload_sha256"), F.octet_length("payload").alias("payload_length"))


def harvest(downloads: DataFrame) -> DataFrame:
    """Rows for `write` from a fetch log (url, status_code, content_type, resource_type, payload): failed and empty ones go; the role stands in a header of its own."""
    role = F.when(F.col("resource_type") == "html", "primary-content").otherwise(F.concat(F.lit("supporting-asset-"), F.col("resource_type")))
    kept = downloads.filter((F.col("status_code") != 0) & (F.octet_length("payload") > 0))
    return kept.select(F.col("url").alias("uri"), "status_code", "content_type", "payload", F.create_map(F.lit("WARC-Target-Role"), role).alias("warc_headers"))


def resources(rows: DataFrame) -> DataFrame:
    """The archive's index: per normalised URL its last record."""
    keyed = rows.filter("target_uri IS NOT NULL").withColumns({"norm_uri": urls.lookup(F.col("target_uri")), "status_code": F.coalesce("status_code", F.lit(200)), "content_type": F.coalesce("content_type", F.lit("application/octet-stream"))})
    last = Window.partitionBy("norm_uri").orderBy(F.desc("file"), F.desc("record_no"))
    return keyed.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def lookup(rows: DataFrame, url: str) -> DataFrame:
    """The first record whose URL is `url` as it stands: at most one row."""
    return rows.filter(F.col("target_uri") == url).orderBy("file", "record_no").limit(1)


def replayed(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Each request (request_no, url) with the resource that answers it: by its normalised URL, else by that with the slash toggled, else by host, path and query whatever the scheme; a miss is a 404."""
    r = requests.withColumn("_norm", urls.lookup(F.col("url")))
    i = index.select("norm_uri", F.col("status_code").alias("_status"), F.col("record_id").alias("_record"))
    loose = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    by_loose = i.groupBy(loose(F.col("norm_uri")).alias("_loose")).agg(F.min(F.struct("norm_uri", "_status", "_record")).alias("c"))
    hit = lambda name: F.struct("norm_uri", "_status", "_record").alias(name)
    r = r.join(i.select(F.col("norm_uri").alias("_norm"), hit("a")), "_norm", "left")
    r = r.withColumn("_toggled", urls.toggled_slash(F.col("_norm"))).join(i.select(F.col("norm_uri").alias("_toggled"), hit("b")), "_toggled", "left")
    r = r.withColumn("_loose", loose(F.col("_norm"))).join(by_loose, "_loose", "left")
    found = F.coalesce("a", "b", "c")
    return r.select("request_no", "url", found["norm_uri"].alias("norm_uri"), F.coalesce(found["_status"], F.lit(404)).alias("status_code"), F.when(found.isNull(), "RESOURCE_NOT_IN_ARCHIVE").otherwise("FOUND").alias("outcome"))


def html_records(rows: DataFrame, loose: bool = True) -> DataFrame:
    """Records that hold pages: by a loose test of their type, or strictly by type, status and size."""
    if loose:
        return rows.filter((F.col("warc_type") == "response") & text.loose_html(F.col("content_type")))
    return rows.filter(text.usable_html(F.col("warc_type"), F.col("status_code"), F.col("content_type"), F.col("payload_length")))


@F.pandas_udf(StringType())
def decoded(payload: pd.Series) -> pd.Series:
    """UTF-8, or Latin-1 where that fails; Latin-1 never fails."""

    def one(b: bytes) -> str:
        try:
            return bytes(b).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(b).decode("latin-1")

    return payload.map(one, na_action="ignore")


def categories(rows: DataFrame) -> DataFrame:
    """Number of records of each content category, all of them listed."""
    spark = rows.sparkSession
    n = rows.groupBy(text.content_category(F.col("warc_type"), F.col("content_type"), F.col("target_uri")).alias("category")).agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(c,) for c in text.CATEGORIES], "category string")
    return domain.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def validated(path: str) -> dict:
    """Whether a file can be read to its end: valid, error, size, sha256, total and html record counts; for one file, on the caller's machine."""
    out = {"valid": False, "error": None, "size": 0, "sha256": None, "total": 0, "html": 0}
    try:
        raw = stores.Raw(path)
    except FileNotFoundError:
        return out | {"error": "FILE_NOT_FOUND"}
    with raw:
        out["size"] = raw.size()
        if not out["size"]:
            return out | {"error": "EMPTY_FILE"}
        digest = hashlib.sha256()
        while chunk := raw.read(1 << 16):
            digest.update(chunk)
    out["sha256"] = digest.hexdigest()
    try:
        for r in read_file(path, keep_payload=False, all_records=True):
            out["total"] += 1
            out["html"] += r[2] == "response" and any(t in (r[7] or "").lower() for t in ("text/html", "xhtml"))
    except (ValueError, EOFError, OSError, zlib.error, zipfile.BadZipFile) as e:
        return out | {"error": f"PARSE_ERROR: {e}"}
    return out | {"valid": True}


def validations(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """`validated` of every file below a path, and of the expected ones (file) that are not there; one file is one row of work, read by the executors."""
    rows = spark.createDataFrame([(n,) for n in files_of(path)], "file string")
    rows = (rows if expected is None else rows.unionByName(expected.select("file")).distinct()).repartition("file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"file": f} | validated(f) for f in batch["file"]], columns=["file", "valid", "error", "size", "sha256", "total", "html"])

    return rows.mapInPandas(run, "file string, valid boolean, error string, size bigint, sha256 string, total bigint, html bigint")


PAGES = "pages/pages.jsonl"


def page_lines(path: str) -> Iterator[tuple]:
    """(line_no, url, title, error) of a container's page list, read line by line: a line that is no JSON object or has no URL has an error; the heading line (with a format and no URL) is passed over."""
    with stores.Raw(path) as raw, zipfile.ZipFile(raw) as z:
        if PAGES not in z.namelist():
            return
        with z.open(PAGES) as lines:
            for n, line in enumerate(lines, 1):
                if not line.strip():
                    continue
                try:
                    row = json.loads(line.decode("utf-8", "replace"))
                except ValueError:
                    yield n, None, None, "NOT_JSON"
                    continue
                if not isinstance(row, dict):
                    yield n, None, None, "NOT_AN_OBJECT"
                elif row.get("url"):
                    yield n, str(row["url"]), None if row.get("title") is None else str(row["title"]), None
                elif "format" not in row:
                    yield n, None, None, "NO_URL"


def container_pages(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, url, title and error of the page lists of all WACZ files at or below a path, read by the executors; a broken container is one row with an error and no line."""
    files = spark.createDataFrame([(f,) for f in files_of(path) if f.endswith(".wacz")], "file string").repartition("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "line_no", "url", "title", "error"]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                try:
                    for row in page_lines(file):
                        rows.append((file, *row))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError):
                    rows.append((file, None, None, None, "BROKEN_CONTAINER"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.mapInArrow(run, "file string, line_no int, url string, title string, error string")


def write_containers(rows: DataFrame, path: str) -> DataFrame:
    """Write each group of rows (container, page_line, uri, payload[, seq, status_code, content_type]) as one WACZ file, its page list in the order of uri, rows of one uri in that of seq, then of page_line; returns file and n_pages. A task streams its groups, so a container is never held whole."""
    columns = [c for c in ("container", "page_line", "uri", "payload", "seq", "status_code", "content_type") if c in rows.columns]
    order = [c for c in ("container", "uri", "seq", "page_line") if c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = stores.store(path)
        system.create_dir(folder, recursive=True)
        name, z, archive, pages, n = None, None, None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if z is not None:
                archive.close()
                z.writestr(PAGES, "\n".join(['{"format": "json-pages-1.0", "id": "pages"}', *pages, ""]))
                z.close()
                out.close()
                system.move(f"{folder.rstrip('/')}/_{name}.wacz", f"{folder.rstrip('/')}/{name}.wacz")
                yield pa.RecordBatch.from_arrays([pa.array([f"{path.rstrip('/')}/{name}.wacz"]), pa.array([n], pa.int64())], ["file", "n_pages"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["container"] != name:
                    yield from close()
                    name, pages, n = r["container"], [], 0
                    out = system.open_output_stream(f"{folder.rstrip('/')}/_{name}.wacz", compression=None)
                    z = zipfile.ZipFile(out, "w")
                    archive = z.open("archive/data.warc.gz", "w", force_zip64=True)
                archive.write(encoded(r["uri"], r.get("status_code") or 200, r.get("content_type") or "text/html; charset=utf-8", bytes(r["payload"] or b"")))
                pages.append(r["page_line"])
                n += 1
        yield from close()

    return rows.select(*columns).repartition("container").sortWithinPartitions(*order).mapInArrow(run, "file string, n_pages bigint")


def sample_split(pages: DataFrame, url: str = "url", sizes: tuple[int, int, int] = (3, 2, 1)) -> DataFrame:
    """The first pages by URL in three disjoint parts: generation, validation, held_out; an error if there are too few."""
    total = sum(sizes)
    first = pages.orderBy(url).limit(total)
    ranked = first.withColumn("_n", F.row_number().over(Window.orderBy(url)))
    if (n := first.count()) < total:
        raise ValueError(f"{total} pages are needed, there are {n}")
    part = F.when(F.col("_n") <= sizes[0], "generation").when(F.col("_n") <= sizes[0] + sizes[1], "validation").otherwise("held_out")
    return ranked.withColumn("part", part).drop("_n")
