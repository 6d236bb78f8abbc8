"""An offset index of WARC archives: built from byte ranges of files, stored in the order of URLs, answered by one seek for each record.

Building. Files are cut in ranges of about RANGE_BYTES; a range owns the records (of a .gz file: the members) that begin in it. A task finds
the first plausible beginning in its range and walks from there, member by member, past the end of the range to the next beginning. Ranges of a file must
then chain: each begins where the ones before it ended, the last ends with the file. What looks like a beginning inside a
payload (an archive inside an archive) breaks the chain; such a file, a malformed one, and one whose records share one member, is walked
again as a whole. So the index does not depend on the size of ranges.

Rows: file, offset and length of the member, inner (which record of the member, from 0), record_no (from 1 in each file), the record's and its answer's fields,
and error: a file that cannot be read to its end has, after the records before it, one row with the error and no URL.

A stored index is range-partitioned and sorted by normalised URL, with small row groups, so a look-up reads a few pages of it by their statistics. An
empty folder gives an empty index.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from .warc import records
from .stores import Raw, listed

RANGE_BYTES = 64 << 20
SUFFIXES = (".warc", ".warc.gz")
ROW_GROUP_BYTES = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_HEAD = 1 << 16
_FIELDS = "warc_type string, target_uri string, record_id string, warc_date string, status_code int, content_type string, payload_length bigint"
#: Of a range: kind 'range' with begin (null: nothing begins in it), stop (where the range ends) and reached (where the next record begins).
_WALKED = f"kind string, file string, range_no int, size bigint, offset bigint, length bigint, inner_no int, place bigint, stop bigint, error string, {_FIELDS}"
_NAMES = [c.split()[0] for c in _WALKED.split(", ")]


class _Member(io.RawIOBase):
    """One gzip member of a file, from the file's place on. At its end, `beyond` bytes after it have been read too."""

    def __init__(self, raw: Raw) -> None:
        self.raw, self.data, self.engine = raw, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.data and not self.engine.eof:
            source = self.engine.unconsumed_tail or self.raw.read(_HEAD)
            if not source:
                raise EOFError("a compressed member ends before its end")
            self.data = self.engine.decompress(source, 1 << 20)
        n = min(len(buffer), len(self.data))
        buffer[:n], self.data = self.data[:n], self.data[n:]
        return n

    @property
    def beyond(self) -> int:
        return len(self.engine.unused_data)


def _plausible(raw: Raw, at: int, compressed: bool) -> bool:
    """Whether a record seems to begin at a place."""
    raw.seek(at)
    head = raw.read(_HEAD) or b""
    if compressed:
        try:
            head = zlib.decompressobj(31).decompress(head, _HEAD)
        except zlib.error:
            return False
    fields, end, _ = head.partition(b"\r\n\r\n")
    return fields.startswith(b"WARC/") and (not end or b"content-length:" in fields.lower())


def first_beginning(raw: Raw, at: int, stop: int, compressed: bool) -> int | None:
    """The first place in [at, stop) where a record seems to begin."""
    mark = _MAGIC if compressed else b"WARC/"
    place = at
    while place < stop:
        raw.seek(max(0, place - 1))
        data = raw.read(min(1 << 20, stop - place) + len(mark) + 1) or b""
        skipped = place - max(0, place - 1)
        found = data.find(mark, skipped)
        while 0 <= found:
            here = max(0, place - 1) + found
            if here >= stop:
                return None
            if (compressed or here == 0 or data[found - 1 : found] == b"\n") and _plausible(raw, here, compressed):
                return here
            found = data.find(mark, found + 1)
        if place + (1 << 20) >= stop or not data:
            return None
        place += 1 << 20
    return None


def _fields(row: tuple) -> tuple:
    return (row[2], row[3], row[4], row[5], row[6], row[7], row[9])


def walk(raw: Raw, name: str, begin: int, stop: int, compressed: bool) -> Iterator[tuple]:
    """(offset, length, inner, fields) of the records that begin in [begin, stop), then (next beginning, None, None, None). begin is a beginning, or the file's end."""
    at, size = begin, raw.size()
    while at < min(stop, size):
        raw.seek(at)
        if compressed:
            member = _Member(raw)
            rows = [_fields(r) for r in records(io.BufferedReader(member), name, False, True)]
            end = raw.tell() - member.beyond
        else:
            stream = io.BufferedReader(raw)
            rows = [_fields(r) for r in islice(records(stream, name, False, True), 1)]
            end = stream.tell()
            stream.detach()
        if not rows:
            raise ValueError(f"no record at {at}")
        after = _skipped(raw, end, b"\0" if compressed else b"\r\n")
        for inner, fields in enumerate(rows):
            yield at, end - at, inner, fields
        at = after
    yield at, None, None, None


def _skipped(raw: Raw, at: int, filler: bytes) -> int:
    """The first place from `at` on that holds no filler."""
    while True:
        raw.seek(at)
        data = raw.read(64) or b""
        left = data.lstrip(filler)
        at += len(data) - len(left)
        if left or not data:
            return at


def _walker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (file, range_no, size, begin, stop) -> their records and one row for the range. begin null: the first one that is found from start on."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
        types = [kinds[c.split()[1]] for c in _WALKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)

    none = (None,) * len(_FIELDS.split(", "))
    for batch in batches:
        for r in batch.to_pylist():
            rows, name, key = [], r["file"], (r["file"], r["range_no"], r["size"])
            compressed, place, begin, reached, error = name.endswith(".gz"), 0, None, None, None
            try:
                with Raw(name) as raw:
                    begin = r["start"] if r["whole"] else first_beginning(raw, r["start"], r["stop"], compressed)
                    if begin is not None:
                        reached = begin
                        for offset, length, inner, fields in walk(raw, name, begin, r["stop"], compressed):
                            reached = offset
                            if length is not None:
                                rows.append(("record", *key, offset, length, inner, place, None, None, *fields))
                                place += 1
                            if len(rows) >= 5000:
                                yield batch_of(rows)
                                rows = []
            except (ValueError, EOFError, OSError, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
            rows.append(("range", *key, begin, None if error else reached, None, place, r["stop"], error, *none))
            yield batch_of(rows)


def _walked(ranges: DataFrame, n: int, folder: str) -> DataFrame:
    """Ranges (file, range_no, size, start, stop, whole) walked by n tasks, stored as a table in `folder`."""
    ranges.repartition(n, "file", "range_no").mapInArrow(_walker, _WALKED).write.parquet(folder)
    return ranges.sparkSession.read.schema(_WALKED).parquet(folder)


def build(spark: SparkSession, path: str, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The index of all archives at or below path. folder: where the walks are stored; driver and executors share it. The driver lists the files, as for any scan, and gets the names of those that are walked again."""
    found = listed(path, SUFFIXES)
    files = spark.createDataFrame(found, "file string, size bigint")
    cut = files.withColumn("range_no", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("size", F.lit(1)) - 1) / range_bytes).cast("int"))))
    start = F.col("range_no").cast("bigint") * range_bytes
    cut = cut.select("file", "range_no", "size", start.alias("start"), F.least("size", start + range_bytes).alias("stop"), F.lit(False).alias("whole"))
    n = sum(max(1, -(-size // range_bytes)) for _, size in found)
    rows = _walked(cut, max(1, min(n, 10_000)), f"{folder}/ranges")
    again = unchained(rows).join(files, "file").select("file", F.lit(0).alias("range_no"), "size", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("stop"), F.lit(True).alias("whole"))
    names = [r[0] for r in again.select("file").collect()]
    if names:
        whole = _walked(again, min(len(names), 10_000), f"{folder}/whole")
        rows = rows.join(again.select("file"), "file", "left_anti").unionByName(whole)
    return numbered(rows)


def unchained(walked: DataFrame) -> DataFrame:
    """Files whose ranges do not follow one another to the end; of a range, offset is its first beginning and length where the next record begins."""
    before = Window.partitionBy("file").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = walked.filter("kind = 'range'").withColumn("_at", F.coalesce(F.max("length").over(before), F.lit(0)))
    follows = F.when(F.col("offset").isNull(), F.col("_at") >= F.col("stop")).otherwise(F.col("offset") == F.col("_at"))
    whole = ranges.groupBy("file").agg(F.bool_and(F.col("error").isNull() & follows).alias("_ok"), F.coalesce(F.max("length"), F.lit(0)).alias("_end"), F.max("size").alias("_size"))
    return whole.filter(~F.col("_ok") | (F.col("_end") != F.col("_size"))).select("file")


def numbered(rows: DataFrame) -> DataFrame:
    """Index rows from walks: records get their number in the file from the counts of the ranges before."""
    before = Window.partitionBy("file").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.filter("kind = 'range'").select("file", "range_no", F.coalesce(F.sum("place").over(before), F.lit(0)).alias("_before"), F.col("place").alias("_n"), "error")
    number = lambda c: (F.col("_before") + c).cast("int").alias("record_no")
    records = rows.filter("kind = 'record'").drop("error").join(counts, ["file", "range_no"])
    fields = [c.split()[0] for c in _FIELDS.split(", ")]
    good = records.select("file", "offset", "length", "inner_no", number(F.col("place") + 1), *fields, urls.lookup(F.col("target_uri")).alias("norm_uri"), F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _FIELDS.split(", ")]
    bad = counts.filter("error IS NOT NULL").select("file", F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("int").alias("inner_no"), number(F.col("_n") + 1), *none, F.lit(None).cast("string").alias("norm_uri"), "error")
    return good.unionByName(bad)


def save(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store an index in the order of normalised URLs; records of one URL lie together, first ones first."""
    order = ["norm_uri", "target_uri", "file", "record_no"]
    dealt = index.repartitionByRange(partitions, *order) if partitions else index.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _fetcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows in the order of files -> payload and how many bytes were read for it: one seek a record."""
    for batch in batches:
        name, raw = None, None
        for i, (file, offset, inner) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "inner_no")), strict=True)):
            if file != name:
                if raw:
                    raw.close()
                name, raw = file, Raw(file)
            raw.seek(offset)
            before = raw.n_read
            stream = io.BufferedReader(_Member(raw)) if file.endswith(".gz") else io.BufferedReader(raw)
            rows = records(stream, file, True, True)
            for _ in range(inner + 1):
                row = next(rows)
            rows.close()
            if not file.endswith(".gz"):
                stream.detach()
            one = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([row[10]], pa.binary()), pa.array([raw.n_read - before], pa.int64())], [*one.schema.names, "payload", "bytes_read"])
        if raw:
            raw.close()


def fetch(index: DataFrame) -> DataFrame:
    """Index rows with their payload and bytes_read; rows of errors go. Rows of a file are read in its order."""
    rows = index.filter("error IS NULL").sortWithinPartitions("file", "offset", "inner_no")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_fetcher, f"{fields}, payload binary, bytes_read bigint")


def lookup(index: DataFrame, url: str) -> DataFrame:
    """The first record whose URL is `url` as it stands, with its payload: at most one row, read by one seek."""
    normal = index.sparkSession.range(1).select(urls.lookup(F.lit(url))).first()[0]
    return fetch(index.filter((F.col("norm_uri") == normal) & (F.col("target_uri") == url)).orderBy("file", "record_no").limit(1))


def answers(requests: DataFrame, index: DataFrame) -> DataFrame:
    """The last record of each requested URL (url, further columns), by its normalised form, with its payload; requests without one go."""
    last = F.max_by(F.struct(*index.columns), F.struct("file", "record_no"))
    found = index.filter("error IS NULL").groupBy(F.col("norm_uri").alias("_norm")).agg(last.alias("_row"))
    asked = requests.withColumn("_norm", urls.lookup(F.col("url"))).join(found, "_norm")
    return fetch(asked.select(*requests.columns, "_row.*"))
