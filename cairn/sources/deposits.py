"""A repository of deposits as a sink: `df.write.format("deposit")`, staged by tasks, published by one rename a deposit, never twice.

Rows are files: portal_id, run_id, filename, payload and sha256 (the expected digest, or null). A deposit is a (portal_id, run_id) with all its files, and
lies in one task: `deposit` deals and sorts rows so. A task writes a deposit's files and its receipt to a staging folder of its own and reports
one line for it, in a file of the staging folder; the driver gets the file's name. Of a deposit that will not be published, or whose receipt is in the repository
already, it keeps the line only. The commit reads the lines of all tasks merged by key, checks each deposit's quota, digests and names, and renames its folder, receipt included, to its place:
a deposit appears whole or not at all. Where one is there already, the receipt decides: the same fingerprint (SHA-256 of its sorted manifest lines)
returns that receipt, another one is a changed package and is left alone. A failed job, and a failed attempt of a task, leave nothing but staging, which
goes with the commit or abort; the job can be run again, and deposits that a broken commit had published are returned then.

Outcomes: PUBLISHED, RECEIPT_RETURNED, CHANGED_PACKAGE, OVER_QUOTA, DIGEST_MISMATCH, UNSAFE_NAME, REPEATED_NAME. The driver holds one line of each task at a time, a task
holds one file and one deposit's list of names, which the quota bounds."""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import asdict, dataclass
from itertools import chain, pairwise
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.integrity import MAX_FILE_BYTES, MAX_FILES, MAX_TOTAL_BYTES
from .stores import folders, store

ROWS = "portal_id string, run_id string, filename string, payload binary, sha256 string"
OUTCOME = "portal_id string, run_id string, outcome string, package_fingerprint string, n_files bigint, total_bytes bigint"
RECEIPT = "portal_id string, run_id string, status string, package_fingerprint string, n_files bigint, total_bytes bigint, files array<struct<filename:string,size:bigint,md5:string,sha256:string>>"
#: Characters of names or receipts that a task holds before it gives them out.
CHUNK = 1 << 20


@dataclass
class _Staged:
    """One deposit of a task, before anyone has judged it."""

    portal_id: str
    run_id: str
    folder: str
    n_files: int = 0
    total_bytes: int = 0
    largest: int = 0
    fault: str | None = None
    fingerprint: str = ""


@dataclass
class _Message(WriterCommitMessage):
    """Where a task's lines are, one for each of its deposits in the order of their keys; none if it had no rows."""

    lines: str | None

    @property
    def deposits(self) -> list[_Staged]:
        return list(_staged(self.lines))


def _staged(lines: str | None) -> Iterator[_Staged]:
    """The deposits of a task, read line by line."""
    if lines is not None:
        system, path = store(lines)
        with system.open_input_stream(path, compression=None) as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as text:
            for line in text:
                yield _Staged(**json.loads(line))


def _key(d: _Staged) -> tuple:
    """Spark's order of (portal_id, run_id): null first, then by code points."""
    return d.portal_id is not None, d.portal_id or "", d.run_id is not None, d.run_id or ""


def _place(root: str, d: _Staged) -> str:
    return f"{root}/{quote(d.portal_id, safe='')}/{quote(d.run_id, safe='')}"


def safe_name(name: str | None) -> bool:
    """A relative path that stays inside its folder and is not the receipt's."""
    parts = (name or "").replace("\\", "/").split("/")
    return bool(name) and name != "receipt.json" and all(p not in ("", ".", "..") for p in parts) and ":" not in parts[0]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.job = options["path"].rstrip("/"), options.get("job") or uuid.uuid4().hex
        self.limits = tuple(int(options.get(k, v)) for k, v in (("maxfiles", MAX_FILES), ("maxfilebytes", MAX_FILE_BYTES), ("maxtotalbytes", MAX_TOTAL_BYTES)))
        self.staging = f"{self.path}/_staging/{self.job}"

    def over(self, d: _Staged) -> bool:
        files, one, total = self.limits
        return d.n_files > files or d.largest > one or d.total_bytes > total

    def write(self, rows: Iterator) -> _Message:
        system, root = store(self.staging)
        name, lines = f"_lines-{uuid.uuid4().hex}", None
        here, files, there = None, {}, False

        def close() -> None:
            self._close(system, here, files, there)
            if here is not None:
                lines.write((json.dumps(asdict(here)) + "\n").encode())

        for row in rows:
            if here is None or (row.portal_id, row.run_id) != (here.portal_id, here.run_id):
                close()
                last, (here, files) = here, (_Staged(row.portal_id, row.run_id, f"{root}/{uuid.uuid4().hex}"), {})
                if last is not None and _key(last) > _key(here):
                    raise ValueError("a task's rows are not in the order of their deposits; deal them with deposits.deposit")
                there = self._stands(system, here)
                system.create_dir(root if there else here.folder, recursive=True)
                lines = lines or system.open_output_stream(f"{root}/{name}", compression=None)
            data = bytes(row.payload or b"")
            here.n_files, here.total_bytes, here.largest = here.n_files + 1, here.total_bytes + len(data), max(here.largest, len(data))
            digest = hashlib.sha256(data).hexdigest()
            fault = "UNSAFE_NAME" if not safe_name(row.filename) else "REPEATED_NAME" if row.filename in files else "DIGEST_MISMATCH" if row.sha256 is not None and row.sha256.lower() != digest else None
            here.fault = here.fault or fault
            if here.fault or self.over(here):
                continue  # it will not be published: counted on, not kept
            if not there:
                place = f"{here.folder}/{row.filename}"
                if "/" in row.filename:
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place, compression=None) as out:
                    out.write(data)
            files[row.filename] = {"filename": row.filename, "size": len(data), "md5": hashlib.md5(data).hexdigest(), "sha256": digest}
        close()
        if lines is None:
            return _Message(None)
        lines.close()
        return _Message(f"{self.staging}/{name}")

    def _stands(self, system, d: _Staged) -> bool:
        """Whether the repository has this deposit's receipt, which stays: then its files are read for the fingerprint only. Where that can't be told, the commit will say."""
        with suppress(OSError, ValueError):
            return None not in (d.portal_id, d.run_id) and receipt_of(system, _place(store(self.path)[1], d)) is not None
        return False

    def _close(self, system, d: _Staged | None, files: dict, there: bool) -> None:
        """Write the receipt of a deposit whose rows have all come; what was staged of one that will not be published goes."""
        if d is None:
            return
        if d.fault or self.over(d):
            if not there:
                system.delete_dir(d.folder)
            return
        listed = [files[n] for n in sorted(files)]
        d.fingerprint = hashlib.sha256("".join(f"{f['sha256']}  {f['filename']}\n" for f in listed).encode()).hexdigest()
        if there:
            return
        receipt = {"portal_id": d.portal_id, "run_id": d.run_id, "status": "PUBLISHED", "package_fingerprint": d.fingerprint, "n_files": d.n_files, "total_bytes": d.total_bytes, "files": listed}
        with system.open_output_stream(f"{d.folder}/receipt.json", compression=None) as out:
            out.write(json.dumps(receipt, ensure_ascii=False).encode())

    def commit(self, messages: list[_Message]) -> None:
        system, root = store(self.path)
        # One deposit of each task at a time: lines of all tasks merge in the order of their keys.
        merged = lambda: heapq.merge(*(_staged(m.lines) for m in messages if m), key=_key)
        if any(_key(a) == _key(b) for a, b in pairwise(merged())):
            self._cleared(system)
            raise ValueError("a deposit's rows are spread over tasks; deal them with deposits.deposit")
        _, staging = store(self.staging)
        for folder in (staging, f"{root}/_jobs"):
            system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{staging}/_outcomes.json", compression=None) as out:
            for d in merged():
                outcome, fingerprint = self._published(system, root, d)
                out.write((json.dumps({"portal_id": d.portal_id, "run_id": d.run_id, "outcome": outcome, "package_fingerprint": fingerprint or None, "n_files": d.n_files, "total_bytes": d.total_bytes}, ensure_ascii=False) + "\n").encode())
        system.move(f"{staging}/_outcomes.json", f"{root}/_jobs/{self.job}.json")
        self._cleared(system)

    def _published(self, system, root: str, d: _Staged) -> tuple[str, str]:
        """(outcome, fingerprint of what stands in the repository, or would have)."""
        if self.over(d):
            return "OVER_QUOTA", d.fingerprint
        if d.fault:
            return d.fault, d.fingerprint
        place = _place(root, d)
        there = receipt_of(system, place)
        if there is None:
            system.create_dir(place.rpartition("/")[0], recursive=True)
            try:
                system.move(d.folder, place)
                return "PUBLISHED", d.fingerprint
            except OSError:
                there = receipt_of(system, place)  # another job was faster, or the answer got lost
                if there is None:
                    raise
        return "RECEIPT_RETURNED" if there["package_fingerprint"] == d.fingerprint else "CHANGED_PACKAGE", there["package_fingerprint"]

    def abort(self, messages: list[_Message]) -> None:
        self._cleared(store(self.path)[0])

    def _cleared(self, system) -> None:
        from pyarrow.fs import FileType

        _, folder = store(self.staging)
        if system.get_file_info(folder).type == FileType.Directory:
            system.delete_dir(folder)


def receipt_of(system, place: str) -> dict | None:
    try:
        with system.open_input_stream(f"{place}/receipt.json") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


class DepositSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deposit"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("deposits are never overwritten; write in append mode")
        return _Writer(self.options)


@contextmanager
def _shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Queries that begin here leave no shuffle files; else payloads stay on disk a second time until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def deposit(files: DataFrame, path: str, **limits: int) -> DataFrame:
    """Publish files (portal_id, run_id, filename, payload[, sha256]) as deposits below path; one outcome for each. limits: max_files, max_file_bytes, max_total_bytes."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(DepositSource)
    expected = F.col("sha256") if "sha256" in files.columns else F.lit(None).cast("string")
    rows = files.select(F.col("portal_id").cast("string"), F.col("run_id").cast("string"), F.col("filename").cast("string"), F.col("payload").cast("binary"), expected.cast("string").alias("sha256"))
    dealt = rows.repartition("portal_id", "run_id").sortWithinPartitions("portal_id", "run_id", "filename")
    writer = dealt.write.format("deposit").mode("append").option("job", job)
    for name, value in limits.items():
        writer = writer.option(name.replace("_", ""), value)
    with _shuffles_cleared(spark):
        writer.save(path)
    return spark.read.schema(OUTCOME).json(f"{path.rstrip('/')}/_jobs/{job}.json")


def _batched(values: Iterator[str], name: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about CHUNK characters."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size >= CHUNK:
            yield pa.RecordBatch.from_pydict({name: pa.array(held, pa.string())})
            held, size = [], 0
    yield pa.RecordBatch.from_pydict({name: pa.array(held, pa.string())})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    return (place for batch in batches for place in batch.column(0).to_pylist())


def _portals(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (name for batch in batches for _ in range(batch.num_rows) for name in folders(path))
        yield from _batched((name for name in names if name not in ("_jobs", "_staging")), "place")

    return run


def _runs(path: str) -> Callable:
    """Each portal's folder, which an empty id makes a deposit's place too, and those below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((place for portal in _places(batches) for place in chain([portal], (f"{portal}/{name}" for name in folders(f"{path}/{portal}")))), "place")

    return run


def _receipts(path: str) -> Callable:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        system, root = store(path)
        for place in _places(batches):
            with suppress(FileNotFoundError), system.open_input_stream(f"{root}/{place}/receipt.json", compression=None) as f:
                yield f.read().decode("utf-8", "replace")

    return lambda batches: _batched((text for text in found(batches) if text.strip()), "value")


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """The receipts of all deposits below path. Tasks list the portals, then each portal's runs, and read the receipts: the driver holds no list of files, and payloads are not listed."""
    path, n = path.rstrip("/"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    portals = spark.range(0, 1, 1, 1).mapInArrow(_portals(path), "place string").repartition(n, "place")
    places = portals.mapInArrow(_runs(path), "place string").repartition(n, "place")
    return places.mapInArrow(_receipts(path), "value string").select(F.from_json("value", RECEIPT).alias("r")).select("r.*")
