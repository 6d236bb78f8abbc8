"""Versions of a set of tables, published all at once or not at all.

A version's tables are written to a folder of its own. Its marker, which names that folder, is written whole under another name and then
renamed to the version's number, which fails if there is one: markers appear whole or not at all. Of two writers that build on the same version
one gets its marker in place, the other gets a Conflict. A folder goes only while no marker names it: after a Conflict, or after an error, if
reading the marker again shows that it was not put in place. This takes a store whose rename does not replace files (HDFS, shared file systems)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

MARKERS = "_versions"


class Conflict(RuntimeError):
    """Another version was published in between."""


def _store(spark: SparkSession, path: str):
    """(file system, function from a name to its Path)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def current(spark: SparkSession, path: str) -> int:
    """The number of the last version, 0 if there is none."""
    store, make = _store(spark, path)
    folder = make(f"{path}/{MARKERS}")
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, after: int | None = None) -> int:
    """Write tables as the version that follows `after` (by default the current one) and return its number."""
    store, make = _store(spark, path)
    base = current(spark, path)
    if after is not None and after != base:
        raise Conflict(f"version {base} is there, {after} was expected")
    name = f"version-{base + 1}-{uuid.uuid4().hex}"
    place, draft = store.makeQualified(make(f"{path}/{MARKERS}/{base + 1}")), store.makeQualified(make(f"{path}/{MARKERS}/_{name}"))
    try:
        for table, df in tables.items():
            df.write.parquet(f"{path}/{name}/{table}")
        _put(store, draft, name)
        if not _renamed(spark, store, draft, place) and _named(store, place) != name:
            raise Conflict(f"version {base + 1} was published by another writer")
    except BaseException:
        # Whoever renamed may have got an error for an answer: what counts is what the marker says.
        if _named(store, place) != name:
            store.delete(make(f"{path}/{name}"), True)
            store.delete(draft, False)
        raise
    return base + 1


def _put(store, place, name: str) -> None:
    """Write a new file with the name in it."""
    out = store.create(place, False)
    try:
        out.write(name.encode())
    finally:
        out.close()


def _renamed(spark: SparkSession, store, draft, place) -> bool:
    """Give draft the name `place` unless that is taken; some stores raise then, others say False. Where rename would replace a file (local disks), a link takes its place."""
    try:
        if store.getScheme() != "file":
            return not store.exists(place) and bool(store.rename(draft, place))
        jvm = spark.sparkContext._jvm.java.nio.file
        jvm.Files.createLink(jvm.Paths.get(place.toUri()), jvm.Paths.get(draft.toUri()))
        store.delete(draft, False)
        return True
    except Exception:
        if store.exists(place):
            return False
        raise


def _named(store, place) -> str | None:
    """The folder that a marker names; None if there is no marker."""
    if not store.exists(place):
        return None
    stream = store.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a version, by default of the current one."""
    version = current(spark, path) if version is None else version
    name = spark.read.text(f"{path}/{MARKERS}/{version}").first()[0]
    return spark.read.parquet(f"{path}/{name}/{table}")
