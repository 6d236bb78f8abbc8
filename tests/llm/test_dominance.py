"""Dominance counting against counting all pairs, its range sums, and hard rows."""

import random
import zlib
from datetime import datetime, timedelta

import duckdb
import pytest

from cairn.llm import dominance
from pyspark.sql import functions as F

SCHEMA = "sale_id long, total double, sold_at timestamp_ntz, slot string, level string, n long, block int, asks int, part int"


def make(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def plain(rows):
    """(sale_id, slot, level, n_sales, n_rows) by comparing all rows."""
    import math

    placed = []
    for sale, total, at in rows:
        slot = None if at is None else (at - datetime(1970, 1, 1)) // timedelta(hours=1)
        level = None if total is None or not math.isfinite(total) or abs(total) > 9e18 else math.floor(math.floor(100 * total + 0.5) / 100)
        placed.append((sale, slot, level, 1 + zlib.crc32(b"" if sale is None else str(sale).encode()) % 2))
    out = []
    for sale, slot, level, _ in placed:
        if slot is None or level is None:
            out.append((sale, slot, level, None, None))
            continue
        above = [w for _, s, v, w in placed if s is not None and v is not None and s <= slot and v > level]
        out.append((sale, slot, level, len(above), sum(above)))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    return sorted((tuple(r) for r in dominance.count_sales(make(spark, rows, parts)).collect()), key=str)


def sample(seed, n, hours, levels):
    rng = random.Random(seed)
    at = lambda: datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(hours * 3600))
    return [(i, None if rng.random() < 0.02 else rng.randrange(levels * 100) / 100, None if rng.random() < 0.02 else at()) for i in range(n)]


@pytest.mark.parametrize(("n", "hours", "levels"), [(400, 200, 60), (500, 3, 4), (300, 1, 500), (300, 5000, 1), (1, 1, 1)])
def test_equals_comparing_all_rows(spark, n, hours, levels):
    rows = sample(n, n, hours, levels)
    assert found(spark, rows) == plain(rows)


def test_hard_rows(spark):
    t = datetime(2024, 3, 10, 2, 30)  # an hour that some zones skip
    rows = [(1, 5.0, t), (1, 5.0, t), (1, 5.0, t), (None, 9.5, t), (None, None, None), (2, None, t), (3, 7.0, None), (4, float("nan"), t), (5, float("inf"), t), (6, -float("inf"), t), (7, 1e300, t), (8, 1e17, t), (9, -3.999, t)]
    rows += [(10, 5.0, datetime(1969, 12, 31, 23, 59, 59)), (11, 4.995, datetime(1970, 1, 1)), (12, 4.994, datetime(1899, 1, 1, 0, 0, 1)), (13, 6.0, datetime(2262, 1, 1)), (-14, 0.0, t)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, rows[4:8]) == plain(rows[4:8])


def test_hot_pair_and_any_number_of_ranges(spark, monkeypatch):
    t = datetime(2024, 2, 1)
    rows = [(i, 40.0, t) for i in range(700)] + [(1000 + r[0], *r[1:]) for r in sample(3, 500, 300, 80)]
    want = plain(rows)
    for size in (1 << 22, 50):  # with small ranges, blocks go over many of them
        monkeypatch.setattr(dominance, "RANGE_ROWS", size)
        assert found(spark, rows) == want


def test_times_ignore_the_session_zone(spark):
    rows = sample(9, 200, 2000, 30)
    want = plain(rows)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert found(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    instants = make(spark, rows).withColumn("sold_at", F.col("sold_at").cast("timestamp"))
    assert sorted((tuple(r) for r in dominance.count_sales(instants).collect()), key=str) == want


def test_blocks_of_a_prefix_cover_it_once(spark):
    n = 70
    points = spark.range(n).select("id", F.explode(dominance._ancestors(F.col("id"), 7)).alias("block"))
    asked = spark.range(n).select(F.col("id").alias("x"), F.explode(dominance._prefix(F.col("id"), 7)).alias("block"))
    assert sorted(tuple(r) for r in asked.join(points, "block").select("x", "id").collect()) == [(x, i) for x in range(n) for i in range(x + 1)]


def test_equals_sql(spark):
    rows = sample(21, 600, 100, 40)
    con = duckdb.connect()
    con.sql("CREATE TABLE sales (sale_id BIGINT, total DOUBLE, sold_at TIMESTAMP)")
    con.executemany("INSERT INTO sales VALUES (?, ?, ?)", rows)
    assert sorted(con.sql(dominance.ORACLE).fetchall(), key=str) == found(spark, rows)
