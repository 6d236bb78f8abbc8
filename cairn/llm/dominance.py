"""Dominance counting by a distributed range tree: for each point, how many others have a smaller or equal slot and a strictly larger level.

1. Rows are counted by (slot, level) first, with a partial sum before the exchange; a pair that holds a third of all rows is one row from then on.
2. Slots are counted from the smallest. A pair emits its dyadic ancestors: the blocks [i * 2^h, (i + 1) * 2^h) that hold its slot.
   Only blocks of even i can be part of a prefix, so the others are left out. A pair also asks the canonical blocks
   of the prefix that ends with its slot, one for each bit of its length.
3. All these rows are sorted by (block, level from above, questions before points of the same level, slot), by ranges of that whole key:
   a large block takes as many tasks as its rows need, and no key is heavy, since (block, level, slot) occurs once in either role.
   Each task keeps running sums along its range, for one block at a time, and remembers the sum of its last block.
   What a question lacks is the sum of its block in earlier ranges: one number for each range, joined to the questions of its first block.
4. The answers of a pair's blocks are summed, and joined to the rows of that pair. That join is a sort-merge join of two plain exchanges, so that
   adaptive execution splits a hot pair; rows without slot or level pass it by.

Emitted rows: at most 2 * log2(slots) for each distinct pair, about half of that on average. The driver sees the smallest and
largest slot and the number of pairs; the broadcast table has one row for each range (the number of shuffle partitions).

Null slots or levels: null counts, above none. A total that is NaN, infinite or beyond 64-bit integers has a null level. A null sale_id weighs
like an empty text (crc32 0, so 1). Every row is a sale of its own, repeated rows too. Ties of level are not above one another. An empty
table gives no rows. Only sale_id, sold_at and total are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import written

#: Rows of a range at the least, where there are more than the session's shuffle partitions would take.
RANGE_ROWS = 1 << 22
#: A block is h * 2**_SHIFT + i.
_SHIFT = 48
_ANSWER = "slot bigint, level bigint, n bigint, w bigint, part int, block bigint, last boolean"


def hour_slot(sales: DataFrame, name: str = "sold_at") -> Column:
    """floor(seconds since 1970 / 3600) of a time taken as UTC, whatever the session's zone."""
    at = F.col(name)
    if dict(sales.dtypes)[name] == "timestamp_ntz":  # its date and hour have no zone
        return F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)
    return F.floor(F.unix_seconds(at.cast("timestamp")) / 3600)


def _floor(x: Column) -> Column:
    """floor as a double; from 2**52 on doubles are whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def price_level(total: Column) -> Column:
    """floor(floor(100 * total + 0.5) / 100) in double arithmetic; null where that is no 64-bit integer."""
    level = _floor(_floor(total.cast("double") * 100 + 0.5) / 100)
    return F.when(~F.isnan(level) & (F.abs(level) < float(1 << 63)), level).cast("long")


def row_weight(key: Column) -> Column:
    """1 + the lowest bit of the crc32 of the key in decimal digits."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 2 + 1


def _ancestors(x: Column, height: int) -> Column:
    """Blocks of even number that hold x, one for each height below `height`."""
    at = lambda h: F.shiftright(x, h)
    return F.array_compact(F.array(*[F.when(at(h).bitwiseAND(F.lit(1)) == 0, at(h) + (h << _SHIFT)) for h in range(height)]))


def _prefix(x: Column, height: int) -> Column:
    """The blocks whose union is 0..x."""
    at = lambda h: F.shiftright(x + 1, h)
    return F.array_compact(F.array(*[F.when(at(h).bitwiseAND(F.lit(1)) == 1, at(h) - 1 + (h << _SHIFT)) for h in range(height)]))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (block, level, slot, asks, n, w) -> answers of questions, as far as this range knows, and the sums of its first and last block."""
    part, first, block, held = TaskContext.get().partitionId(), None, None, np.zeros(2, np.int64)
    names = [c.split()[0] for c in _ANSWER.split(", ")]

    def edge(block: int, sums: np.ndarray, last: bool) -> pa.RecordBatch:
        values = [None, None, int(sums[0]), int(sums[1]), part, block, last]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.bool_()], strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        if first is None:
            first = block = int(blocks[0])
            yield edge(first, held, False)
        if int(blocks[0]) != block:
            held = np.zeros(2, np.int64)
        heads = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1])
        group = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(blocks)]])))
        sums = []
        for i, c in enumerate("nw"):
            v = batch.column(c).to_numpy()
            run = np.cumsum(v)
            before = (run - v)[heads]
            before[0] -= held[i]
            sums.append(run - before[group])
        block, held = int(blocks[-1]), np.array([s[-1] for s in sums], np.int64)
        asked = pa.array(asks)
        n, open_ = int(asks.sum()), blocks[asks] == first
        yield pa.RecordBatch.from_arrays(
            [batch.column("slot").filter(asked), batch.column("level").filter(asked), *(pa.array(s[asks]) for s in sums), pa.array(np.full(n, part, np.int32), mask=~open_), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names
        )
    if first is not None:
        yield edge(block, held, True)


def count_above(points: DataFrame) -> DataFrame:
    """slot, level, n, w for each distinct pair of points (slot, level, w), none null: how many points lie above the pair, and the sum of their w."""
    pairs = written(points.groupBy("slot", "level").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "dominance-pairs")
    low, high, size = pairs.agg(F.min("slot"), F.max("slot"), F.count("*")).first()
    x = F.col("slot") - F.lit(low or 0).cast("long")
    height = max(1, ((high or 0) - (low or 0) + 1).bit_length())
    zero = F.lit(0).cast("long")
    places = pairs.select(F.explode(_ancestors(x, height)).alias("block"), "level", "slot", F.lit(False).alias("asks"), "n", "w")
    questions = pairs.select(F.explode(_prefix(x, height)).alias("block"), "level", "slot", F.lit(True).alias("asks"), zero.alias("n"), zero.alias("w"))
    n_ranges = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * height // RANGE_ROWS))
    order = [F.col("block"), F.col("level").desc(), F.col("asks").desc(), F.col("slot")]
    ranges = places.unionByName(questions).repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    found = written(ranges.mapInArrow(_running, _ANSWER), "dominance-answers")
    # A range's first block goes on from the earlier ranges that ended in it.
    edges = found.filter(F.col("block").isNotNull())
    earlier = Window.partitionBy("block").orderBy("part", "last").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("part", "last", *(F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}_before") for c in "nw")).filter(~F.col("last")).drop("last")
    whole = found.filter(F.col("block").isNull()).join(F.broadcast(carried), "part", "left")
    return whole.groupBy("slot", "level").agg(*(F.sum(F.col(c) + F.coalesce(F.col(f"{c}_before"), zero)).alias(c) for c in "nw"))


def count_sales(sales: DataFrame) -> DataFrame:
    """sale_id, slot, level, n_sales and n_rows of each row of sales (sale_id, sold_at, total)."""
    rows = sales.select(F.col("sale_id"), hour_slot(sales).alias("slot"), price_level(F.col("total")).alias("level"))
    placed = F.col("slot").isNotNull() & F.col("level").isNotNull()
    above = written(count_above(rows.filter(placed).select("slot", "level", row_weight(F.col("sale_id")).alias("w"))), "dominance-sums")
    found = rows.filter(placed).join(above.hint("merge"), ["slot", "level"]).select("sale_id", "slot", "level", F.col("n").alias("n_sales"), F.col("w").alias("n_rows"))
    none = F.lit(None).cast("long")
    return found.unionByName(rows.filter(~placed).select("sale_id", "slot", "level", none.alias("n_sales"), none.alias("n_rows")))


#: The same rows in DuckDB's SQL; crc32 by its table.
ORACLE = """
WITH t AS (SELECT list(list_reduce(list_prepend(v, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS crc FROM (SELECT unnest(range(256)) AS v)),
s AS (
  SELECT sale_id, floor(epoch_us(sold_at) / 1e6 / 3600)::BIGINT AS slot, floor(floor(100 * total + 0.5) / 100)::BIGINT AS level,
    1 + xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(sale_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])), 4294967295) % 2 AS w
  FROM sales, t),
p AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
a AS (SELECT q.slot, q.level, coalesce(sum(p.n), 0)::BIGINT AS n_sales, coalesce(sum(p.w), 0)::BIGINT AS n_rows FROM p q LEFT JOIN p ON p.slot <= q.slot AND p.level > q.level GROUP BY ALL)
SELECT s.sale_id, s.slot, s.level, a.n_sales, a.n_rows FROM s LEFT JOIN a ON a.slot = s.slot AND a.level = s.level
"""
