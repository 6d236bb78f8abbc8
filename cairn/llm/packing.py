"""Packing: optimal length buckets by dynamic programming, token-budget batches inside each bucket.

The histogram of exact lengths over all rows goes to the driver: two numbers per distinct length, and D distinct lengths
hold at least D^2 / 2 tokens, so D is at most the square root of twice the tokens, whatever the number of rows. With
lengths v_1 < ... < v_D and row counts, the programme

    best(k, j) = min over i < j of best(k - 1, i) + v_j * rows(i+1..j) - tokens(i+1..j)

gives the N_BUCKETS boundaries with the least padding. Its cost obeys the quadrangle inequality, so the smallest best i
grows with j, and each k takes D log D steps. Equal costs go to the smaller i, and fewer buckets win over more.

A batch of a bucket with padded length v has max(1, budget // v) rows. A bucket is dealt by a hash of the id into parts of
about PART_BATCHES batches, so no task holds a whole bucket; the last batch of a part may be short. Inside a part rows
stand in the order of the hash, then the id. An id (or null) of more than PART_ROWS rows and one row in HOT_IDS is hot: its rows get
a hash of the id and one of as many salts as they fill parts of PART_ROWS, by the row's number, which a checkpoint fixes. At most HOT_IDS ids are hot.

Null and empty texts have length 0 and are packed like others. Repeated rows are packed each, and rows without an id like
rows of one id. An empty table gives no rows. Only doc_id and text are read, so further columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import stored

N_BUCKETS = 16
TOKEN_BUDGET = 1 << 16
PART_BATCHES = 32
PART_ROWS = 1024
HOT_IDS = 1024
WORDS = r"[^\x20\x09-\x0D]+"


def word_length(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def boundaries(lengths: list[int], rows: list[int], n_buckets: int) -> list[int]:
    """Upper ends of the buckets with the least padding; lengths ascend."""
    d = len(lengths)
    if not d:
        return []
    v = np.array([0, *lengths], np.int64)
    c = np.concatenate([[0], np.cumsum(rows)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64) * np.asarray(rows, np.int64))]).astype(np.int64)
    cost = v * c - s  # one bucket over the first j lengths
    back, costs = [np.zeros(d + 1, np.int64)], [int(cost[d])]
    for k in range(2, min(n_buckets, d) + 1):
        value, origin = np.full(d + 1, np.iinfo(np.int64).max), np.zeros(d + 1, np.int64)
        todo = [(k, d, k - 1, d - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = cost[i] + v[j] * (c[j] - c[i]) - (s[j] - s[i])
            at = int(total.argmin())
            value[j], origin[j] = total[at], i[at]
            todo += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        back.append(origin)
        cost = value
        costs.append(int(cost[d]))
    k = costs.index(min(costs))
    out, j = [], d
    while j:
        out.append(int(v[j]))
        j = int(back[k][j])
        k -= 1
    return out[::-1]


def choice(length: Column, ends: list[int], values: list) -> Column:
    """The value of the first end that is not below length, as a binary tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(values[low])
        mid = (low + high) // 2
        return F.when(length <= ends[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(ends) - 1)


def pack(rows: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """rows (doc_id, n_tokens) with bucket, padded_tokens, part, batch and slot: a batch is (bucket, part, batch)."""
    rows = stored(rows.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("_row")))
    histogram = sorted(tuple(r) for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    columns = ["doc_id", "n_tokens", "bucket", "padded_tokens", "part", "batch", "slot"]
    ends = boundaries([h[0] for h in histogram], [h[1] for h in histogram], n_buckets)
    if not ends:
        return rows.drop("_row").withColumns({c: F.lit(0) for c in columns[2:4]} | {"part": F.lit(0).cast("long"), "batch": F.lit(0).cast("long"), "slot": F.lit(0)}).withColumn("padded_tokens", F.lit(0).cast("long")).select(columns)
    n_rows, at = [0] * len(ends), 0
    for length, n in histogram:
        while length > ends[at]:
            at += 1
        n_rows[at] += n
    per_batch = [max(1, budget // max(1, end)) for end in ends]
    parts = [-(-n // max(PART_ROWS, PART_BATCHES * b)) for n, b in zip(n_rows, per_batch, strict=True)]
    length, name = F.col("n_tokens"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hot = rows.groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > PART_ROWS + sum(h[1] for h in histogram) // HOT_IDS)
    if salts := {r["doc_id"]: -(-r["_n"] // PART_ROWS) for r in hot.collect()}:
        n = F.coalesce(*(F.when(F.col("doc_id").eqNullSafe(F.lit(i)), F.lit(k)) for i, k in salts.items()))
        name = F.when(n.isNotNull(), F.concat(name, F.lit(":"), F.pmod(F.xxhash64("_row"), n).cast("string"))).otherwise(name)
    placed = rows.withColumns({"_key": F.md5(F.encode(name, "UTF-8")), "bucket": choice(length, ends, list(range(len(ends)))), "padded_tokens": choice(length, ends, ends).cast("long"), "_per": choice(length, ends, per_batch)})
    placed = placed.withColumn("part", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % choice(length, ends, parts))
    n = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("_key", "doc_id")) - 1
    placed = placed.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / F.col("_per")).cast("long"), "slot": (F.col("_n") % F.col("_per")).cast("int")})
    return placed.select(columns)


def pack_documents(documents: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Batches of documents (doc_id, text); a token is a word between ASCII white space."""
    return pack(documents.select("doc_id", word_length(F.col("text")).alias("n_tokens")), n_buckets, budget)


#: The same batches in DuckDB's SQL.
ORACLE = f"""
WITH RECURSIVE lens AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
hist AS (SELECT n, count(*) AS c FROM lens GROUP BY n),
cum AS (SELECT row_number() OVER (ORDER BY n) AS i, n, (sum(c) OVER (ORDER BY n))::BIGINT AS cc, (sum(n * c) OVER (ORDER BY n))::BIGINT AS ss FROM hist),
dp AS (
  SELECT 1::BIGINT AS k, i AS j, {{'cost': n * cc - ss, 'prev': 0::BIGINT}} AS best FROM cum
  UNION ALL
  SELECT d.k + 1, b.i, min({{'cost': d.best.cost + b.n * (b.cc - a.cc) - (b.ss - a.ss), 'prev': d.j}})
  FROM dp d JOIN cum a ON a.i = d.j JOIN cum b ON b.i > d.j WHERE d.k < {N_BUCKETS} GROUP BY d.k, b.i),
pick AS (SELECT k FROM dp WHERE j = (SELECT max(i) FROM cum) ORDER BY best.cost, k LIMIT 1),
path AS (
  SELECT k, j FROM dp WHERE k = (SELECT k FROM pick) AND j = (SELECT max(i) FROM cum)
  UNION ALL
  SELECT d.k, d.j FROM path p JOIN dp here ON here.k = p.k AND here.j = p.j JOIN dp d ON d.k = p.k - 1 AND d.j = here.best.prev),
ends AS (SELECT (path.k - 1)::INT AS bucket, c.n AS hi, coalesce(lag(c.n) OVER (ORDER BY path.k), -1) AS lo, greatest(1, {TOKEN_BUDGET} // greatest(1, c.n)) AS per FROM path JOIN cum c ON c.i = path.j),
sized AS (SELECT e.*, ceil((SELECT count(*) FROM lens l WHERE l.n > e.lo AND l.n <= e.hi) / greatest({PART_ROWS}, {PART_BATCHES} * e.per)::DOUBLE)::BIGINT AS parts FROM ends e),
placed AS (SELECT l.doc_id, l.n, s.bucket, s.hi, s.per, md5(coalesce(l.doc_id::VARCHAR, '')) AS key, ('0x' || substr(md5(coalesce(l.doc_id::VARCHAR, '')), 1, 8))::BIGINT % s.parts AS part FROM lens l JOIN sized s ON l.n > s.lo AND l.n <= s.hi),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket, part ORDER BY key, doc_id) - 1 AS rn FROM placed)
SELECT doc_id, n::BIGINT AS n_tokens, bucket, hi::BIGINT AS padded_tokens, part, (rn // per)::BIGINT AS batch, (rn % per)::INT AS slot FROM numbered
"""
