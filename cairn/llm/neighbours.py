"""Approximate nearest neighbours by cosine: additive quantisation for the candidates, exact scores for the answer.

1. Equal vectors form one class (its smallest vec_id); a class keeps its k + 1 smallest ids, which is all that an answer of k can use.
2. Codebooks are fitted on the driver to SAMPLE_ROWS classes at most (those with the smallest hash of their id).
3. Every class is encoded by beam search; codes, scale and stored norm are packed in blocks of about BLOCK_ROWS, dealt by a
   hash of the class.
4. Each block of QUERY_ROWS queries meets each block of codes; lookup tables give scores. This is the stated query set
   against all rows, in blocks: the work is rows times queries. Blocks are as large as memory allows, so that what is moved
   (a block of codes and one of queries for each pair) is small against the scores taken from it.
5. Of all blocks the `shortlist` best go on; a block sends as many of its best as could belong to them: its share of the
   shortlist and four standard deviations, since blocks are dealt by hash. They are scored exactly in double precision on
   the original vectors. The shortlist follows the rows: their square root, and LEAST_SHORTLIST at least.

Recall against brute force is in the tests. Vectors that are null, empty, zero or hold null or non-finite components take no
part. Vectors of different lengths have no cosine: each length is searched for itself, so the driver holds one count for each
distinct length. vec_id is the key; of repeated rows of one id and vector one counts, and of a query's several vectors the
smallest is asked while all are candidates of others. Rows without vec_id take no part. An empty table, or one without
queries, gives no rows. Ties go to the smaller vec_id. Only vec_id and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import additive
from .textkit import stored

K = 5
QUERY_STEP = 50
SAMPLE_ROWS = 8192
N_BOOKS, N_WORDS, N_COARSE, BEAM = 16, 256, 64, 6
LEAST_SHORTLIST = 200
BLOCK_ROWS, QUERY_ROWS = 1 << 18, 1 << 15
#: Queries whose lookup tables are held at a time; also the least block of queries.
TABLES = 64
_CODES = "vec_id bigint, packed binary"


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """class_id, vector, members: the k + 1 smallest ids of each distinct vector. Ranks are cut before the shuffle, so a common vector sends few rows."""
    rank = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= k + 1)
    return few.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.array_sort(F.collect_set("vec_id")).alias("members"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _encoder(model: additive.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                first, codes, scale, norm = additive.encode(model, additive.unit(_matrix(part.column("vector"))), BEAM)
                packed = np.concatenate([first.astype("<i2")[:, None].view(np.uint8), codes, np.stack([scale, norm], 1).astype("<f4").view(np.uint8)], 1)
                yield pa.RecordBatch.from_arrays([part.column("class_id"), pa.array([row.tobytes() for row in packed], pa.binary())], ["vec_id", "packed"])

    return run


def _scorer(model: additive.Model, most: int):
    m = model.books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values.to_numpy()
                order = np.argsort(ids, kind="stable")
                packed = np.frombuffer(b"".join(batch.column("codes")[row].values.to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                ids = ids[order]
                first = packed[:, :2].copy().view("<i2")[:, 0]
                codes = np.asfortranarray(packed[:, 2 : 2 + m])
                scale, norm = np.ascontiguousarray(packed[:, 2 + m :].copy().view("<f4").T)
                queries = batch.column("queries")[row].values
                qids, vectors = queries.field("vec_id").to_numpy(), additive.unit(_matrix(queries.field("vector")))
                for at in range(0, len(qids), TABLES):
                    tables = additive.lookup(model, vectors[at : at + TABLES])
                    out_q, out_v, out_s = [], [], []
                    for q, qid in enumerate(qids[at : at + TABLES]):
                        s = additive.scores(tables, q, first, codes, scale, norm)
                        best = np.arange(len(s))
                        if len(s) > most:
                            best = np.flatnonzero(s >= np.partition(s, len(s) - most)[len(s) - most])
                            best = best[np.argsort(-s[best], kind="stable")][:most]
                        out_q.append(np.full(len(best), qid))
                        out_v.append(ids[best])
                        out_s.append(s[best])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "class_id", "guess"])

    return run


def block_share(shortlist: int, n_blocks: int) -> int:
    """How many of a block's best can be among the shortlist: all if there is one block; else its share of them and four standard deviations."""
    share = shortlist / n_blocks
    return shortlist if n_blocks == 1 else min(shortlist, math.ceil(share + 4 * math.sqrt(share) + 4))


def levelled(v: Column, top: Column) -> Column:
    """v as doubles, divided by its largest component `top` where squares could vanish or overflow."""
    return F.when((top > 1e-100) & (top < 1e100), v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / top))


def with_cosine(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """pairs with the cosine of two columns of finite vectors that are not zero."""
    tops = pairs.withColumns({f"_top_{c}": F.array_max(F.transform(c, lambda x: F.abs(x.cast("double")))) for c in (a, b)})
    level = tops.withColumns({f"_level_{c}": levelled(F.col(c), F.col(f"_top_{c}")) for c in (a, b)})
    dot = lambda x, y: F.aggregate(F.zip_with(f"_level_{x}", f"_level_{y}", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return level.withColumn(name, dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b)))


def search(embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP, shortlist: int | None = None, n_books: int = N_BOOKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by query_step, among all other rows of embeddings (vec_id, embedding)."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    asked = F.col("vec_id") % query_step == 0
    widths = vectors.groupBy(F.size("vector").alias("width")).agg(F.countDistinct(F.when(asked, F.col("vec_id"))).alias("n")).filter("n > 0").orderBy("width").collect()
    found = embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for i, w in enumerate(widths):
        part = _search(vectors.filter(F.size("vector") == w["width"]), asked, w["n"], k, shortlist, n_books)
        found = found.unionByName(part) if i else part
    return found


def _search(vectors: DataFrame, asked: Column, n_queries: int, k: int, shortlist: int | None, n_books: int) -> DataFrame:
    """The search among vectors of one length, of which at least one is asked about."""
    groups = stored(classes(vectors, k))
    sample = groups.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE_ROWS).select("vector").collect()
    model = additive.fit(additive.unit(np.array([r[0] for r in sample])), n_books, N_WORDS, N_COARSE)
    queries = vectors.filter(asked).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    codes = stored(groups.select("class_id", "vector").mapInArrow(_encoder(model), _CODES))
    n_rows = codes.count()
    shortlist = shortlist or max(LEAST_SHORTLIST, math.isqrt(n_rows))
    n_blocks = -(-n_rows // BLOCK_ROWS)
    # More and smaller blocks of queries where there would be fewer pairs than tasks.
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    n_query_blocks = max(-(-n_queries // QUERY_ROWS), min(-(-n_queries // TABLES), -(-tasks // n_blocks)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    codes = codes.groupBy(block(n_blocks).alias("block")).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("packed").alias("codes"))
    codes = codes.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    asked_in = queries.groupBy(block(n_query_blocks).alias("query_block")).agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    pairs = codes.join(asked_in, "query_block").repartition(max(2, min(n_blocks * n_query_blocks, 1 << 16)), "block", "query_block")
    guesses = pairs.select("ids", "codes", "queries").mapInArrow(_scorer(model, block_share(shortlist, n_blocks)), "query_id bigint, class_id bigint, guess float")
    short = guesses.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("guess"), "class_id"))).filter(F.col("_n") <= shortlist).drop("_n")
    exact = short.join(groups, "class_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
    exact = with_cosine(exact, "asked", "vector", "score").select("query_id", "members", "score")
    found = exact.select("query_id", "score", F.explode("members").alias("vec_id")).filter(F.col("vec_id") != F.col("query_id"))
    # An id with several vectors counts with its nearest.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
