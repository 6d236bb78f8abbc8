"""Exact top-k search by inner product: buckets of equal length, pruned by length or by coordinates, then verified products.

Each component x counts as floor(SCALE * x). A vector's length bounds its products: q.v <= |q| |v|.

1. A bounded sample (SEED_BYTES of vectors, by a hash of the id) is scored with every query: the k-th best score is a lower bound
   of the query's answer, its threshold. The sample decides only how much is pruned, never the result.
2. All vectors are dealt to buckets by ranges of their length, longest first; what a query needs of a length, threshold / |q|, deals the queries to blocks
   in the same way. A bucket and a block of queries meet only if the bucket's longest vector reaches the least need of the block.
3. A pair goes through its bucket in runs of RUN_ROWS vectors. The local threshold of a query and a run is the cosine which
   a vector of the run's greatest length needs. Over 1, the query leaves the bucket. From COORDINATE_FROM on, the run is pruned by coordinates: the
   components of the unit query that are largest bound the same components of any unit vector within that cosine, sorted lists of
   components give the candidates, and Cauchy-Schwarz over the other components drops most of what is left. Below it, pruning is by
   length: only the run's first vectors, those long enough, are multiplied.
4. What is left is verified by its exact product. A query's threshold rises with the k-th best of the bucket, and a bucket sends k
   rows a query at most.

Products are taken in double precision where |q| |v| < 2^53, so that they are exact integers, and in unbounded integers beyond; scores outside 64 bits
saturate. This is the stated query set against all rows, in blocks: a bucket is sent to each block that it can serve.

Vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id. Vectors of different lengths of array have
no product: each such length is searched for itself (the driver holds one count for each); empty arrays score 0 with one another. Zero vectors take part.
vec_id is the key: of repeated rows one counts, an id with several vectors is asked with the smallest and found by its best. Ties
go to the smaller vec_id. No queries or an empty table: no rows. Only vec_id and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import written

K = 10
QUERY_STEP = 100
SCALE = 1024
SEED_BYTES = 2 << 20
#: Bytes of a bucket, and of a block of queries, as doubles.
BLOCK_BYTES = 8 << 20
#: Fewer rows make no bucket of their own, where there are more tasks than buckets.
LEAST_ROWS = 1024
RUN_ROWS = 2048
#: Cosine from which coordinates prune more than they cost, how many are looked at, and queries multiplied at a time.
COORDINATE_FROM, N_FOCUS, TOGETHER = 0.7, 6, 64
_EXACT = float(1 << 53)
_SLACK = 1e-9
_PACKED = "block bigint, reach double, ids binary, vectors binary, thresholds binary"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of all components, as doubles, which hold these integers exactly."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * flat), -np.finfo(float).max, np.finfo(float).max).reshape(len(column), width)


def lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top, 1.0)
    with np.errstate(over="ignore"):
        return np.minimum(np.linalg.norm(x / scale[:, None], axis=1) * scale, np.finfo(float).max)


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows of x with q, as 64-bit integers."""
    if exact:
        return (x @ q).astype(np.int64)
    numbers = [int(v) for v in q]
    most = (1 << 63) - 1
    return np.array([max(-most - 1, min(most, sum(int(a) * b for a, b in zip(row, numbers, strict=True)))) for row in x], np.int64)


class Best:
    """The k best (score, id) of a query, of distinct ids, and the score that another has to reach."""

    def __init__(self, k: int, own: int, least: float) -> None:
        self.k, self.own, self.least = k, own, least
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.least) & (ids != self.own)
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, ~scores))
        scores, ids = scores[order], ids[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[: self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


class Run:
    """Vectors of similar length, longest first, with sorted lists of their unit components."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        self.ids, self.x, self.norms = ids, x, norms
        self.top = float(norms[0])
        self.units: np.ndarray | None = None
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.units[:, f], kind="stable")
            self.lists[f] = order, self.units[order, f]
        return self.lists[f]

    def candidates(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that can have at least that cosine with the unit query."""
        if self.units is None:
            self.units = self.x / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        focus = np.argsort(-np.abs(unit), kind="stable")[:N_FOCUS]
        part = unit[focus]
        reach = np.sqrt(np.maximum(0.0, (1 - cosine * cosine) * (1 - part * part))) + _SLACK
        low, high = part * cosine - reach, part * cosine + reach
        # A component beyond part * cosine in the query's own direction lies nearer to it: that side is open while part >= cosine.
        high = np.where(part >= cosine, np.inf, high)
        low = np.where(-part >= cosine, -np.inf, low)
        spans = []
        for f, a, b in zip(focus, low, high, strict=True):
            values = self.sorted_by(f)[1]
            spans.append((int(np.searchsorted(values, a)), int(np.searchsorted(values, b, "right"))))
        best = int(np.argmin([b - a for a, b in spans]))
        rows = self.sorted_by(focus[best])[0][spans[best][0] : spans[best][1]]
        seen = self.units[rows][:, focus]
        inside = ((seen >= low) & (seen <= high)).all(axis=1)
        rows, seen = rows[inside], seen[inside]
        rest = np.sqrt(np.maximum(0.0, 1 - part @ part) * np.maximum(0.0, 1 - (seen * seen).sum(axis=1)))
        return rows[seen @ part + rest + _SLACK >= cosine]


def search_bucket(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list[Best], int]:
    """(best of each query among the vectors, number of products taken)."""
    norms, q_norms = lengths(x), lengths(q)
    order = np.argsort(-norms, kind="stable")
    ids, x, norms = ids[order], x[order], norms[order]
    best = [Best(k, int(i), t) for i, t in zip(q_ids, least, strict=True)]
    exact = bool(float(q_norms.max(initial=0.0)) * float(norms[0]) < _EXACT)
    taken = 0
    for at in range(0, len(ids), RUN_ROWS):
        run = Run(ids[at : at + RUN_ROWS], x[at : at + RUN_ROWS], norms[at : at + RUN_ROWS])
        need = np.array([b.least for b in best], np.float64)
        with np.errstate(over="ignore"):
            most = q_norms * run.top
        alive = need <= most + _SLACK * (most + np.abs(np.where(np.isfinite(need), need, 0.0)))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(most > 0, need / most, -np.inf) - _SLACK
        by_coordinates = alive & (cosine >= COORDINATE_FROM)
        for i in np.flatnonzero(by_coordinates):
            rows = run.candidates(q[i] / q_norms[i], min(1.0, float(cosine[i])))
            taken += len(rows)
            best[i].add(products(run.x[rows], q[i], exact), run.ids[rows])
        by_length = np.flatnonzero(alive & ~by_coordinates)
        if not exact:
            for i in by_length:
                taken += len(run.ids)
                best[i].add(products(run.x, q[i], False), run.ids)
            continue
        # How many of the run's first vectors are long enough for each query.
        with np.errstate(divide="ignore", invalid="ignore"):
            short = np.where(q_norms[by_length] > 0, need[by_length] / q_norms[by_length], -np.inf) * (1 - _SLACK)
        enough = np.where(need[by_length] > 0, np.searchsorted(-run.norms, -short, "right"), len(run.ids))
        by_length, enough = by_length[np.argsort(-enough, kind="stable")], -np.sort(-enough)
        for j in range(0, len(by_length), TOGETHER):
            some, n = by_length[j : j + TOGETHER], int(enough[j])
            scores = (q[some] @ run.x[:n].T).astype(np.int64)
            taken += scores.size
            hit = (scores >= need[some][:, None]).any(axis=1)
            for row in np.flatnonzero(hit):
                best[some[row]].add(scores[row], run.ids[:n])
    return best, taken


def _bytes_of(x: np.ndarray) -> bytes:
    """Small integers take two bytes a component."""
    small = np.abs(x).max(initial=0.0) < 1 << 15
    return (b"h" if small else b"d") + x.astype("<i2" if small else "<f8").tobytes()


def _matrix_of(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"h" else "<f8", offset=1).astype(np.float64).reshape(n, width)


def _packer(width: int, rows: int):
    """Sorted rows (vec_id, vector, threshold, key) -> blocks; reach is the first and so the largest key of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept: list[pa.RecordBatch] = []

        def cut(n: int) -> pa.RecordBatch:
            nonlocal number, kept
            table = pa.Table.from_batches(kept)
            head, rest = table.slice(0, n).combine_chunks(), table.slice(n)
            kept = rest.to_batches()
            number += 1
            values = [number, head.column("key")[0].as_py(), head.column("vec_id").to_numpy().astype("<i8").tobytes(), _bytes_of(whole(head.column("vector").combine_chunks(), width)), head.column("threshold").to_numpy().astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            kept.append(batch)
            while sum(b.num_rows for b in kept) >= rows:
                yield cut(rows)
        if sum(b.num_rows for b in kept):
            yield cut(rows)

    return run


def _blocks(rows: DataFrame, width: int, n_rows: int, name: str, tasks: int = 1) -> DataFrame:
    """rows (vec_id, vector, threshold, key) in blocks by ranges of key, largest first. What tells equal keys apart is part of the order, so that they spread."""
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))
    n = max(1, -(-n_rows // most), min(tasks, n_rows // LEAST_ROWS))
    order = [F.col("key").desc(), F.col("vec_id"), F.col("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.select("vec_id", "vector", "threshold", "key").mapInArrow(_packer(width, most), _PACKED), name)


def _thresholds(seeds: list, width: int, k: int):
    """Adds to each query the k-th best score among the seeds, and what it needs of a length."""
    ids = np.array([s["vec_id"] for s in seeds], np.int64)
    x = whole(pa.array([s["vector"] for s in seeds], pa.list_(pa.float64())), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = whole(batch.column("vector"), width)
            q_ids = batch.column("vec_id").to_numpy()
            best, _ = search_bucket(q_ids, q, np.full(len(q), -np.inf), ids, x, k)
            least, norms = np.array([b.least for b in best], np.float64), lengths(q)
            least = np.where(np.isfinite(least) & (np.abs(least) >= _EXACT), least - np.abs(least) * _SLACK, least)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((norms > 0) & (least > 0), least / norms, -np.inf) * (1 - _SLACK)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(least), pa.array(-need)], ["vec_id", "vector", "threshold", "key"])

    return run


def _searcher(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                x, q = _matrix_of(row["vectors"], width, len(ids)), _matrix_of(row["q_vectors"], width, len(q_ids))
                best, _ = search_bucket(q_ids, q, np.frombuffer(row["thresholds"], "<f8"), ids, x, k)
                of = np.repeat(q_ids, [len(b.ids) for b in best])
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (of, np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best]))], ["query_id", "vec_id", "score"])

    return run


def search(embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each row whose vec_id is divisible by query_step with all other rows of embeddings (vec_id, embedding)."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    asked = F.col("vec_id") % query_step == 0
    widths = vectors.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"), F.countDistinct(F.when(asked, F.col("vec_id"))).alias("asked")).filter("asked > 0").orderBy("width").collect()
    found = embeddings.sparkSession.createDataFrame([], _FOUND)
    for i, w in enumerate(widths):
        part = _search(vectors.filter(F.size("vector") == w["width"]), asked, w["width"], w["n"], w["asked"], k)
        found = found.unionByName(part) if i else part
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, asked: Column, width: int, n_rows: int, n_queries: int, k: int) -> DataFrame:
    """Candidates of all queries among vectors of one width."""
    session = vectors.sparkSession
    n_seeds = min(4096, max(k + 1, SEED_BYTES // (8 * max(1, width))))
    seeds = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_seeds).collect()
    queries = vectors.filter(asked).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = queries.mapInArrow(_thresholds(seeds, width, k), "vec_id bigint, vector array<double>, threshold double, key double")
    tasks = 4 * session.sparkContext.defaultParallelism
    part = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  from 2**52 on doubles are whole
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + part(x * SCALE) * part(x * SCALE))
    buckets = _blocks(vectors.select("vec_id", "vector", F.lit(0.0).alias("threshold"), F.sqrt(square).alias("key")), width, n_rows, "topk-buckets", tasks)
    blocks = _blocks(queries, width, n_queries, "topk-queries")
    # The first query of a block has the least need, written as a negative key.
    numbers = blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "thresholds", (-F.col("reach")).alias("need"))
    names = [r[0] for r in numbers.select("q_block").collect()]
    pairs = buckets.drop("thresholds").withColumn("q_block", F.explode(F.array(*[F.lit(b).cast("long") for b in names])))
    pairs = pairs.join(numbers, "q_block").filter(F.col("reach") * (1 + _SLACK) >= F.col("need"))
    n_pairs = len(names) * max(1, n_rows // max(1, BLOCK_BYTES // (8 * max(1, width))), min(tasks, n_rows // LEAST_ROWS))
    pairs = pairs.repartition(max(2, min(n_pairs, 1 << 16)), "block", "q_block").select("ids", "vectors", "q_ids", "q_vectors", "thresholds")
    return pairs.mapInArrow(_searcher(width, k), _FOUND)


#: The same rows in DuckDB's SQL. Products of doubles are exact here: components are far below 2**26.
ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
