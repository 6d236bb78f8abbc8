"""What several operators share: byte words, 64-bit hashes, rolling windows, batches of bounded size, stored tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker turns into arrays at a time.
SLICE_BYTES = 4 << 20
#: Bytes that are hashed at a time; they stay in the processor's cache.
HASH_BYTES = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, texts as UTF-8) of runs of rows with about `limit` bytes of text; null counts as empty."""
    texts = batch.column(column).cast(pa.binary())
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i, [x or b"" for x in texts.slice(start, i - start).to_pylist()]
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths), [x or b"" for x in texts.slice(start).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(text: bytes) -> Iterator[bytes]:
    """text cut between words into pieces of about HASH_BYTES; a word longer than that is a piece of its own."""
    at = 0
    while len(text) - at > HASH_BYTES:
        gap = _SPACE.search(text, at + HASH_BYTES)
        end = gap.start() if gap else len(text)
        if end - at > 2 * HASH_BYTES:
            before = max(text.rfind(bytes([c]), at, at + HASH_BYTES) for c in b" \t\n\x0b\x0c\r")
            if before > at:
                end = before
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class WordHashes:
    """Texts (UTF-8) -> a 64-bit hash of each word between ASCII white space, for all words of a block at once.

    A word of up to WORD_BYTES bytes is the sum of random 64-bit values, one for each place and byte, and its length, mixed; a longer one is hashed
    by xxh3. Neither is a polynomial, for which words of a known pattern have equal hashes. fold_case: A-Z count as a-z."""

    WORD_BYTES = 64

    def __init__(self, fold_case: bool = False) -> None:
        values = np.random.default_rng(20240229).integers(0, 1 << 64, (self.WORD_BYTES, 256), np.uint64)
        if fold_case:
            values[:, 65:91] = values[:, 97:123]
        self.fold_case = fold_case
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        values[:, self.space] = 0
        self.values = values.ravel()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, number of words of each text)."""
        hashes, counts, block, size = [], np.zeros(len(texts), np.int64), [], 0

        def close() -> None:
            if block:
                h, n = self._block([x for _, x in block])
                hashes.append(h)
                np.add.at(counts, [i for i, _ in block], n)
                block.clear()

        for i, text in enumerate(texts):
            for piece in pieces(text):
                if size + len(piece) > HASH_BYTES:
                    close()
                    size = 0
                if len(piece) > 2 * HASH_BYTES:  # a word of that length
                    hashes.append(np.array([self.one(w) for w in piece.split()], np.uint64))
                    counts[i] += len(hashes[-1])
                    continue
                block.append((i, piece))
                size += len(piece)
        close()
        return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), counts

    def one(self, word: bytes) -> int:
        if len(word) > self.WORD_BYTES:
            return xxhash.xxh3_64_intdigest(word.lower() if self.fold_case else word)
        data = np.frombuffer(word, np.uint8)
        with np.errstate(over="ignore"):
            return int(mix(self.values[np.arange(len(data)) * 256 + data].sum(dtype=np.uint64, keepdims=True) + np.uint64(len(data)))[0])

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = b"\n".join([*texts, b""])
        data = np.frombuffer(whole, np.uint8)
        gap = self.space[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        place = np.arange(starts[0], len(data), dtype=np.int32)
        place -= np.repeat(starts.astype(np.int32), np.diff(np.concatenate([starts, [len(data)]])))
        np.minimum(place, self.WORD_BYTES - 1, out=place)
        place <<= 8
        place += data[starts[0] :]
        sums = np.zeros(len(place) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[place], out=sums[1:], dtype=np.uint64)
            h = mix(sums[ends - starts[0]] - sums[starts - starts[0]] + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > self.WORD_BYTES).tolist():
            h[i] = self.one(whole[starts[i] : ends[i]])
        limits = np.cumsum([len(t) + 1 for t in texts])
        return h, np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


class Counts:
    """The most frequent hashes that a task met, with their counts: a summary of at most `limit` numbers, whatever the input."""

    def __init__(self, limit: int) -> None:
        self.limit, self.total = limit, 0
        self.ids, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, grams: np.ndarray) -> None:
        self.total += len(grams)
        grams = np.sort(grams)
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
        n = np.diff(np.concatenate([first, [len(grams)]]))
        grams = grams[first]
        # A gram seen once here counts only if it was frequent before.
        at = np.minimum(np.searchsorted(self.ids, grams), max(0, len(self.ids) - 1))
        known = self.ids[at] == grams if len(self.ids) else np.zeros(len(grams), bool)
        self.n[at[known]] += n[known]
        fresh = ~known & (n > 1)
        ids, n = np.concatenate([self.ids, grams[fresh]]), np.concatenate([self.n, n[fresh]])
        if len(ids) > self.limit:
            best = np.argpartition(-n, self.limit)[: self.limit]
            ids, n = ids[best], n[best]
        order = np.argsort(ids)
        self.ids, self.n = ids[order], n[order]


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of the pairs (x, y); mixed, so that sums and differences inside a run do not cancel."""
    with np.errstate(over="ignore"):
        return mix(x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive word hashes; equal runs have equal hashes wherever they stand. Runs are joined from runs of 1, 2, 4, ... words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    runs, size, done = hashes, 1, 0
    out = np.full(len(hashes) + 1, np.uint64(width), np.uint64)
    while size <= width:
        if width & size:
            left = len(hashes) - done - size + 1
            out = _joined(out[:left], runs[done : done + left])
            done += size
        size *= 2
        if size <= width:
            runs = _joined(runs[: -size // 2], runs[size // 2 :])
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only where none is set (tests on one machine) it lies below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints").rstrip("/")


def stored(df: DataFrame, eager: bool = True) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cut from its lineage, columnar and compressed."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
