"""Substring deduplication by seed and extend: repeated passages of MIN_WORDS words or more, exactly, without pairs of documents.

Seeds. In every run of MIN_WORDS words the GRAM-word sequence that comes first in an order of all of them is its anchor (the
leftmost of equal ones), so equal runs have equal anchors at equal places, wherever they stand. The order is by hash, but
sequences that take at least a share of 1 / HEAVY of all places come last; there are at most HEAVY, found in one pass over all
texts. About two in MIN_WORDS - GRAM + 2 places are anchors; they are what documents are joined on. So a common phrase is an
anchor only for runs that hold nothing but common phrases, and those are joined on a hash of the run itself: no anchor
gathers all the contexts of a common phrase in one task.

Extension. An anchor carries a 64-bit hash for each run around it that it anchors: how far a match reaches to the left
and to the right of the anchor is read off the runs that agree, in one pass over the occurrences of an anchor in the order of
documents. A run that an earlier occurrence has too is a repeat; repeats that follow one another join to the maximal
ones. Nothing grows with the square of a group: an occurrence is compared with the set of runs seen so far. Two runs are
taken as equal if 32 bits of anchor hash and 64 bits of run hash agree.

Before the shuffle, runs that occur again within a slice of a task (or were found often before in that task) are settled
on the spot, so that a passage in a third of all documents sends few rows per task.

Null and empty texts, and texts of fewer words than MIN_WORDS, repeat nothing. A document is a doc_id with a text: rows equal
in both are one document, whose repeats apply to each of them; rows that share an id but not a text are documents of their
own, in the order of a hash of the text, and so are rows without an id, which come before all others. An empty table gives no
rows. Only doc_id and text are read, so further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Counts, WordHashes, mix, slices, stored, windows

MIN_WORDS = 20
GRAM = 4
#: Windows that a task remembers as frequent; it bounds memory and decides only where a repeat is settled.
REMEMBERED = 1 << 18
#: A share of 1 / HEAVY of all places makes a sequence common, if it has LEAST_HEAVY places at all; that decides where runs meet, never the result.
HEAVY, LEAST_HEAVY = 1 << 16, 1 << 10
NO_ID = -(1 << 63)
#: Low bits of a hash that give way to the place in its slice; more only for a single text of over 2**24 words.
_PLACE_BITS = 24
_SEED = "key int, doc_key bigint, text_key bigint, start int, n int, data binary"
_SPAN = "doc_key bigint, text_key bigint, start int, n int"
_NAMES = [c.split()[0] for c in _SEED.split(", ")]
#: Doc_key, text_key and start of places.
Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def runs(where: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of runs of consecutive numbers in `where` along which all arrays of `same` stay constant."""
    if not len(where):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.diff(where) != 1
    for x in same:
        cut |= np.diff(x) != 0
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return first, np.diff(np.concatenate([first, [len(where)]]))


def earlier(ids: np.ndarray, at: Places, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether an equal id stands at an earlier place, index of the first of each id, ids' counts). With a key, ids are equal only under one key."""
    doc, text, start = at
    order = np.argsort(ids) if key is None else np.lexsort((ids, key))
    head = np.concatenate([[True], ids[order][1:] != ids[order][:-1]]) if len(ids) else np.empty(0, bool)
    if key is not None and len(ids):
        head[1:] |= key[order][1:] != key[order][:-1]
    # Only ids that occur again need the order of their places.
    several = np.flatnonzero(~head | np.concatenate([~head[1:], np.zeros(min(1, len(head)), bool)]))
    some = order[several]
    order[several] = some[np.lexsort((start[some], text[some], doc[some], ids[some], *([] if key is None else [key[some]])))]
    group = np.cumsum(head) - 1
    first = order[head]
    again = np.empty(len(ids), bool)
    lead = first[group]
    again[order] = ~head & ~((doc[order] == doc[lead]) & (text[order] == text[lead]) & (start[order] == start[lead]))
    return again, first, np.bincount(group, minlength=len(first))


class Frequent:
    """Windows that a task met often, with the first place it saw each at."""

    def __init__(self) -> None:
        self.ids, self.at = np.empty(0, np.uint64), (np.empty(0, np.int64),) * 3

    def settled(self, ids: np.ndarray, at: Places) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), bool)
        i = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        later = np.zeros(len(ids), bool)
        for here, there in zip(reversed(at), reversed(self.at), strict=True):
            later = (here > there[i]) | ((here == there[i]) & later)
        return (self.ids[i] == ids) & later

    def add(self, ids: np.ndarray, at: Places) -> None:
        ids = np.concatenate([self.ids, ids])[-REMEMBERED:]
        at = tuple(np.concatenate(x)[-REMEMBERED:] for x in zip(self.at, at, strict=True))
        _, first, _ = earlier(ids, at)
        self.ids, self.at = ids[first], tuple(x[first] for x in at)


def _counter(gram: int):
    """The most frequent sequences of a task and their counts; a null one with the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), Counts(HEAVY)
        for batch in batches:
            for _, _, texts in slices(batch, "text"):
                counts.add(windows(hashes.of(texts)[0], gram))
        kept = counts.n > counts.total // (4 * HEAVY)
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts.ids[kept].view(np.int64).tolist()], pa.int64()), pa.array([counts.total, *counts.n[kept].tolist()], pa.int64())], ["gram", "n"])

    return run


def common(texts: DataFrame, gram: int) -> np.ndarray:
    """Sorted hashes of the common sequences of texts (text): at most HEAVY numbers."""
    counts = stored(texts.select("text").mapInArrow(_counter(gram), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.filter("gram IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.filter((F.col("n") >= LEAST_HEAVY) & (F.col("n") * HEAVY >= total) & F.col("gram").isNotNull()).select("gram").toPandas()
    return np.sort(found["gram"].to_numpy(np.int64).view(np.uint64))


def _seeder(width: int, gram: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often = WordHashes(), Frequent()
        for batch in batches:
            for low, high, texts in slices(batch, "text"):
                keys = [batch.column(c).slice(low, high - low).to_numpy() for c in ("doc_key", "text_key")]
                flat, lengths = hashes.of(texts)
                if lengths.max(initial=0) < width:
                    continue
                begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                grams, whole = windows(flat, gram), windows(flat, width)
                last = heavy[np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)] == grams if len(heavy) else np.zeros(len(grams), bool)
                place = np.arange(len(grams), dtype=np.uint64)
                mask = np.uint64((1 << max(_PLACE_BITS, len(grams).bit_length())) - 1)
                order = (grams >> np.uint64(1)) | (last.astype(np.uint64) << np.uint64(63))
                best = sliding_min((order & ~mask) | place, width - gram + 1)
                owner = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - width + 1))
                at = np.concatenate([b + np.arange(max(0, n - width + 1)) for b, n in zip(begin, lengths, strict=True)])
                anchor = (best[at] & mask).astype(np.int64)
                where = (keys[0][owner], keys[1][owner], at - begin[owner])
                ids = mix(grams[anchor] ^ whole[at] * np.uint64(0x9E3779B97F4A7C15))
                again, first, counts = earlier(ids, where)
                again |= often.settled(ids, where)
                some = first[counts > 1]
                often.add(ids[some], tuple(x[some] for x in where))
                # A run of nothing but common sequences meets its like by its own hash.
                alone = last[anchor]
                key = mix(np.where(alone, ids, grams[anchor])).view(np.int64).astype(np.int32)
                here = np.flatnonzero(again)
                f, n = runs(at[here], owner[here])
                i = here[f]
                yield _seeds(key[i], where, i, n, pa.nulls(len(i), pa.binary()))
                here = np.flatnonzero(~again)
                f, n = runs(at[here], owner[here], anchor[here], np.where(alone[here], here, -1))
                i = here[f]
                ends = np.concatenate([[0], np.cumsum(n)]) * 8
                data = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(whole[at[here]].astype("<u8").tobytes())])
                yield _seeds(key[i], where, i, n, data)

    return run


def _seeds(key: np.ndarray, at: Places, i: np.ndarray, n: np.ndarray, data: pa.Array) -> pa.RecordBatch:
    doc, text, start = (x[i] for x in at)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(text), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), data], _NAMES)


def _spans(at: Places, n: np.ndarray) -> pa.RecordBatch:
    doc, text, start = at
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_key", "text_key", "start", "n"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key and place -> runs of repeats. Of the last key of a batch, the runs seen go on to the next batch."""
    open_key, seen, seen_at = None, np.empty(0, np.uint64), (np.empty(0, np.int64),) * 3
    for batch in batches:
        settled = batch.column("data").is_null().to_numpy(zero_copy_only=False)
        key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
        where = tuple(batch.column(c).to_numpy() for c in ("doc_key", "text_key", "start"))
        if settled.any():
            yield _spans(tuple(x[settled] for x in where), n[settled])
        rows = np.flatnonzero(~settled)
        if not len(rows):
            continue
        data = batch.column("data").filter(pa.array(~settled))
        body = np.frombuffer(b"".join(data.to_pylist()), "<u8")
        of = np.repeat(rows, n[rows])
        offset = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n[rows])[:-1]]), n[rows])
        ids, keys = body, key[of]
        at = (where[0][of], where[1][of], where[2][of].astype(np.int64) + offset)
        carried = len(seen) if open_key == key[rows[0]] else 0
        if carried:
            ids, at = np.concatenate([seen, ids]), tuple(np.concatenate(x) for x in zip(seen_at, at, strict=True))
            keys = np.concatenate([np.full(carried, open_key, keys.dtype), keys])
        again, first, _ = earlier(ids, at, keys)
        open_key = key[rows[-1]]
        last = np.concatenate([np.full(carried, open_key == key[rows[0]]), key[of] == open_key])
        keep = first[last[first]]
        seen, seen_at = ids[keep], tuple(x[keep] for x in at)
        here = np.flatnonzero(again)
        here = here[here >= carried]
        f, length = runs(here, of[here - carried])
        if len(f):
            yield _spans(tuple(x[here[f]] for x in at), length)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and the two keys of the document: doc_id (NO_ID for null) and a hash of the text."""
    return documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key"), F.xxhash64("text").alias("text_key"))


def spans(documents: DataFrame, width: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_key, text_key, start, n: at n consecutive words from start (words from 0) begin runs of `width` words that occur earlier too."""
    seeds = _keyed(documents).select("doc_key", "text_key", "text").mapInArrow(_seeder(width, gram, common(documents, gram)), _SEED)
    return seeds.repartition("key").sortWithinPartitions("key", "doc_key", "text_key", "start").mapInArrow(_extend, _SPAN)


def _cutter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in slices(batch, "text"):
                part = batch.slice(low, high - low)
                found = part.column("spans").to_pylist()
                out = []
                for text, some in zip(texts, found, strict=True):
                    words = text.split()
                    drop = np.zeros(len(words) + 1, np.int64)
                    for span in some or ():
                        if span["start"] < len(words):
                            drop[span["start"]] += 1
                            drop[min(len(words), span["start"] + span["n"] + width - 1)] -= 1
                    gone = np.cumsum(drop)[:-1] > 0
                    begins = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if begins else words
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), begins))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"])

    return run


def remove(documents: DataFrame, width: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_spans (maximal repeats removed) of each row of documents (doc_id, text)."""
    found = spans(documents, width, gram).groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = _keyed(documents).join(found, ["doc_key", "text_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cutter(width), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_spans bigint")


#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + {MIN_WORDS}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {MIN_WORDS - 1})) AS p FROM w WHERE len(ws) >= {MIN_WORDS})),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + {MIN_WORDS})) AS q FROM dup) GROUP BY doc_id),
word AS (SELECT w.doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS q FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n FROM word LEFT JOIN gone USING (doc_id) WHERE gone.qs IS NULL OR NOT list_contains(gone.qs, q) GROUP BY word.doc_id),
spans AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM dup) WHERE before IS NULL OR p - before > {MIN_WORDS} GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256, coalesce(spans.n, 0)::BIGINT AS n_spans
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
