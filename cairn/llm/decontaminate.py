"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items, by block-max WAND.

Index. Items are folded to words (A-Z lower, other ASCII that is no letter or digit parts words). An item's BM25 impacts
are divided by the score of the item against itself, so a passage's score is the share of the item's weight that it
covers, and one threshold THETA holds for all. Postings are cut in blocks of BLOCK_ITEMS items; a term's list names the
blocks that hold it, each with the largest impact in it.

Query. Passages are two adjacent cells of as many words as the longest item, one every cell, so each stretch of an item's
length lies within one. All passages of a slice are asked at once, in four steps that each only see what the one before left.
(1) A passage whose terms' largest impacts do not sum to THETA is dropped. (2) The other passages' terms stand in the order
of their largest impact; the pivot is the first at which their sum reaches PIVOT * THETA. Only the lists from the pivot on
are walked; a block is left if its maxima there, with all that the terms before the pivot can add, stay below THETA.
(3) In the blocks that remain the same bound is taken for each item. (4) The items that remain are scored in full. All items
above THETA are retrieved; nothing is cut off, and memory follows the lists walked, VISITS entries at a time.

Verification. A hit counts if the passage holds at least OVERLAP of the item's distinct runs of GRAM words (fewer if the
item is shorter), and PART_OVERLAP of those of its question and of its answer. The answer is what follows "answer:" (or "a:")
at a line's start, and a leading "question:" (or "q:") is no part of an item; an item without that mark is split in the middle.

The index is built on the driver from GROUP_ITEMS items at a time; more items make more passes over the documents, so
what goes to the executors is bounded. The number of items, their lengths and the items of each word are counted once over
the whole benchmark (on the driver one number for each of its distinct words), so groups part postings and nothing else.
Null and empty texts, and items without words, match nothing; a null doc_id stays null. Repeated rows of documents give
repeated results; of repeated item ids each row is an item. An empty table on either side gives no hits. `find` reads only
doc_id, text and item_id, text; `clean` keeps all columns whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licenses import fold
from .textkit import slices, unique

K1, B = 1.2, 0.75
THETA = 0.5
GRAM, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
BLOCK_ITEMS, GROUP_ITEMS = 8, 2048
LEAST_CELL = 32
SLICE = 2 << 20
#: Share of theta that the terms before a passage's pivot stay below, and entries of lists that are walked at a time.
PIVOT, VISITS = 0.25, 1 << 20
SCHEMA = "doc_id bigint, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double, first_word bigint"
_QUESTION = re.compile(r"^\s*(?:question|q)\s*:", re.IGNORECASE)
_ANSWER = re.compile(r"^\s*(?:answer|a)\s*:", re.IGNORECASE | re.MULTILINE)


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and answer."""
    text = _QUESTION.sub("", text)
    mark = _ANSWER.search(text)
    if mark and fold(text[: mark.start()]).split() and fold(text[mark.end() :]).split():
        return fold(text[: mark.start()]).split(), fold(text[mark.end() :]).split()
    words = fold(text).split()
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def grams(words: list, n: int) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Counts:
    """Of all items that have words: their number, the sum and the largest of their lengths, and the items that hold each word."""

    n: int = 0
    total: int = 0
    longest: int = 0
    items: Counter[bytes] = field(default_factory=Counter)

    def add(self, texts: Iterable[str | None]) -> Counts:
        for question, answer in (parts(x or "") for x in texts):
            if size := len(question) + len(answer):
                self.n, self.total, self.longest = self.n + 1, self.total + size, max(self.longest, size)
                self.items.update({*question, *answer})
        return self


class Index:
    """Items as ordered by id; term 0 stands for every word that no item holds. counts: of the whole benchmark, where items are a group of it."""

    def __init__(self, items: list[tuple[int, str]], theta: float = THETA, counts: Counts | None = None) -> None:
        self.theta = theta
        counts = counts or Counts().add(text for _, text in items)
        cut = [(i, *parts(text or "")) for i, text in items]
        cut = [c for c in cut if c[1] or c[2]]
        self.ids = [c[0] for c in cut]
        self.terms: dict[bytes, int] = {}
        words = [q + a for _, q, a in cut]
        for w in words:
            for x in w:
                if x not in self.terms:
                    self.terms[x] = len(self.terms) + 1
        self.cell = max(LEAST_CELL, counts.longest)
        n, v = len(cut), len(self.terms) + 1
        coded = [[self.terms[x] for x in w] for w in words]
        df = np.array([0, *(counts.items[x] for x in self.terms)])
        idf = np.log(1 + (counts.n - df + 0.5) / (df + 0.5))
        mean = counts.total / max(1, counts.n)
        self.n_blocks = -(-n // BLOCK_ITEMS)
        # Postings in the order of (term, item): item and impact. An entry of a term's list stands for those of one block.
        self.item_terms, self.item_impacts = [], []
        for c in coded:
            at, tf = np.unique(c, return_counts=True)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean))
            self.item_terms.append(at)
            self.item_impacts.append(impact / impact.sum())
        self.grams = [grams(c, GRAM) for c in coded]
        self.question = [grams([self.terms[x] for x in q], GRAM) for _, q, _ in cut]
        self.answer = [grams([self.terms[x] for x in a], GRAM) for _, _, a in cut]
        if not n:
            return
        term, item = np.concatenate(self.item_terms), np.repeat(np.arange(n), [len(t) for t in self.item_terms])
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], np.concatenate(self.item_impacts)[order]
        place = term * self.n_blocks + self.item // BLOCK_ITEMS
        self.first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.n_postings = np.diff(np.concatenate([self.first, [len(place)]]))
        self.block, self.maxima = place[self.first] % self.n_blocks, np.maximum.reduceat(self.impact, self.first)
        self.lists = np.searchsorted(term[self.first], np.arange(v + 1))
        self.term_max = np.zeros(v)
        np.maximum.at(self.term_max, term, self.impact)

    def retrieve(self, term: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of all items above theta; passage k has the terms starts[k] to ends[k], in the order of their largest impact."""
        least = self.theta - 1e-9
        most = self.term_max[term]
        sums = np.concatenate([[0.0], np.cumsum(most)])
        passage = np.repeat(np.arange(len(starts)), ends - starts)
        beyond = sums[1:] - sums[starts][passage] >= PIVOT * self.theta
        before = np.add.reduceat(np.where(beyond, 0.0, most), starts)
        rows = np.flatnonzero(beyond)
        n = np.diff(self.lists)[term[rows]]
        at = np.concatenate([[0], np.cumsum(n)])
        last = np.flatnonzero(np.concatenate([passage[rows][1:] != passage[rows][:-1], [True]])) + 1
        low = 0
        while low < len(rows):
            # Whole passages, with about VISITS entries.
            high = int(last[max(np.searchsorted(at[last], at[low] + VISITS, side="right") - 1, np.searchsorted(last, low, side="right"))])
            some, m, zero = rows[low:high], n[low:high], passage[rows[low]]
            entry = np.repeat(self.lists[term[some]] - (at[low:high] - at[low]), m) + np.arange(int(m.sum()))
            key = np.repeat(passage[some] - zero, m) * self.n_blocks + self.block[entry]
            bound = np.bincount(key, self.maxima[entry])
            open_ = bound + before[zero + np.arange(len(bound)) // self.n_blocks] >= least
            left = open_[key]
            visited, key = np.unique(key[left], return_inverse=True)
            entry, m = entry[left], self.n_postings[entry[left]]
            posting = np.repeat(self.first[entry] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            cell = np.repeat(key, m) * BLOCK_ITEMS + self.item[posting] % BLOCK_ITEMS
            bound = np.bincount(cell, self.impact[posting], len(visited) * BLOCK_ITEMS)
            where = visited // self.n_blocks + zero
            for cell in np.flatnonzero(bound + np.repeat(before[where], BLOCK_ITEMS) >= least).tolist():
                k, item = int(where[cell // BLOCK_ITEMS]), int(visited[cell // BLOCK_ITEMS] % self.n_blocks) * BLOCK_ITEMS + cell % BLOCK_ITEMS
                score = float(self.item_impacts[item][np.isin(self.item_terms[item], term[starts[k] : ends[k]])].sum())
                if score >= self.theta:
                    yield k, item, score
            low = high

    def verify(self, item: int, words: list[int]) -> tuple[float, float, float] | None:
        """(overlap, of the question, of the answer) if the passage holds enough of the item. A run shorter than GRAM is looked for at its own length."""

        def share(want: set[tuple]) -> float:
            if not want:
                return 1.0
            n = len(next(iter(want)))
            return len(want & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) / len(want)

        whole = share(self.grams[item])
        if whole < OVERLAP:
            return None
        question, answer = share(self.question[item]), share(self.answer[item])
        return (whole, question, answer) if min(question, answer) >= PART_OVERLAP else None

    def search(self, texts: list[bytes]) -> list[tuple]:
        """(text number, item, score, overlap, question overlap, answer overlap, first word of the passage) of each verified hit, the best passage of each."""
        if not self.ids:
            return []
        coded = [np.fromiter(map(self.terms.get, w, repeat(0)), np.int64, len(w)) for w in (fold(t).split() for t in texts)]
        n_cells = np.array([max(1, -(-len(c) // self.cell)) for c in coded])
        base = np.concatenate([[0], np.cumsum(n_cells + 1)[:-1]])  # an empty cell parts texts
        cell = np.concatenate([b + np.arange(len(c)) // self.cell for b, c in zip(base, coded, strict=True)])
        flat = np.concatenate(coded)
        known = flat > 0
        v = len(self.terms) + 1
        total = int(base[-1] + n_cells[-1] + 1)
        real = np.zeros(total, bool)
        real[np.concatenate([b + np.arange(n) for b, n in zip(base, n_cells, strict=True)])] = True
        # Distinct (passage, term) pairs; a passage is named by its first cell.
        here, term = cell[known], flat[known]
        before = (here > 0) & real[here - 1]
        pairs = unique(np.concatenate([here * v + term, (here[before] - 1) * v + term[before]]))
        bound = np.bincount(pairs // v, self.term_max[pairs % v], total)
        pairs = pairs[bound[pairs // v] >= self.theta - 1e-9]
        if not len(pairs):
            return []
        where, term = pairs // v, pairs % v
        order = np.lexsort((self.term_max[term], where))
        where, term = where[order], term[order]
        starts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        ends = np.concatenate([starts[1:], [len(where)]])
        best: dict[tuple[int, int], tuple] = {}
        for k, item, x in self.retrieve(term, starts, ends):
            passage = int(where[starts[k]])
            text = int(np.searchsorted(base, passage, side="right")) - 1
            first = (passage - int(base[text])) * self.cell
            if x > best.get((text, item), (0.0,))[0] and (checked := self.verify(item, coded[text][first : first + 2 * self.cell].tolist())):
                best[text, item] = (x, *checked, first)
        return [(text, item, *rest) for (text, item), rest in sorted(best.items())]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's items: a row for each word, and one without a word for the rest."""
    c = Counts()
    for batch in batches:
        c.add(batch.column("text").to_pylist())
    n = len(c.items)
    yield pa.RecordBatch.from_arrays([pa.array([None, *c.items], pa.binary()), pa.array([c.n, *c.items.values()], pa.int64()), pa.array([c.total] + [0] * n, pa.int64()), pa.array([c.longest] + [0] * n, pa.int64())], ["word", "n", "total", "longest"])


def benchmark_counts(benchmark: DataFrame) -> Counts:
    out = Counts()
    rows = benchmark.select("text").mapInArrow(_counter, "word binary, n bigint, total bigint, longest bigint")
    for r in rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("longest").alias("longest")).toLocalIterator():
        if r["word"] is None:
            out.n, out.total, out.longest = r["n"], r["total"], r["longest"]
        else:
            out.items[bytes(r["word"])] = r["n"]
    return out


def _groups(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items by id, GROUP_ITEMS at a time."""
    group: list[tuple[int, str]] = []
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        group.append((r["item_id"], r["text"]))
        if len(group) == GROUP_ITEMS:
            yield group
            group = []
    if group:
        yield group


def _matcher(index: Index):
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in slices(batch, "text", SLICE):
                ids = batch.column("doc_id").slice(low, high - low).to_pylist()
                found = [(ids[text], index.ids[item], *rest) for text, item, *rest in index.search(texts)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return run


def _cleaner(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in slices(batch, "text", SLICE):
                clean = np.ones(high - low, bool)
                clean[[text for text, *_ in index.search(texts)]] = False
                yield batch.slice(low, high - low).filter(pa.array(clean))

    return run


def find(documents: DataFrame, benchmark: DataFrame, theta: float = THETA) -> DataFrame:
    """One row per row of documents (doc_id, text) and item of benchmark (item_id, text) that it leaks. No shuffle."""
    found, counts = None, benchmark_counts(benchmark)
    for group in _groups(benchmark):
        more = documents.select("doc_id", "text").mapInArrow(_matcher(Index(group, theta, counts)), SCHEMA)
        found = more if found is None else found.unionAll(more)
    return documents.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def clean(documents: DataFrame, benchmark: DataFrame, theta: float = THETA) -> DataFrame:
    """documents without the rows that leak an item, with all columns."""
    counts = benchmark_counts(benchmark)
    for group in _groups(benchmark):
        documents = documents.mapInArrow(_cleaner(Index(group, theta, counts)), documents.schema)
    return documents
