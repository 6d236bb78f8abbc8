"""Exact n-gram Jaccard join by set relations: index-level and answer-level skipping.

A document's set holds the 64-bit hashes of its distinct runs of GRAM words. Two documents link when the Jaccard
similarity of their sets reaches PERCENT / 100. Equal sets are one node (their hash); a node's copies never meet.

1. Order. Every task summarises the counts of its grams (the most frequent ones it met, bounded); summed, the HEAVY most
   frequent go last in the global order, by count, all others first, by hash. The order decides how much work is done,
   never the result. Sets that link share a gram among their first |x| - ceil(t |x|) + 1 in that order.
2. Index. Each set posts these grams with its size and the gram's position. A gram's list is sorted by size, then position, and skipped in
   blocks: a block is left once its sizes exceed |x| / t, and passed over where the positions in it and in the asking block leave
   too few grams for the overlap that their sizes need; inside, the same bound holds for each pair. Pairs of
   short lists, and the rows of long ones, then meet the sets' sketches (counts of grams by hash in cells), whose distance
   bounds the symmetric difference from below. A long list becomes a forest: of n sets n - 1 edges at most go on.
3. The edges' components hold every link, and a component is one family of similar sets. Their texts are brought
   together as blocks of FAMILY_ROWS, so that no family is a single task's work. Each block is joined with itself and with the
   family's first one. That settles a family whose sets hang together, as a hot group of near copies does: each text is sent
   twice (those of the first block once a block, which is once for each other text). Only families that are still in
   several linked groups go on: blocks of one group each (small groups share blocks) meet the blocks of other groups whose
   sizes are in reach.
4. Answers. A block of a family has an index of its grams. The first set's overlaps with all sets of the block are counted from it. They also tell how
   similar each later set is to it: a later set takes over the overlaps of the most similar set that has been asked about, less the lists of
   the grams that only that one holds, plus the lists of the grams that only it holds itself, wherever these are fewer than its own grams. So
   near copies cost the lists of what they differ in. Once a set links to one of a group, the group's other members are skipped, since
   they are linked already. Overlaps are those of the whole sets, so links are exact. Linked nodes become components.

No words or text: an empty set, linked with nothing. Fewer words than GRAM: the whole sequence is the one gram. doc_id is
the key of a row; its text is found again by id and a hash of the text, so rows that share an id may differ in text. Repeated
rows are copies of one node, each with its row. A null id takes part; a component of nothing but null ids has a null
component_id. An empty table gives no rows. Only doc_id and text are read, so further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textkit import Counts, WordHashes, mix, slices, stored, unique, windows

GRAM, PERCENT = 3, 90
HEAVY = 1 << 16
TASK_COUNTS = 1 << 16
FAMILY_ROWS = 512
_POST = "gram bigint, node bigint, size int, place int"
_LIST = "gram bigint, a bigint, b bigint, size int, place int"
_EDGE = "a bigint, b bigint"
_SURVEY = "doc_id bigint, key bigint, node bigint, n_shingles bigint, sketch binary, gram bigint, n bigint"


def need(size: np.ndarray | int, percent: int):
    """Least overlap of a set with any set it links to: ceil(percent / 100 * size)."""
    return -(-size * percent // 100)


def overlap(x, y, percent: int):
    """Least overlap of two linked sets: 100 * o >= percent * (x + y - o)."""
    return -(-percent * (x + y) // (100 + percent))


class Shingler:
    """Texts -> sorted distinct gram hashes."""

    def __init__(self, gram: int) -> None:
        self.gram, self.words = gram, WordHashes(fold_case=True)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        flat, counts = self.words.of(texts)
        grams = windows(flat, self.gram)
        out, at = [], 0
        for n in counts.tolist():
            if n >= self.gram:
                out.append(unique(grams[at : at + n - self.gram + 1]))
            else:
                out.append(windows(flat[at : at + n], n) if n else flat[:0])
            at += n
        return out


def node_of(grams: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit number."""
    if not len(grams):
        return 0
    mixed = mix(grams)
    with np.errstate(over="ignore"):
        both = mixed.sum(dtype=np.uint64, keepdims=True) * np.uint64(0x9E3779B97F4A7C15) ^ np.bitwise_xor.reduce(mixed) ^ np.uint64(len(grams))
        return int(mix(both)[0].view(np.int64))


def _surveyor(gram: int, percent: int):
    """Two kinds of rows: of each document its node, size and sketch; and of each task its most frequent grams with their counts, a summary of bounded size over all its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(gram)
        counts = Counts(TASK_COUNTS)
        names = ["doc_id", "key", "node", "n_shingles", "sketch", "gram", "n"]
        for batch in batches:
            for low, high, texts in slices(batch, "text"):
                sets = shingler.sets(texts)
                none = pa.nulls(high - low, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low).cast(pa.int64()), batch.column("key").slice(low, high - low), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, percent) for s in sets], pa.binary()), none, none], names)
                counts.add(np.concatenate(sets))
        none = pa.nulls(len(counts.ids), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(none), pa.binary()), pa.array(counts.ids.view(np.int64)), pa.array(counts.n)], names)

    return run


def heavy_grams(counts: DataFrame, limit: int = HEAVY) -> np.ndarray:
    """The most frequent grams of counts (gram, n), rarest of them first: at most `limit` numbers, whatever the input."""
    total = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    rows = total.filter("n > 2").orderBy(F.desc("n"), "gram").limit(limit).toPandas()
    return rows["gram"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def sketch_cells(size: int, percent: int) -> int:
    """Cells of a set's sketch: a power of two that sets unrelated ones apart. The counts of two unrelated sets of n grams in c cells differ by about 1.1 sqrt(n c) in all, links by d n at most, where d = 2 (1 - t) / (1 + t); c = 4 d^2 n gives twice that."""
    d = 2 * (100 - percent) / (100 + percent)
    return min(4096, max(16, 1 << int(np.ceil(np.log2(max(1.0, 4 * d * d * size))))))


def sketch(grams: np.ndarray, percent: int) -> bytes:
    """Counts of grams by the low bits of their hash, modulo 256."""
    cells = sketch_cells(len(grams), percent)
    return np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8).tobytes()


def folded(sketches: list[bytes], cells: int) -> np.ndarray:
    """Sketches of one width brought to fewer cells; counts add up modulo 256."""
    width = len(sketches[0])
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), width // cells, cells).sum(1, dtype=np.uint8)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference from sketches of one width."""
    d = x - y
    return np.minimum(d, np.negative(d)).sum(1, dtype=np.int64)


def prefix(grams: np.ndarray, heavy: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """The first `length` grams in the global order. heavy is sorted, rank its places in the order."""
    if not len(heavy):
        return grams[:length]
    at = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
    last = heavy[at] == grams
    light = grams[~last][:length]
    if len(light) < length:
        late = grams[last]
        light = np.concatenate([light, late[np.argsort(rank[at[last]], kind="stable")][: length - len(light)]])
    return light


def _poster(heavy_in_order: np.ndarray, gram: int, percent: int):
    """Postings of each distinct set of a slice, and a row (gram null) that names the node and size of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(gram)
        order = np.argsort(heavy_in_order)
        heavy, rank = heavy_in_order[order], order
        for batch in batches:
            for _, _, texts in slices(batch, "text"):
                done: set[int] = set()
                cols: list[list] = [[], []]
                for grams in shingler.sets(texts):
                    n = len(grams)
                    node = node_of(grams)
                    if not n or node in done:
                        continue
                    done.add(node)
                    some = prefix(grams, heavy, rank, n - int(need(n, percent)) + 1)
                    cols[0].append(some)
                    cols[1].append((node, n, len(some)))
                if cols[0]:
                    grams = np.concatenate(cols[0])
                    node, n, k = (np.array(x, np.int64) for x in zip(*cols[1], strict=True))
                    place = np.arange(len(grams)) - np.repeat(np.concatenate([[0], np.cumsum(k)[:-1]]), k)
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.repeat(node, k)), pa.array(np.repeat(n, k).astype(np.int32)), pa.array(place.astype(np.int32))], ["gram", "node", "size", "place"])

    return run


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            over = up[up]
            if (over == up).all():
                return up
            up[:] = over

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def in_reach(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (size of i not above that of j) neither length nor position excludes."""
    x, y = size[i], size[j]
    return (y * percent <= x * 100) & (np.minimum(x - place[i], y - place[j]) >= overlap(x, y, percent))


def list_edges(node: np.ndarray, size: np.ndarray, place: np.ndarray, sketches: list[bytes], percent: int, block: int = 256) -> list[tuple[int, int]]:
    """Forest over the pairs of a gram's list, sorted by size and place, that no bound excludes."""
    n = len(node)
    left = size - place  # grams from the common one on, which bound an overlap
    forest, edges = Forest(n), []
    widths = np.array([len(s) for s in sketches])
    kinds = np.unique(widths).tolist()
    marks = {}
    for w in kinds:
        marks[w] = np.zeros((n, w), np.uint8)
        for other in [k for k in kinds if k >= w]:
            rows = np.flatnonzero(widths == other)
            marks[w][rows] = folded([sketches[r] for r in rows], w)
    limit = np.searchsorted(size, size * 100 // percent, side="right")
    for a in range(0, n, block):
        b = min(n, a + block)
        for start in range(a, int(limit[a:b].max(initial=0)), block):
            end = min(n, start + block)
            if min(left[a:b].max(), left[start:end].max()) < overlap(size[a], size[start], percent):
                continue  # by position: sizes ascend, so no pair needs less
            roots = forest.roots()
            # Answers already implied by the forest are skipped.
            i, j = np.nonzero((roots[a:b, None] != roots[None, start:end]) & (np.arange(start, end)[None, :] > np.arange(a, b)[:, None]))
            i, j = i + a, j + start
            good = in_reach(size, place, i, j, percent)
            i, j = i[good], j[good]
            most = size[i] + size[j] - 2 * overlap(size[i], size[j], percent)
            w = np.minimum(widths[i], widths[j])
            good = np.zeros(len(i), bool)
            for v in np.unique(w).tolist():
                of = np.flatnonzero(w == v)
                for cut in range(0, len(of), max(1, (1 << 22) // v)):
                    some = of[cut : cut + max(1, (1 << 22) // v)]
                    good[some] = distance(marks[v][i[some]], marks[v][j[some]]) <= most[some]
            i, j = i[good], j[good]
            while len(i):
                roots = forest.roots()
                apart = roots[i] != roots[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                _, lead = np.unique(roots[j], return_index=True)
                for p, q in zip(i[lead].tolist(), j[lead].tolist(), strict=True):
                    if forest.join(p, q):
                        edges.append((int(node[p]), int(node[q])))
    return edges


#: The pairs of lists up to this length go on one by one; longer lists go on as lists.
SHORT_LIST = 12


def table_lists(table: pa.Table, percent: int, last: bool) -> tuple[pa.RecordBatch | None, int]:
    """(pairs of short lists, rows of long ones; first row of the list that is still open) of a table in (gram, size, place, node) order."""
    gram, node, size, place = (table.column(c).to_numpy() for c in ("gram", "node", "size", "place"))
    rest = len(gram) if last or not len(gram) else int(np.searchsorted(gram, gram[-1]))
    gram, node, size, place = (x[:rest] for x in (gram, node, size, place))
    if not rest:
        return None, rest
    # Copies of a set post the same rows; one stays.
    keep = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
    gram, node, size, place = (x[keep] for x in (gram, node, size, place))
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    length = np.diff(np.concatenate([start, [len(gram)]]))
    n = np.repeat(length, length)
    shared = n > 1
    if not shared.any():
        return None, rest
    gram, node, size, place, n = (x[shared] for x in (gram, node, size.astype(np.int64), place.astype(np.int64), n))
    short = n <= SHORT_LIST
    found = []
    for k in range(1, SHORT_LIST):
        i = np.flatnonzero(short[:-k] & (gram[k:] == gram[:-k]))
        if not len(i):
            break
        i = i[in_reach(size, place, i, i + k, percent)]
        found.append(np.stack([np.minimum(node[i], node[i + k]), np.maximum(node[i], node[i + k])], 1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    if len(pairs):
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]
    long = np.flatnonzero(~short)
    none = lambda m, t: pa.nulls(m, t)
    m, q = len(pairs), len(long)
    if not m + q:
        return None, rest
    columns = [
        pa.concat_arrays([none(m, pa.int64()), pa.array(gram[long])]),
        pa.concat_arrays([pa.array(pairs[:, 0].copy()), pa.array(node[long])]),
        pa.concat_arrays([pa.array(pairs[:, 1].copy()), none(q, pa.int64())]),
        pa.concat_arrays([none(m, pa.int32()), pa.array(size[long].astype(np.int32))]),
        pa.concat_arrays([none(m, pa.int32()), pa.array(place[long].astype(np.int32))]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["gram", "a", "b", "size", "place"]), rest


def _by_list(work, *args):
    """Rows sorted by gram -> work(table of whole lists, *args, last): a list that spans batches is held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column("gram")[0] == batch.column("gram")[batch.num_rows - 1]:
                continue
            table = pa.Table.from_batches(held)
            made, rest = work(table, *args, False)
            held = table.slice(rest).combine_chunks().to_batches()
            if made is not None:
                yield made
        if held:
            made, _ = work(pa.Table.from_batches(held), *args, True)
            if made is not None:
                yield made

    return run


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not edges:
        return None
    rows = sorted(set(edges))
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in rows], pa.int64()), pa.array([e[1] for e in rows], pa.int64())], ["a", "b"])


def long_lists(table: pa.Table, percent: int, last: bool) -> tuple[pa.RecordBatch | None, int]:
    """Forests of long lists, from rows in (gram, size, place, node) order with their sketches."""
    gram, node, size, place = (table.column(c).to_numpy() for c in ("gram", "node", "size", "place"))
    rest = len(gram) if last else int(np.searchsorted(gram, gram[-1]))
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    edges: list[tuple[int, int]] = []
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(gram)], strict=True):
        if b <= rest:
            edges += list_edges(node[a:b], size[a:b].astype(np.int64), place[a:b].astype(np.int64), table.column("sketch").slice(a, b - a).to_pylist(), percent)
    return _edge_batch(edges), rest


def _near_pairs(percent: int):
    """Pairs (a, b, sizes, sketches) -> those that the sketches leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            sa, sb = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            wa, wb = (np.array([len(s) for s in c], np.int64) for c in (sa, sb))
            most = x + y - 2 * overlap(x, y, percent)
            good = np.zeros(len(x), bool)
            for p, q in {*zip(wa.tolist(), wb.tolist(), strict=True)}:
                rows = np.flatnonzero((wa == p) & (wb == q))
                w = min(p, q)
                good[rows] = distance(folded([sa[r] for r in rows], w), folded([sb[r] for r in rows], w)) <= most[rows]
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def candidates(posts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every link; nodes has (node, size, sketch)."""
    lists = stored(posts.repartition("gram").sortWithinPartitions("gram", "size", "place", "node").mapInArrow(_by_list(table_lists, percent), _LIST))
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    pairs = lists.filter("b IS NOT NULL").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    near = pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_near_pairs(percent), _EDGE)
    rows = lists.filter("b IS NULL").select("gram", F.col("a").alias("node"), "size", "place").join(nodes.select("node", "sketch"), "node")
    forests = rows.repartition("gram").sortWithinPartitions("gram", "size", "place", "node").mapInArrow(_by_list(long_lists, percent), _EDGE)
    return near.unionByName(forests)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def only(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What of the sorted set x is not in the sorted set y."""
    if not len(y):
        return x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return x[y[at] != x]


class Family:
    """Sets of one block with an index of their grams, and the overlaps that were computed with all of them: answers for one set are derived from those of a similar one."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        grams, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((of, grams))
        self.grams, self.of = grams[order], of[order].astype(np.int32)
        #: Sets asked about, and their overlaps with all sets of the block.
        self.asked: list[np.ndarray] = []
        self.answers = np.empty((0, len(sets)), np.int32)
        #: Entries of lists that were read.
        self.n_read = 0

    def counted(self, grams: np.ndarray) -> np.ndarray:
        """Overlaps with all sets, from the grams' lists."""
        left, right = np.searchsorted(self.grams, grams), np.searchsorted(self.grams, grams, side="right")
        n = right - left
        where = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        self.n_read += len(where)
        return np.bincount(self.of[where], minlength=len(self.sizes)).astype(np.int32)

    def overlaps(self, grams: np.ndarray, number: int | None) -> np.ndarray:
        """Overlaps of a set with all sets of the block. number: which of them it is itself, if it is one; then the earlier answers know how similar it is, else the last set asked about is tried."""
        if not self.asked:
            return self._kept(grams, self.counted(grams))
        last = len(self.asked) - 1
        if number is not None:
            apart = np.array([len(x) for x in self.asked]) + len(grams) - 2 * self.answers[: last + 1, number]
            last = int(apart.argmin())
        before = self.asked[last]
        gone, fresh = only(before, grams), only(grams, before)
        if len(gone) + len(fresh) >= len(grams):
            return self._kept(grams, self.counted(grams))
        return self._kept(grams, self.answers[last] + self.counted(fresh) - self.counted(gone))

    def _kept(self, grams: np.ndarray, both: np.ndarray) -> np.ndarray:
        n = len(self.asked)
        if n == len(self.answers):
            self.answers = np.concatenate([self.answers, np.zeros((max(16, n), len(self.sizes)), np.int32)])
        self.answers[n] = both
        self.asked.append(grams)
        return both

    def links(self, grams: np.ndarray, low: int, percent: int, number: int | None = None) -> np.ndarray:
        """The sets from number `low` on that link with the set of `grams`, by exact overlaps."""
        both = self.overlaps(grams, number).astype(np.int64)
        good = 100 * both >= percent * (len(grams) + self.sizes - both)
        good[:low] = False
        return np.flatnonzero(good)


def family_edges(nodes_a: list[int], sets_a: list[np.ndarray], nodes_b: list[int] | None, sets_b: list[np.ndarray] | None, percent: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Forest of the exact links inside a block, or between two blocks. groups: of all sets, where some are known to be linked.

    A set that is in a group with links is asked about only while sets outside its group remain in reach of its size:
    its answers follow from those of the set it is linked to, and only the rest is computed."""
    within = nodes_b is None
    others, sets = (nodes_a, sets_a) if within else (nodes_b, sets_b)
    n, m = len(nodes_a), len(others)
    forest, edges = Forest(n if within else n + m), []
    if groups is not None:
        _, first, inverse = np.unique(groups, return_index=True, return_inverse=True)
        forest.up = first[inverse]
    shift = 0 if within else n
    sizes_a, sizes_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets])
    low, high = need(sizes_a, percent), sizes_a * 100 // percent
    fits = (sizes_b[None, :] >= low[:, None]) & (sizes_b[None, :] <= high[:, None])
    family = None
    for i in range(n):
        roots = forest.roots()
        open_ = fits[i] & (roots[shift:] != roots[i])
        if within:
            open_[: i + 1] = False
        j = np.flatnonzero(open_)
        if len(j) > 4:
            family = family or Family(sets)
            hits = family.links(sets_a[i], i + 1 if within else 0, percent, i if within else None)
        else:
            hits = np.array([k for k in j if linked(sets_a[i], sets[k], percent)], np.int64)
        for k in hits.tolist():
            if forest.join(i, shift + k):
                edges.append((nodes_a[i], others[k]))
    return edges


def _families(gram: int, percent: int):
    """Rows in (part, side, node) order, with the group of each node -> exact edges; a part holds one or two blocks of a family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(gram)
        part, held = None, ([], [])

        def close() -> list[tuple[int, int]]:
            (na, sa, ga), (nb, sb, gb) = (tuple(map(list, zip(*rows, strict=True))) or ([], [], []) for rows in held)
            for rows in held:
                rows.clear()
            if nb:
                return family_edges(na, sa, nb, sb, percent, ga + gb) if na else []
            return family_edges(na, sa, None, None, percent, ga) if len(na) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            parts, sides, nodes, groups = (batch.column(c).to_pylist() for c in ("part", "side", "node", "grp"))
            for low, high, texts in slices(batch, "text"):
                for p, side, node, group, grams in zip(parts[low:high], sides[low:high], nodes[low:high], groups[low:high], shingler.sets(texts), strict=True):
                    if p != part:
                        found += close()
                        part = p
                    if not held[side] or held[side][-1][0] != node:  # else a repeated row
                        held[side].append((node, grams, group))
            if (made := _edge_batch(found)) is not None:
                yield made
        if (made := _edge_batch(close())) is not None:
            yield made

    return run


def _first_meetings(members: DataFrame) -> DataFrame:
    """members (node, root, blocks, text) with part, side and grp: each block alone, and with block 0 of its family."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    meets = F.transform(others, lambda j: F.struct(F.concat_ws(":", "root", F.least(F.col("block"), j), F.greatest(F.col("block"), j)).alias("part"), (F.col("block") > j).cast("int").alias("side")))
    return members.withColumn("block", block).withColumn("m", F.explode(meets)).select("m.part", "m.side", "node", F.col("node").alias("grp"), "text")


def _later_meetings(members: DataFrame, percent: int) -> DataFrame:
    """members (node, root, size, grp) with part and side: the blocks of one group, or of several small ones, against those of other groups in reach. Pairs are made of blocks, not of members."""
    n = members.groupBy("root", "grp").agg(F.count("*").alias("n"))
    small = F.col("n") < FAMILY_ROWS
    pool = n.groupBy("root").agg(F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("pool"))
    n = n.join(pool, "root").select("root", "grp", F.when(small, F.concat(F.lit("p"), F.pmod(F.xxhash64("grp"), F.ceil(F.col("pool") / FAMILY_ROWS)).cast("string"))).alias("shared"), F.ceil(F.col("n") / FAMILY_ROWS).alias("own"))
    own = F.concat_ws(".", F.lit("g"), "grp", F.pmod(F.xxhash64("node"), F.col("own")))
    placed = members.join(n, ["root", "grp"]).withColumn("block", F.coalesce("shared", own))
    blocks = placed.groupBy("root", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.when(F.col("shared").isNull(), F.col("grp"))).alias("only"))
    a, b = (blocks.select("root", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high", "only"))) for x in "ab")
    apart = ~F.coalesce(F.col("only_a") == F.col("only_b"), F.lit(False))
    reach = (F.col("low_a") * percent <= F.col("high_b") * 100) & (F.col("low_b") * percent <= F.col("high_a") * 100)
    pairs = a.join(b.hint("merge"), "root").filter((F.col("block_a") <= F.col("block_b")) & apart & reach).withColumn("part", F.concat_ws(":", "root", "block_a", "block_b"))
    sides = pairs.select("root", "part", F.col("block_a").alias("block"), F.lit(0).alias("side")).unionByName(pairs.filter("block_a <> block_b").select("root", "part", F.col("block_b").alias("block"), F.lit(1).alias("side")))
    return placed.select("root", "block", "node", "grp").join(sides.hint("merge"), ["root", "block"]).select("node", "part", "side", "grp")


def linked_nodes(texts: DataFrame, lead: DataFrame, families: DataFrame, gram: int, percent: int) -> DataFrame:
    """node, root: the components of the exact links inside families (node, root). lead: of each node its size, and the doc_id and key of the row of texts that brings its text."""

    def exact(met: DataFrame) -> DataFrame:
        return met.repartition("part").sortWithinPartitions("part", "side", "node").mapInArrow(_families(gram, percent), _EDGE)

    # Stored, so that the join's both sides are exchanged as they are and a hot root can be split.
    blocks = stored(families.groupBy("root").agg(F.ceil(F.count("*") / FAMILY_ROWS).cast("int").alias("blocks")).filter("blocks > 1"))
    members = families.join(blocks, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(lead, "node")
    # The texts of members are found once, of repeated rows one; members grow with the input, so they are never broadcast.
    of_row = {"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()}
    row = [*of_row, "key"]
    found = texts.withColumns(of_row).select(*row, "text").join(members.withColumns(of_row).drop("doc_id").hint("merge"), row).dropDuplicates(row)
    members = stored(found.select("node", "root", "blocks", "size", F.encode("text", "UTF-8").alias("text")))
    first = stored(components(exact(_first_meetings(members))))
    large = members.filter("blocks > 1").select("node", "root", "size").join(first.select("node", F.col("root").alias("grp")), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    parted = large.groupBy("root").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).filter("a <> b").select("root")
    large = stored(large.join(parted, "root", "left_semi"))
    if large.isEmpty():
        return first
    # Links between groups join the groups' roots.
    of = lambda c: large.select(F.col("node").alias(c), F.col("grp").alias(f"{c}_grp"))
    met = _later_meetings(large, percent).join(members.filter("blocks > 1").select("node", "text"), "node")
    between = exact(met).join(of("a"), "a").join(of("b"), "b").select(F.col("a_grp").alias("a"), F.col("b_grp").alias("b"))
    joined = stored(components(between))
    known = first.unionByName(large.filter("node = grp").select("node", F.col("grp").alias("root"))).distinct()
    renamed = joined.select(F.col("node").alias("root"), F.col("root").alias("over"))
    return known.join(renamed, "root", "left").select("node", F.coalesce("over", "root").alias("root"))


def join(documents: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of documents (doc_id, text)."""
    return keyed_join(documents, gram, percent).select("doc_id", "n_shingles", "component_id")


def keyed_join(documents: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of `join` with key, the xxhash64 of the text, and lead_key, the smallest key of the component's rows without an id (null for empty sets)."""
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    survey = stored(texts.mapInArrow(_surveyor(gram, percent), _SURVEY))
    info = survey.filter("node IS NOT NULL").select("doc_id", "key", "node", "n_shingles")
    heavy = heavy_grams(survey.filter("gram IS NOT NULL").select("gram", "n"))
    posts = texts.select("text").mapInArrow(_poster(heavy, gram, percent), _POST)
    nodes = survey.filter("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    families = stored(components(candidates(posts, nodes, percent)))
    # Of each node one document brings the text.
    lead = info.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", F.col("n_shingles").alias("size"))).alias("of")).select("node", "of.doc_id", "of.key", "of.size")
    roots = linked_nodes(texts, lead, families, gram, percent)
    named = info.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named)
    least = named.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNull(), F.col("key"))).alias("lead_key"), F.count("*").alias("n")).filter("n > 1")
    # Rows that are alone in their component need no join; the rest is stored, so that a hot root can be split.
    named = named.join(stored(least.withColumn("shared", F.lit(True))), "root", "left")
    alone = F.col("shared").isNull()
    own_key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNull(), F.col("key"))
    return named.select("doc_id", "key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.when(alone, own_key).otherwise(F.col("lead_key")).alias("lead_key"))


#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1:p + {GRAM}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - {GRAM - 1}))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= {PERCENT} * (nx.n + ny.n - o)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, x AS y FROM sym UNION SELECT r.x, b.y FROM reach r JOIN sym b ON b.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
