"""Repeats, set join, sharding, packing, neighbours, decontamination, toxicity: against brute force and on hard rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from cairn.llm import additive, components, decontaminate, neighbours, packing, repeats, set_join, sharding, textkit, toxicity
from pyspark.sql import functions as F


def plain_repeats(rows, width, order=lambda r: r[0]):
    """Rows are documents, in their order."""
    texts = [[w for w in (r[1] or "").encode().split()] for r in sorted(rows, key=order)]
    first, out = {}, []
    for i, words in enumerate(texts):
        gone = set()
        for p in range(len(words) - width + 1):
            g = tuple(words[p : p + width])
            if first.setdefault(g, (i, p)) != (i, p):
                gone.update(range(p, p + width))
        out.append((len(words), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(words) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("heavy", [1 << 10, 2])
def test_repeats_equal_brute_force(make_docs, corpus, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "LEAST_HEAVY", heavy)
    got = [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove(make_docs(corpus, 5)).orderBy("doc_id").collect()]
    assert got == plain_repeats(corpus, 20)


def test_common_sequences_are_found(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST_HEAVY", 5)
    docs = make_docs([(i, f"a{i} b{i} one two three four c{i}") for i in range(9)])
    hashes = repeats.WordHashes()
    assert repeats.common(docs, 4).tolist() == repeats.windows(hashes.of([b"one two three four"])[0], 4).tolist() and len(repeats.common(docs.limit(0), 4)) == 0


def thue_morse(n, letters):
    """A word of 2**n letters in which every letter differs from that half its length on in a known pattern."""
    return "".join(letters[i.bit_count() % 2] for i in range(1 << n))


def test_words_of_a_known_pattern_are_told_apart(make_docs):
    a, b = thue_morse(10, "ab"), thue_morse(10, "ba")
    start = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{start} {a}"), (2, f"{start} {b}"), (3, f"{start} {a}")]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove(make_docs(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    assert {r["doc_id"]: r["component_id"] for r in set_join.join(make_docs([(1, a), (2, b), (3, a)])).collect()} == {1: 1, 2: 2, 3: 1}


def test_hashes_of_structured_words_and_runs():
    words, rng = set(), random.Random(4)
    for n in range(1, 13):
        for x, y in ("ab", "ba", "01", "\x01\x02", "aA"):
            w = thue_morse(n, (x, y))
            words |= {w, w + w, w[::-1], w + x, y + w, x * len(w), (x + y) * len(w), x * len(w) + y}
    words |= {"".join(rng.choices("ab", k=70)) for _ in range(2000)} | {f"{i:064}" for i in range(2000)} | {f"{i:065}" for i in range(2000)}
    words = sorted(words)
    flat, _ = textkit.WordHashes().of([" ".join(words).encode()])
    assert len(set(flat.tolist())) == len(words) and flat.tolist() == [textkit.WordHashes().one(w.encode()) for w in words]
    # Runs of two words in every order, and runs at any place of a text.
    two = flat[:2]
    for width in (1, 2, 3, 5, 8, 12):
        runs = {int(textkit.windows(two[[(i >> k) & 1 for k in range(width)]], width)[0]) for i in range(1 << width)}
        assert len(runs) == 1 << width
    for width in (3, 4, 5, 20):
        assert textkit.windows(flat, width).tolist()[7:50] == [int(textkit.windows(flat[i : i + width], width)[0]) for i in range(7, 50)]
    long = np.array([two[i.bit_count() % 2] for i in range(4096)])
    assert textkit.windows(long, 2048)[0] != textkit.windows(long, 2048)[2048]


def test_repeats_of_huge_texts_and_words(make_docs):
    rng = random.Random(11)
    base = [f"v{rng.randrange(10**7)}" for _ in range(30_000)]
    word = "q" * (3 << 19)  # three times what is hashed at a time
    rows = [(1, " ".join(base)), (2, " ".join(base[:15_000] + ["other"] + base[15_000:])), (3, " ".join([*base[:25], word, *base[25:50]])), (4, " ".join([word, *base[100:119], word]))]
    rows += [(5, rows[2][1])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.remove(make_docs(rows)).collect()}
    want = {i: plain_repeats(rows, 20)[i - 1][:2] for i in got}
    assert got == want


def test_repeats_hard_rows(make_docs):
    text = " ".join(f"k{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, text + " " + text)]
    got = [(r["doc_id"], r["n_removed"]) for r in repeats.remove(make_docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 30), (1, 30), (None, 0), (2, 0), (3, 60)], key=str)
    assert repeats.remove(make_docs(rows).limit(0)).collect() == []


@pytest.mark.parametrize("heavy", [1 << 10, 2])
def test_texts_that_share_an_id_are_documents_of_their_own(spark, make_docs, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "LEAST_HEAVY", heavy)
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (None, "n " * 25), (None, "m1 " + a), (None, b + " tail"), (None, None), (7, b + " " + a), (7, "x " + b)]
    keys = {r["text"]: r["h"] for r in make_docs(rows).select("text", F.xxhash64("text").alias("h")).collect()}
    order = lambda r: (r[0] is not None, r[0] or 0, keys[r[1]])
    want = dict(zip(sorted(rows, key=order), plain_repeats(rows, 20, order)))
    done = repeats.remove(make_docs(rows)).collect()
    got = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in done)
    assert got == sorted(want.values()) and len(done) == len(rows)
    assert want[1, a][1] == 30 and want[None, "n " * 25][1] == 24


def test_hot_anchor_spreads_over_keys(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST_HEAVY", 50)
    line = " ".join(f"line{i}" for i in range(18))
    docs = make_docs([(i, f"p{i} {line} q{i} r{i} s{i}") for i in range(300)])
    seeds = repeats._keyed(docs).mapInArrow(repeats._seeder(20, 4, repeats.common(docs, 4)), repeats._SEED)
    assert max(r["count"] for r in seeds.groupBy("key").count().collect()) <= 3
    assert sum(r["n_removed"] for r in repeats.remove(docs).collect()) == 0


def plain_components(rows, gram, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + gram]) for k in range(max(1, len(w) - gram + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_set_join_and_pipeline_on_rows_without_id(spark, make_docs):
    import corpus_pipeline

    base, other = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda words: " ".join([*words[:-1], "z"])
    rows = [(None, " ".join(other)), (None, near(other)), (None, " ".join(base)), (5, near(base)), (None, "lone words"), (None, None), (None, "")]
    got = {(r["doc_id"], r["key"]): r["component_id"] for r in set_join.keyed_join(make_docs(rows, 1)).collect()}
    assert sorted(map(str, got.values())) == ["5", "5", "None", "None", "None", "None", "None"]
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, make_docs(rows, 1), "").collect()]
    assert sorted(left, key=str) in [sorted([(None, x), (5, near(base)), (None, "lone words"), (None, None), (None, "")], key=str) for x in (" ".join(other), near(other))]


@pytest.mark.parametrize(("gram", "percent", "short", "block"), [(3, 90, 12, 512), (5, 80, 12, 512), (2, 60, 2, 4), (3, 90, 2, 3)])
def test_set_join_equals_brute_force(make_docs, corpus, monkeypatch, gram, percent, short, block):
    monkeypatch.setattr(set_join, "SHORT_LIST", short)
    monkeypatch.setattr(set_join, "FAMILY_ROWS", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.join(make_docs(corpus, 5), gram, percent).collect()}
    assert got == plain_components(corpus, gram, percent)


@pytest.mark.parametrize("block", [3, 8, 40])
def test_large_families_link_across_blocks(spark, make_docs, monkeypatch, block):
    """Families of many blocks: one that hangs together, one in several groups, and chains of sets that grow."""
    monkeypatch.setattr(set_join, "FAMILY_ROWS", block)
    monkeypatch.setattr(set_join, "SHORT_LIST", 2)
    rng, rows = random.Random(4), []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    base = [f"h{i}" for i in range(80)]
    for _ in range(40):
        add([f"x{rng.randrange(10**6)}" if k == 3 else w for k, w in enumerate(base)])
    for group in range(5):  # alike enough to be candidates, too far apart to link
        own = [f"g{group}-{i}" if i % 17 == group else f"s{i}" for i in range(120)]
        for _ in range(9):
            add([f"y{rng.randrange(10**6)}" if k == 60 else w for k, w in enumerate(own)])
    for n in range(30, 90):
        add([f"c{i}" for i in range(n)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.join(make_docs(rows, 4), 3, 90).collect()}
    assert got == plain_components(rows, 3, 90)
    nodes = spark.createDataFrame([(i, i % 2 * 50) for i in range(400)], "node long, root long").withColumn("size", F.lit(10))
    loose = set_join._later_meetings(nodes.withColumn("grp", F.when(F.col("node") < 380, F.col("root")).otherwise(F.col("node"))).withColumn("root", F.lit(1)), 90)
    met = {}
    for r in loose.collect():
        met.setdefault(r["part"], []).append((r["node"], r["grp"]))
    pairs = {frozenset((a, b)) for rs in met.values() for (a, g), (b, h) in combinations(rs, 2) if g != h}
    groups = {i: i % 2 * 50 if i < 380 else i for i in range(400)}
    assert pairs == {frozenset((a, b)) for a, b in combinations(range(400), 2) if groups[a] != groups[b]}


def test_set_join_of_texts_that_share_ids(make_docs):
    c, b = [f"c{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    c2, b2 = [*c[:-1], "z"], [*b[:-1], "z"]
    long = " ".join(f"l{i % 70_000}" for i in range(400_000))
    rows = [(5, " ".join(b)), (5, " ".join(c)), (6, " ".join(c2)), (8, " ".join(b2)), (9, long), (10, long + " end"), (11, " ".join(f"l{i}" for i in range(50_000)))]
    for order in (rows, rows[::-1]):
        got = sorted((r["doc_id"], r["component_id"]) for r in set_join.join(make_docs(order, 2)).collect())
        assert got == [(5, 5), (5, 5), (6, 5), (8, 5), (9, 9), (10, 9), (11, 11)]


def test_set_join_hard_rows(make_docs):
    rows = [(4, "p q r s"), (4, "p q r s"), (None, "p q r s"), (7, "P Q R S"), (8, None), (9, ""), (10, "p")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.join(make_docs(rows)).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (7, 2, 4), (8, 0, 8), (9, 0, 9), (10, 1, 10)], key=str)
    assert set_join.join(make_docs(rows).limit(0)).collect() == []


def test_list_edges_keep_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0.0, 0.02, 0.1]), rng.integers(0, 2**62, 300).astype(np.uint64), base)) for _ in range(120)]
    sets = [s[: rng.integers(200, 300)] if rng.random() < 0.3 else s for s in sets]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    edges = set_join.list_edges(np.arange(120), size, np.zeros(120, np.int64), [set_join.sketch(s, 90) for s in sets], 90, block=16)
    forest = set_join.Forest(120)
    for a, b in edges:
        forest.join(a, b)
    for a, b in combinations(range(120), 2):
        if set_join.linked(sets[a], sets[b], 90):
            assert forest.root(a) == forest.root(b)


def test_answers_are_derived_from_similar_ones():
    rng = np.random.default_rng(7)
    pick = lambda n: rng.integers(0, 2**62, n).astype(np.uint64)
    bases = [pick(400) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(400) < rng.choice([0.0, 0.03, 0.3]), pick(400), bases[rng.integers(0, 4)])) for _ in range(150)] + [np.unique(pick(30)) for _ in range(5)]
    derived, plain = set_join.Family(sets), set_join.Family(sets)
    for i, x in enumerate(sets):
        want = [len(np.intersect1d(x, y)) for y in sets]
        assert derived.overlaps(x, i).tolist() == want and plain.counted(x).tolist() == want
    assert derived.n_read < 0.5 * plain.n_read
    other = set_join.Family(sets)  # asked about sets that are not in it
    for x in [np.unique(np.where(rng.random(400) < 0.02, pick(400), bases[0])) for _ in range(10)] + [np.empty(0, np.uint64), sets[0]]:
        assert other.overlaps(x, None).tolist() == [len(np.intersect1d(x, y)) for y in sets]
    edges = set_join.family_edges(list(range(155)), sets, None, None, 90)
    forest, exact = set_join.Forest(155), set_join.Forest(155)
    for a, b in edges:
        forest.join(a, b)
    for a, b in combinations(range(155), 2):
        if set_join.linked(sets[a], sets[b], 90):
            exact.join(a, b)
    assert all((forest.root(a) == forest.root(b)) == (exact.root(a) == exact.root(b)) for a, b in combinations(range(155), 2))


def test_blocks_of_a_list_are_passed_over_by_position(monkeypatch):
    n, tried = 400, []
    size, place = np.full(n, 100), np.sort(np.arange(n) % 40)  # from place 20 on, fewer than the needed 95 grams are left
    seen = set_join.in_reach
    monkeypatch.setattr(set_join, "in_reach", lambda *a: tried.append(len(a[2])) or seen(*a))
    sketches = [bytes(16)] * n
    edges = set_join.list_edges(np.arange(n), size, place, sketches, 90, block=16)
    assert sum(tried) < n * n / 4
    near = np.flatnonzero(size - place >= set_join.overlap(100, 100, 90))
    assert {x for e in edges for x in e} == set(near.tolist())


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(5, 5)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


def shard_sizes(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return out


def test_shards_balance_and_slots(make_docs, corpus):
    extra = [(1000 + i, "hot copy " * 20) for i in range(400)] + [(2000, None), (2001, "é" * 10)]
    docs = make_docs(corpus + extra)
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == len(corpus) + len(extra)
    by = shard_sizes(rows)
    totals = {k: sum(r["size"] for r in v) for k, v in by.items()}
    mean = sum(totals.values()) / 8
    biggest = max(r["size"] for r in rows)
    assert all(abs(totals.get(k, 0) - mean) <= max(biggest, 0.02 * mean) for k in range(8))
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    texts = dict(corpus + extra)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 16
        assert r["text_crc32"] == zlib.crc32(t)


@pytest.mark.parametrize(("n_shards", "tolerance", "weight"), [(8, 0.002, True), (5, 0.2, True), (7, 0.0, False)])
def test_splitters_equal_sorting(spark, make_docs, corpus, n_shards, tolerance, weight):
    extra = [(1000 + i, "hot copy " * 20) for i in range(300)] + [(1000, "hot copy " * 20)] * 40 + [(None, "x"), (None, None)]
    keys = textkit.stored(sharding.keyed(make_docs(corpus + extra)))
    if not weight:
        keys = keys.withColumn("_size", F.lit(1).cast("long"))
    rows = sorted((tuple(r[c] for c in sharding.PARTS), r["_size"]) for r in keys.collect())
    bounds = sharding.splitters(keys, n_shards, tolerance)
    total = sum(r[1] for r in rows)
    assert len(bounds) == n_shards - 1 and bounds == sorted(bounds)
    at = {}  # bytes below each place where rows can be parted
    below = 0
    for key, size in rows:
        at.setdefault(key, below)
        below += size
    cuts = sorted({*at.values(), total})
    for i, bound in enumerate(bounds, 1):
        want, got = total * i / n_shards, sum(size for key, size in rows if key < bound)
        assert abs(got - want) <= max(tolerance * total / n_shards, min(abs(c - want) for c in cuts))
    placed = sharding.exchange(keys, n_shards, tolerance).collect()
    assert all(r["shard"] == sum(b <= tuple(r[c] for c in sharding.PARTS) for b in bounds) for r in placed) and len(placed) == len(rows)


@pytest.mark.parametrize("piece_rows", [1, 7, 1 << 17])
def test_slots_of_pieces_have_no_gaps(make_docs, corpus, piece_rows):
    docs = make_docs(corpus + [(1000 + i, "hot copy " * 20) for i in range(500)])
    got = sharding.exchange(sharding.keyed(docs), 3, piece_rows=piece_rows).select("shard", "slot", "_high", "_low").collect()
    for rows in shard_sizes(got).values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        if piece_rows > 7:
            assert [(r["_high"], r["_low"]) for r in sorted(rows, key=lambda r: r["slot"])] == sorted((r["_high"], r["_low"]) for r in rows)


def test_small_groups_of_copies_stay_together(make_docs):
    rows = [(i, f"text number {i // 3} " * 3) for i in range(3000)]
    got = sharding.shard_documents(make_docs(rows), 10, 0.01).collect()
    where = {}
    for r in got:
        where.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 9


def test_splitters_lie_near_their_share(spark):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    sizes = [r["count"] for r in sharding.shard_documents(docs).groupBy("shard").count().orderBy("shard").collect()]
    assert len(sizes) == 40 and max(abs(sum(sizes[:i]) - 1000 * i) for i in range(40)) <= 2


def test_shards_of_nothing_and_of_repeats(make_docs):
    assert sharding.shard_documents(make_docs([(1, "a")]).limit(0)).collect() == []
    got = sharding.shard_documents(make_docs([(1, "a"), (1, "a"), (None, "b")]), 4).collect()
    assert len(got) == 3


@pytest.mark.parametrize("key", [None, 5])
def test_equal_rows_are_split_like_others(make_docs, monkeypatch, key):
    sizes = lambda rows, n: [sum(r["size"] for r in rows if r["shard"] == s) for s in range(n)]
    rows = sharding.shard_documents(make_docs([(key, "the same row")] * 4000)).collect()
    assert sizes(rows, 40) == [100 * 28] * 40
    monkeypatch.setattr(sharding, "PIECE_ROWS", 16)  # equal rows in several pieces
    mixed = [(key, "the same row")] * 2000 + [(i, f"row number {i:04}") for i in range(2000)]
    rows = sharding.shard_documents(make_docs(mixed)).collect()
    assert max(sizes(rows, 40)) - min(sizes(rows, 40)) <= 2 * 31 and len(rows) == 4000
    for some in shard_sizes(rows).values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)

        def padding(ends):
            return sum(n * (next(e for e in ends if e >= v) - v) for v, n in zip(lengths, counts))

        best = min(padding(sorted({*c, lengths[-1]})) for m in range(k) for c in combinations(lengths, m))
        got = packing.boundaries(lengths, counts, k)
        assert padding(got) == best and len(got) <= k


def test_packing_equals_sql(make_docs, corpus):
    got = packing.pack_documents(make_docs(corpus)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(corpus, columns=["doc_id", "text"]))
    want = con.sql(packing.ORACLE).df()
    key = sorted(got.columns)
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(want[key].itertuples(index=False, name=None))


def test_batches_keep_the_budget(make_docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 3, 9, 40, 41, 700])) for i in range(3000)] + [(1, "w " * 3), (None, None)]
    got = packing.pack_documents(make_docs(rows), 4, 500).toPandas()
    assert len(got) == len(rows)
    batches = got.groupby(["bucket", "part", "batch"])
    assert ((batches.size() * batches["padded_tokens"].first() <= 500) | (batches.size() == 1)).all()
    assert (got["n_tokens"] <= got["padded_tokens"]).all() and got["bucket"].nunique() <= 4
    assert packing.pack_documents(make_docs(rows).limit(0)).collect() == []


@pytest.mark.parametrize("key", [None, 77])
def test_rows_of_a_hot_id_fill_as_many_parts_as_others(spark, monkeypatch, key):
    monkeypatch.setattr(packing, "PART_ROWS", 64)
    monkeypatch.setattr(packing, "HOT_IDS", 16)
    hot = spark.range(4000).select(F.lit(key).cast("long").alias("doc_id"), F.lit(2000).cast("long").alias("n_tokens"))
    other = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(2000).cast("long").alias("n_tokens"))
    for rows in (hot, other, hot.unionByName(other)):
        got = packing.pack(rows, 2).toPandas()
        sizes = got.groupby("part").size()
        assert len(sizes) >= 4 and sizes.max() <= 1.7 * len(got) / len(sizes) and len(got) == rows.count()
        batches = got.groupby(["bucket", "part", "batch"])
        assert (batches["padded_tokens"].sum() <= packing.TOKEN_BUDGET).all() and all(sorted(x) == list(range(len(x))) for x in batches["slot"].apply(list))


def test_long_lengths_are_packed_exactly(make_docs):
    rows = [(i, "w " * n) for i, n in enumerate([0, 5, 9, 65536, 65537, 65600, 70001, 99990, 99999, 100000, 100000, 131073, 200001] + list(range(90000, 90012)))]
    got = packing.pack_documents(make_docs(rows)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(packing.ORACLE).df()
    key = sorted(got.columns)
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(want[key].itertuples(index=False, name=None))
    assert set(got["padded_tokens"]) <= set(got["n_tokens"])


def plain_neighbours(ids, vectors, k, step):
    x = np.array(vectors, np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in enumerate(ids):
        if q % step == 0:
            order = sorted((-float(x[i] @ x[j]), ids[j]) for j in range(len(ids)) if j != i)
            out[q] = [v for _, v in order[:k]]
    return out


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(scale=rng.choice([0.05, 1.0], (3000, 1)), size=(3000, 32))).astype(np.float32)
    x[2000:2400] = x[2000]
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(3000)]
    bad = [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] + [1.0] * 31), (5150, [None] + [1.0] * 31), (5200, []), (5250, [float("inf")] * 32), (5300, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, *bad]], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    want = plain_neighbours(list(range(3000)), x, 5, 50)
    assert set(got) == set(want)
    assert np.mean([len({r["vec_id"] for r in got[q]} & set(want[q])) / 5 for q in want]) >= 0.97
    assert [r["vec_id"] for r in got[2000]] == [2001, 2002, 2003, 2004, 2005] and [r["vec_id"] for r in got[2350]] == [2000, 2001, 2002, 2003, 2004]
    for q, rs in list(got.items())[:20]:
        for r in rs:
            a, b = x[q].astype(float), x[r["vec_id"]].astype(float)
            assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_neighbours_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 150)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(2500)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = plain_neighbours(list(range(2500)), x, 5, 50)
    assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.97
    assert neighbours.block_share(200, 1) == 200 and neighbours.block_share(200, 20) == 27 and neighbours.block_share(1000, 10**6) == 5


def test_scores_of_very_small_and_large_components(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [1.0, 2.0]), (3, [-1e-310, 3e-310]), (4, [1e308, -1e308]), (5, [5e-324, 0.0]), (6, [1e-162, 1e-5]), (50, [1e200, 1e-200]), (100, [3e307, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.array(v) / np.max(np.abs(v)) for i, v in rows}
    exact = {(q, i): x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i]) for q in (0, 50, 100) for i in x if i != q}
    got = {}
    for r in neighbours.search(df).collect():
        assert r["score"] == pytest.approx(exact[r["query_id"], r["vec_id"]], abs=1e-12)
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
    for q, found in got.items():
        assert [s for _, s in sorted(found)] == pytest.approx(sorted((s for (a, _), s in exact.items() if a == q), reverse=True)[:5], abs=1e-12)
    assert set(got) == {0, 50, 100}


def test_lengths_and_shared_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0]), (100, [3.0]), (150, [0.0, 2.0]), (150, [5.0, 0.0]), (1, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, vector string, rank int")
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    # 150 asks with its smallest vector (0, 2); 1 counts with its nearer vector; lengths do not mix, so 100 finds nothing.
    assert got == {0: [150, 1, 2], 50: [51], 150: [2, 1, 0]}


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df).collect()] == [(0, 1, 1)]
    assert neighbours.search(df.limit(0)).collect() == []
    assert neighbours.search(df.filter("vec_id = 1")).collect() == []


def test_encoding_beats_coarse_alone():
    rng = np.random.default_rng(2)
    x = additive.unit(rng.normal(size=(600, 16)))
    model = additive.fit(x, 4, 32, 8)
    first, codes, scale, norm = additive.encode(model, x, 4)
    made = model.coarse[first] + scale[:, None] * sum(model.books[i][codes[:, i]] for i in range(4))
    assert ((x - made) ** 2).sum() < 0.5 * ((x - model.coarse[first]) ** 2).sum()
    assert np.allclose(np.linalg.norm(made, axis=1), norm, atol=1e-5)
    greedy = additive.encode(model, x, 1)
    worse = model.coarse[greedy[0]] + greedy[2][:, None] * sum(model.books[i][greedy[1][:, i]] for i in range(4))
    assert ((x - made) ** 2).sum() <= ((x - worse) ** 2).sum() + 1e-6
    tables = additive.lookup(model, x[:3])
    assert np.allclose(additive.scores(tables, 1, first, codes, scale, norm), (made @ x[1]) / norm, atol=1e-4)


def item(i, n=40):
    rng = random.Random(i)
    return " ".join(f"b{rng.randrange(3000)}" for _ in range(n))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_decontamination(texts, items, theta):
    """(text, item row) -> (score, overlap, question overlap, answer overlap, first word) from BM25 sums over every passage and item."""
    cut = []
    for text in (x or "" for _, x in items):
        text = re.sub(r"(?i)^\s*(question|q)\s*:", "", text)
        mark = re.search(r"(?im)^\s*(answer|a)\s*:", text)
        q, a = (plain_words(text[: mark.start()]), plain_words(text[mark.end() :])) if mark else ([], [])
        if not (q and a):
            w = plain_words(text)
            q, a = w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]
        cut.append((q, a))
    real = [q + a for q, a in cut if q + a]
    df = Counter(w for words in real for w in set(words))
    mean, cell = sum(map(len, real)) / len(real), max(32, max(map(len, real)))
    grams = lambda words, n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    share = lambda want, have: len(want & have) / len(want) if want else 1.0
    out = {}
    for t, text in enumerate(texts):
        words = plain_words(text)
        for first in range(0, max(1, len(words)), cell):
            passage = words[first : first + 2 * cell]
            held = set(passage)
            for i, (q, a) in enumerate(cut):
                if not q + a:
                    continue
                tf, own = Counter(q + a), q + a
                weight = {w: math.log(1 + (len(real) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, n in tf.items()}
                score = sum(x for w, x in weight.items() if w in held) / sum(weight.values())
                n, m, k = (min(5, len(x)) for x in (own, q, a))
                parts = share(grams(own, n), grams(passage, n)), share(grams(q, m), grams(passage, m)), share(grams(a, k), grams(passage, k))
                if score >= theta and parts[0] >= 0.8 and min(parts[1:]) >= 0.5 and score > out.get((t, i), (0,))[0] + 1e-12:
                    out[t, i] = (score, *parts, first)
    return out


@pytest.mark.parametrize(("theta", "visits"), [(0.5, 1 << 20), (0.3, 50), (0.95, 1)])
def test_decontamination_equals_bm25_over_all_pairs(monkeypatch, theta, visits):
    monkeypatch.setattr(decontaminate, "VISITS", visits)
    common = " the of and to in a is that for on "
    items = [(i, item(i) + common * (i % 3)) for i in range(60)] + [(60, "Question: what now\nAnswer: forty two"), (61, ""), (62, None), (60, "x y z"), (63, "The of and, to in a IS that for on")]
    index = decontaminate.Index(items, theta)
    rng = random.Random(9)
    texts = []
    for k in range(120):
        words = [f"b{rng.randrange(3000)}" for _ in range(rng.randrange(0, 300))]
        if k % 3 == 0:
            leak = items[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(0, 5)):
                leak[rng.randrange(len(leak))] = "zzz"
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
        texts.append(" ".join(words) + common * (k % 4))
    texts += ["", "what now forty two", "WHAT, now! Forty two.", items[3][1] + " pad" * 500 + " " + items[4][1]]
    got = {(t, i): rest for t, i, *rest in index.search([t.encode() for t in texts])}
    rows = [i for i, (_, x) in enumerate(items) if x]  # an index numbers the items that have words
    want = plain_decontamination(texts, items, theta)
    assert {(t, rows[i]) for t, i in got} == set(want) and len(want) > 30
    assert all(got[t, i] == pytest.approx(want[t, rows[i]]) for t, i in got)


def test_decontamination_of_long_and_common_texts_stays_small():
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 20001) ** 1.05
    words = lambda n: " ".join(f"w{i}" for i in rng.choice(20000, n, p=share / share.sum()))
    items = [(i, words(int(rng.integers(20, 60)))) for i in range(2048)]
    index = decontaminate.Index(items)
    found = index.search([(words(200_000) + " " + items[7][1]).encode()])
    assert 7 in {i for _, i, *_ in found}


def test_decontamination_rows(spark, make_docs):
    docs = make_docs([(1, "pre " * 500 + item(1) + " post"), (1, "pre " * 500 + item(1) + " post"), (2, None), (3, ""), (4, "clean text"), (None, item(2))])
    bench = spark.createDataFrame([(i, item(i), "q") for i in range(5)], "item_id long, text string, doc_id string")
    assert sorted([(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()], key=str) == sorted([(1, 1), (1, 1), (None, 2)], key=str)
    left = decontaminate.clean(docs, bench)
    assert left.schema == docs.schema and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]
    assert decontaminate.find(docs, bench.limit(0)).collect() == [] and decontaminate.find(docs.limit(0), bench).collect() == []


def test_item_groups_cover_all_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "GROUP_ITEMS", 2)
    bench = spark.createDataFrame([(i, item(i)) for i in range(5)], "item_id long, text string")
    docs = make_docs([(i, item(i)) for i in range(6)])
    assert sorted(r["item_id"] for r in decontaminate.find(docs, bench).collect()) == [0, 1, 2, 3, 4]
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [5]


def test_item_groups_change_no_result(spark, make_docs, monkeypatch):
    items = [(i, "common words of every item " + item(i)) for i in range(6)] + [(6, "common words of every item"), (7, item(7) + " " + " ".join(f"tail{i}" for i in range(90)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(i, f"x {text} y") for i, text in items] + [(10 + i, " ".join(text.split()[2:])) for i, text in items])

    def found():
        return {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.find(docs, bench, 0.3).collect()}

    whole, clean = found(), sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "GROUP_ITEMS", 3)
    parted = found()
    assert parted.keys() == whole.keys() and all(parted[k] == pytest.approx(whole[k]) for k in whole)
    assert clean == sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect())


def toxic_rows(n, seed):
    rng = random.Random(seed)
    bad = {"en": ["vile", "scummy"], "fr": ["affreux", "nul"]}
    out = []
    for i in range(n):
        lang, toxic = rng.choice(["en", "fr"]), int(rng.random() < 0.3)
        words = [f"{lang}{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad[lang])
        out.append((i, " ".join(words), lang, toxic))
    return out


def test_toxicity_on_held_out_rows(spark, make_docs):
    rows = toxic_rows(1500, 1)
    docs = make_docs([r[:3] for r in rows] + [(9000, None), (9001, ""), (9002, "vile " * 60000), (9002, "vile " * 60000)])
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(9000, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]]["held_out"] for r in held) and sum(x["held_out"] for x in got.values()) >= len(held)
    right = sum(got[r[0]]["predicted"] == r[3] for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got.values())
    assert got[9002]["predicted"] == 1 and got[9001]["score"] == got[9000]["score"]


def plain_logit(model, text):
    """Words, filters and pooling by loops."""
    words = [model.rows[xxhash.xxh3_64_intdigest(w.encode()) % toxicity.BUCKETS] for w in plain_words(text)]
    total = model.offset
    for w, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            responses = []
            for at in range(max(1, len(words))):
                rows = [words[at + k] if at + k < len(words) else 0 for k in range(width)]
                responses.append(sum(float(model.table[r] @ model.filters[w][k][:, f]) for k, r in enumerate(rows)))
            total += max(0.0, max(responses) + float(model.biases[w][f])) * float(model.output[w * toxicity.FILTERS + f])
    return total


@pytest.mark.parametrize("run", [1 << 16, 7, 1])
def test_scores_equal_loops_over_words_and_filters(monkeypatch, run):
    rows = toxic_rows(400, 3)
    model = toxicity.fit([r[1] for r in rows], np.array([r[3] for r in rows]), 0.3)
    texts = ["", "vile", "en1 vile, EN2", rows[0][1], rows[1][1] + " scummy end", " ".join(r[1] for r in rows[:3])]
    monkeypatch.setattr(toxicity, "RUN_TOKENS", run)
    buckets = toxicity.Buckets()
    got = toxicity.logits(model, [model.rows[buckets.of(t)] for t in texts])
    assert got == pytest.approx([plain_logit(model, t) for t in texts], abs=1e-3)


def test_memory_for_a_long_text_is_bounded():
    rows = toxic_rows(400, 3)
    model = toxicity.fit([r[1] for r in rows], np.array([r[3] for r in rows]), 0.3)
    text = ("en1 fr2 de3 " * 1_700_000 + "vile").encode()
    tracemalloc.start()
    tokens = model.rows[toxicity.Buckets().of(text)]
    got = toxicity.logits(model, [tokens])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(tokens) == 5_100_001 and peak < 200 << 20
    assert got[0] == pytest.approx(plain_logit(model, "en1 fr2 de3 en1 fr2 de3 en1 fr2 de3 vile"), abs=1e-3)


def test_sample_is_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, i % 2, "x" * n, n) for i, n in enumerate([10, 20, 3000, 40, 50, 60])], "doc_id long, toxic int, text string, size int")
    assert [r["doc_id"] for r in toxicity.sampled(rows, 10**6, 100)] == [0, 1, 3, 4, 5]
    some = toxicity.sampled(rows, 100, 100)
    assert some and sum(r["size"] for r in some) <= 100
    assert toxicity.sampled(rows.limit(0)) == []


def test_of_several_texts_of_an_id_one_is_learned_from(spark, make_docs):
    rows = toxic_rows(300, 2)
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    twice = [r[:3] for r in rows] + [(r[0], "other " + r[1], r[2]) for r in rows[:150]] + [(None, "vile", "en")]
    a, b = (sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in toxicity.classify(make_docs(some, parts), labels).collect()) for some, parts in ((twice, 2), (twice[::-1], 3)))
    assert [i for i, _ in a] == [i for i, _ in b] and [x for _, x in a] == pytest.approx([x for _, x in b], abs=1e-5)


def test_toxicity_without_use_of_lang_or_held_out_labels(spark, make_docs):
    rows = toxic_rows(300, 2)
    flip = [(r[0], 1, 1 - r[3] if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[3]) for r in rows]
    plain = [(r[0], 1, r[3]) for r in rows]
    schema = "doc_id long, quality int, toxic int"
    a = {r["doc_id"]: r["score"] for r in toxicity.classify(make_docs([r[:3] for r in rows]), spark.createDataFrame(plain, schema)).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.classify(make_docs([(r[0], r[1], "de") for r in rows]), spark.createDataFrame(flip, schema)).collect()}
    assert a == pytest.approx(b)


def test_toxicity_without_labels(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    schema = "doc_id long, quality int, toxic int"
    assert [r["score"] for r in toxicity.classify(docs, spark.createDataFrame([], schema)).collect()] == [0.0, 0.0]
    assert toxicity.classify(docs.limit(0), spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([(i, 1, 1) for i in range(50)], schema)
    assert {r["score"] for r in toxicity.classify(docs, one).collect()} == {1.0}


def test_every_language_gets_its_own_threshold(spark, make_docs):
    rows = [(i, text, "es" if i % 20 == 3 else lang, toxic) for i, text, lang, toxic in toxic_rows(1500, 1)]
    docs = make_docs([r[:3] for r in rows] + [(9000, "x", None), (9001, "x", "it")])
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert set(model.thresholds) == {"en", "es", "fr"}
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert all(got[r[0]]["threshold"] == model.thresholds[r[2]] for r in rows) and {got[9000]["threshold"], got[9001]["threshold"]} == {0.7}
    assert all(r["rejected"] == (r["score"] >= r["threshold"]) for r in got.values())


def test_language_cut_weighs_rows_and_shrinks():
    toxic, clean = np.zeros(91), np.zeros(91)
    toxic[31:], clean[:31] = 1, 1  # all toxic rows reach the cut 0.40, no clean row does
    few = toxicity.language_cut(toxic, clean, 60, 600)
    assert 0.4 < toxicity.language_cut(toxic * 100, clean * 100, 6000, 60000) < few < 0.7
    clean[31:51] = 0.1  # a clean row among them stands for many
    assert toxicity.language_cut(toxic, clean, 60, 60000) > few


def test_thresholds_come_from_all_rows_that_were_not_trained_on(spark, monkeypatch):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, "en").alias("lang"), F.concat(F.lit("0."), (F.col("id") % 10).cast("string")).alias("text"))
    known = rows.filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    sums = []
    monkeypatch.setattr(toxicity, "with_scores", lambda docs, model: docs.withColumn("score", F.col("text").cast("double")))
    monkeypatch.setattr(toxicity, "language_cut", lambda *x: sums.append((x[0].sum(), x[1].sum(), *x[2:])) or 0.5)
    want = [r["doc_id"] for r in rows.join(known, "doc_id").filter("lang = 'en'").select("doc_id").collect()]
    trained = want[:100]
    assert toxicity.language_thresholds(rows, known, trained, None) == {"en": 0.5}
    n = [sum(i % 2 == k for i in ids) for ids in (want[100:], want) for k in (1, 0)]
    assert min(n) > 1500 and sums == [tuple(n)]
