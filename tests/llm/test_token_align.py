"""Alignment of two tokenizers against whole texts encoded one by one, its cuts, and hard rows."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from cairn.llm import token_align


@pytest.fixture(scope="module")
def tokenizers():
    return token_align.Tokenizers()


def plain(tokenizers, rows):
    """The contract's rows from whole texts: no segments."""
    encoded, docs_of = [], defaultdict(set)
    for n, (_, text) in enumerate(rows):
        links, groups, a, b = [], [], [], []
        if text:
            a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
            b = tokenizers.b.encode(text)
            of_a, of_b = [tokenizers.a_bytes[i] for i in a], [tokenizers.b_bytes[i] for i in b]
            if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
                a, b = [], []
            else:
                ends_a, ends_b = list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))
                cuts = sorted(set(ends_a) & set(ends_b))
                group_of = lambda ends: np.searchsorted(cuts, ends).tolist()
                ga, gb = group_of(ends_a), group_of(ends_b)
                groups = [([x for x, g in zip(a, ga) if g == k], [x for x, g in zip(b, gb) if g == k]) for k in range(len(cuts))]
                links = [(x, y) for p, q in groups for x in p for y in q]
        for pair in set(links):
            docs_of[pair].add(n)
        encoded.append((a, b, groups, links))
    highest = Counter()
    for (a, _), d in docs_of.items():
        highest[a] = max(highest[a], len(d))
    out = []
    for (doc_id, _), (a, b, groups, links) in zip(rows, encoded):
        counts = [len(docs_of[x]) for x in links]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(c == highest[x[0]] for c, x in zip(counts, links)), sum(counts), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in token_align.align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "The", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", ";\r", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "　", " ", "▁", "a▁b", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "é", "é", "日本語", "😀", "٣٤", "1234567", "$%&", "\x00", "﻿", "‍", "naïve", "Straße", "x" * 40, "({[;:", "//--", "_", "A", "    return", "}", "ÀÿŁ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_equals_whole_texts(make_docs, corpus, tokenizers):
    assert found(make_docs(corpus, 4)) == plain(tokenizers, corpus)


def test_odd_texts(make_docs, tokenizers, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 6000)
    rows = list(enumerate(odd_texts(1, 700)))
    assert found(make_docs(rows, 3)) == plain(tokenizers, rows)


def test_cuts_are_stable(tokenizers):
    """Segments one by one give what the whole text gives, also where a text is cut into pieces."""
    assert " " in tokenizers.break_chars and "\n" in tokenizers.break_chars and "\r" not in tokenizers.break_chars
    cutter = token_align.Cutter(tokenizers.break_chars)
    for text in [*odd_texts(2, 4000), "word " * 300_000 + "\n" * 20 + "x" * 20 + "   end"]:
        parts = [s for piece in cutter.pieces(text) for s in piece]
        assert "".join(parts) == " " + text
        some = [x for pair in tokenizers.encode(parts) for x in (pair,)]
        assert [i for a, _ in some for i in a] == tokenizers.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:  # a space to B, so that such a text has no tokens anyway
            assert [i for _, b in some for i in b] == tokenizers.b.encode(text)


def test_segments_are_encoded_once_and_blocks_stay(make_docs, monkeypatch, tokenizers):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 500)
    rows = [(i, f"the same words again and again number {i % 7}") for i in range(200)]
    docs = make_docs(rows, 4)
    plan = token_align.align(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bucketed: true") + plan.count("Bucketed: true") >= 1
    assert found(docs) == plain(tokenizers, rows)


def test_hard_rows(make_docs, tokenizers):
    rows = [(None, "one two"), (None, "one two"), (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a▁b c"), (6, "one two"), (6, "one three"), (7, "x" * 3000), (8, " " * 500), (9, "end \n"), (10, "word " * 4000), (11, "▁"), (12, "\x00 \x00")]
    assert found(make_docs(rows)) == plain(tokenizers, rows)
    assert found(make_docs(rows).limit(0)) == [] and found(make_docs(rows[2:4])) == plain(tokenizers, rows[2:4])


def test_numbers_survive_packing():
    x = np.random.default_rng(1).integers(0, 1 << 32, 5000)
    assert (token_align.unpacked(token_align.packed(x)) == x).all() and len(token_align.unpacked(token_align.packed(np.empty(0, np.int64)))) == 0


def test_lines_are_read_some_at_a_time(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    line = lambda: ";".join(",".join(map(str, rng.integers(0, 300, rng.integers(1, 3)))) + "|" + ",".join(map(str, rng.integers(0, 300, rng.integers(1, 3)))) for _ in range(rng.integers(0, 4)))
    some = [line() for _ in range(3000)]
    lines = "\n".join([*some, ""]).encode()
    monkeypatch.setattr(token_align, "LINE_BYTES", 50)
    got = token_align.Segments(lines)
    links = [[(int(a) << 32) | int(b) for g in s.split(";") if g for a in g.split("|")[0].split(",") for b in g.split("|")[1].split(",")] for s in some]
    assert got.n == 3000 and got.counts["n_links"].tolist() == list(map(len, links)) and got.pairs[got.link].tolist() == [x for s in links for x in s]
    assert got.good.tolist() == [bool(s) for s in some] and got.counts["n_groups"].tolist() == [len(s.split(";")) if s else 0 for s in some]
    assert token_align.Segments(b"").n == 0
    monkeypatch.undo()
    many = lines * 100
    tracemalloc.start()
    token_align.Segments(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 11 * len(many), peak / len(many)
