import random

import pytest

#: Schema of documents with extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, shard int, part string, _key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) rows, with clashing extra columns."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]), 9.5, 7, 3, "x", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empties, a long one and odd white space."""
    rng = random.Random(5)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    shared = " ".join(words(1, 60, 5000))
    line = " ".join(words(2, 12, 5000))
    for i in range(40):
        add(" ".join(words(100 + i, rng.randrange(1, 200), 3000)))
    base = words(7, 120, 5000)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        add(" ".join(copy))
    for i in range(12):
        add(" ".join(words(300 + i, 30, 3000)) + " " + shared + " " + " ".join(words(400 + i, 20, 3000)))
    for i in range(15):
        add(line + "\n" + " ".join(words(500 + i, 40, 3000)))
    for text in (rows[3][1], rows[3][1], rows[3][1].upper(), None, "", "   \t\n", "one", "one", "one two", "a b c", "A B C", "z " * 900, "y " * 30, "é ü ñ " * 30, " ".join(words(9, 9000, 4000)), shared, shared + " tail"):
        add(text)
    return rows
