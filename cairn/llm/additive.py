"""Additive quantisation in numpy: full-dimensional codebooks, beam-search encoding, lookup-table scores.

A unit vector x is written as coarse[c0] + scale * sum_m books[m][c_m]: the coarse word takes the place of the
vector's cluster, and the rest is brought to unit length before it is quantised, so that a dense cluster is resolved as
finely as a sparse one. Stored for a vector: its codes, its scale, and the norm of its reconstruction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    coarse: np.ndarray  # (k0, d)
    books: np.ndarray  # (m, k, d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, first divided by their largest component so that squares neither vanish nor overflow."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1)[None, :] - 2 * (x @ words.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, words)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, at, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def fit(x: np.ndarray, n_books: int, n_words: int, n_coarse: int, rounds: int = 6, seed: int = 7) -> Model:
    """x: unit vectors. Each book is fitted to what the earlier ones leave."""
    rng = np.random.default_rng(seed)
    coarse = _kmeans(x, n_coarse, rounds, rng)
    rest = x - coarse[_nearest(x, coarse)]
    norms = np.linalg.norm(rest, axis=1, keepdims=True)
    rest = rest / np.maximum(norms, 1e-12)
    rest = rest[norms[:, 0] > 1e-6]
    if not len(rest):
        rest = np.zeros((1, x.shape[1]), np.float32)
    books = []
    for _ in range(n_books):
        words = _kmeans(rest, n_words, rounds, rng)
        if len(words) < n_words:
            words = np.concatenate([words, np.zeros((n_words - len(words), x.shape[1]), np.float32)])
        rest = rest - words[_nearest(rest, words)]
        books.append(words)
    return Model(coarse.astype(np.float32), np.stack(books).astype(np.float32))


def encode(model: Model, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(coarse codes, codes (n, m), scales, norms of the reconstructions) of unit vectors; the beam keeps the best partial sums."""
    m, k, d = model.books.shape
    n = len(x)
    first = _nearest(x, model.coarse)
    rest = x - model.coarse[first]
    scale = np.linalg.norm(rest, axis=1)
    rest = rest / np.maximum(scale, 1e-12)[:, None]
    flat = model.books.reshape(m * k, d)
    inner = rest @ flat.T  # (n, m*k)
    gram = flat @ flat.T
    codes = np.zeros((n, 1, 0), np.int64)
    loss = np.zeros((n, 1), np.float32)
    for i in range(m):
        words = slice(i * k, (i + 1) * k)
        step = np.diag(gram)[words][None, None, :] - 2 * inner[:, None, words]
        if i:
            step = np.repeat(step, codes.shape[1], axis=1)
            for j in range(i):
                step += 2 * gram[j * k + codes[:, :, j], words]
        total = (loss[:, :, None] + step).reshape(n, -1)
        keep = min(beam, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
        loss = np.take_along_axis(total, best, 1)
        codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
    codes = codes[np.arange(n), loss.argmin(1)]
    made = model.coarse[first] + scale[:, None] * sum(model.books[i][codes[:, i]] for i in range(m))
    return first.astype(np.int16), codes.astype(np.uint8), scale.astype(np.float32), np.linalg.norm(made, axis=1).astype(np.float32)


def lookup(model: Model, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of unit queries with the coarse words (q, k0) and with the books (q, m, k)."""
    m, k, d = model.books.shape
    return queries @ model.coarse.T, (queries @ model.books.reshape(m * k, d).T).reshape(-1, m, k)


def scores(tables: tuple[np.ndarray, np.ndarray], q: int, first: np.ndarray, codes: np.ndarray, scale: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Approximate cosines of query q with encoded vectors, from the tables alone."""
    coarse, books = tables
    total = books[q, 0][codes[:, 0]]
    for i in range(1, codes.shape[1]):
        total = total + books[q, i][codes[:, i]]
    return (coarse[q][first] + scale * total) / np.maximum(norm, 1e-12)
