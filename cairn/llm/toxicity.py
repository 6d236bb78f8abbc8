"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are folded (A-Z lower, other ASCII that is no letter or digit parts words) and hashed to BUCKETS rows of an embedding
table; filters of WIDTHS words with max pooling over the whole text feed a logistic output. A text is scored in full: a long
one in pieces of RUN_TOKENS places for a filter, whose maxima are joined, so what is held besides a text is four bytes a word.
The model is fitted on the driver to SAMPLE_POSITIVE + SAMPLE_NEGATIVE labelled rows at most, those with the smallest hash of
their id, and to SAMPLE_BYTES of text at most, in that order; texts over SAMPLE_TEXT_BYTES are scored like all others but not
learned from. So the driver's memory grows neither with the corpus nor with a text. Buckets that occur in too few texts of
the sample (LEAST_TEXTS to LEAST_TEXTS_MOST, by its size) stay at zero, so that the score rests on words seen often enough.

The score is the sigmoid of a logistic calibration, fitted on a held-back quarter of the sample and corrected to the
share of toxic rows among all labelled rows, then shifted so that the cut with the best F1 lies at
DEFAULT_THRESHOLD. Thresholds are calibrated by language, on all labelled rows that the model was not trained on. They are scored where
they lie, and counts by score come back. A lang's threshold is the cut with the best F1 (each row stands for its share of
all rows of its lang and label, those trained on included), drawn towards DEFAULT_THRESHOLD as if by SHRINK further rows. A lang without such rows of both
labels, and rows without a lang, keep DEFAULT_THRESHOLD. The language chooses a threshold, never a score; labels, source and
id are no inputs either.

Null and empty texts are scored as a text without words. With no labels, or labels of one class only, every score is the
share of toxic rows (0 without labels). Labels that are null or have no id are left out; of a doc_id with several labels the
highest counts, and of its several texts the one with the smallest hash is learned from. Rows without an id are scored and
never learned from. Repeated rows get equal scores; an empty table gives no rows. `classify` reads doc_id, text and lang only;
`with_scores` keeps all columns and asks for a free name for the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .licenses import fold
from .textkit import pieces, slices, stored

SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 2000, 4500
SAMPLE_BYTES, SAMPLE_TEXT_BYTES = 1 << 27, 1 << 18
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 16, (1, 2, 3), 24
EPOCHS, BATCH, RATE, LEAST_TEXTS, LEAST_TEXTS_MOST, INIT = 12, 32, 0.08, 3, 14, 0.02
DEFAULT_THRESHOLD, SHRINK = 0.7, 50
GRID = np.round(np.arange(0.1, 0.991, 0.01), 2)
SLICE, RUN_TOKENS = 1 << 20, 1 << 16


@dataclass
class Model:
    rows: np.ndarray  # bucket -> row of table; 0 is the zero row
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    output: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


class Buckets(dict):
    """word -> bucket, forgetting all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return b

    def of(self, text: str | bytes | None) -> np.ndarray:
        found = [np.empty(0, np.int32)]
        for piece in pieces(fold(text)):
            words = piece.split()
            found.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        return np.concatenate(found)


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts in one array with zeros between them, and where each text starts and ends (one place at least)."""
    gap = np.zeros(max(WIDTHS), np.int32)
    lengths = np.array([max(1, len(t)) for t in texts])
    parts: list[np.ndarray] = []
    for t in texts:
        parts += [t if len(t) else gap[:1], gap]
    starts = np.concatenate([[0], np.cumsum(lengths + len(gap))[:-1]])
    return np.concatenate(parts), starts, starts + lengths


def _responses(model: Model, vectors: np.ndarray, w: int) -> np.ndarray:
    n = len(vectors) - WIDTHS[w] + 1
    out = vectors[:n] @ model.filters[w][0]
    for k in range(1, WIDTHS[w]):
        out += vectors[k : k + n] @ model.filters[w][k]
    return out


def logits(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Outputs of token rows (already rows of the table); max pooling over each whole text.

    Every place where a filter can begin is counted in one piece, with the words after it that the filter reaches."""
    best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    run: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def close() -> None:
        if run:
            np.maximum.at(best, [i for i, *_ in run], _maxima(model, [t for _, t, _ in run], np.array([n for *_, n in run])))
            run.clear()

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), RUN_TOKENS):
            n = min(RUN_TOKENS, len(t) - at)
            if size + n > RUN_TOKENS:
                close()
                size = 0
            run.append((i, t[at : at + RUN_TOKENS + max(WIDTHS) - 1], n))
            size += n
    close()
    return np.maximum(best + np.concatenate(model.biases), 0) @ model.output + model.offset


def _maxima(model: Model, texts: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Largest response of each filter in the first `places` places of each text (one at least)."""
    tokens, starts, _ = _laid(texts)
    vectors = model.table[tokens]
    bounds = np.stack([starts, starts + np.maximum(1, places)], 1).ravel()
    return np.concatenate([np.maximum.reduceat(_responses(model, vectors, w), bounds, axis=0)[::2] for w in range(len(WIDTHS))], 1)


def score(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    z = model.slope * logits(model, texts).astype(np.float64) + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(texts: list[np.ndarray], y: np.ndarray, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    least = max(LEAST_TEXTS, min(LEAST_TEXTS_MOST, len(texts) // 400))
    seen = np.bincount(np.concatenate([np.unique(t) for t in texts] or [np.zeros(0, np.int32)]), minlength=BUCKETS)
    known = np.flatnonzero(seen >= least)
    rows = np.zeros(BUCKETS, np.int32)
    rows[known] = np.arange(1, len(known) + 1)
    table = rng.normal(0, INIT, (len(known) + 1, DIM)).astype(np.float32)
    table[0] = 0
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(rows, table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    texts = [rows[t] for t in texts]
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
    square = {name: np.full_like(x, 1e-6) for name, x in [("table", table), ("output", model.output), *((("f", w), f) for w, f in enumerate(filters)), *((("b", w), b) for w, b in enumerate(model.biases))]}
    offset_square = 1e-6

    def step(name, x: np.ndarray, grad: np.ndarray, at=...) -> None:
        square[name][at] += grad * grad
        x[at] -= RATE * grad / np.sqrt(square[name][at])

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            tokens, starts, ends = _laid([texts[j] for j in some])
            vectors = model.table[tokens]
            places, pooled = [], []
            for w in range(len(WIDTHS)):
                z = _responses(model, vectors, w)
                at = np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)])
                places.append(at)
                pooled.append(np.take_along_axis(z, at, 0) + model.biases[w])
            hidden = np.concatenate(pooled, 1)
            active = hidden > 0
            hidden = hidden * active
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.output + model.offset, -40, 40)))
            error = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            back = error[:, None] * model.output[None, :] * active
            step("output", model.output, hidden.T @ error + 1e-4 * model.output)
            offset_square += float(error.sum()) ** 2
            model.offset -= RATE * float(error.sum()) / np.sqrt(offset_square)
            touched, grads = [], []
            for w, width in enumerate(WIDTHS):
                g, at = back[:, w * FILTERS : (w + 1) * FILTERS], places[w]
                step(("b", w), model.biases[w], g.sum(0))
                grad = np.empty_like(model.filters[w])
                for k in range(width):
                    grad[k] = np.einsum("nfd,nf->df", vectors[at + k], g)
                    touched.append(tokens[at + k].ravel())
                    grads.append((g[:, :, None] * model.filters[w][k].T[None]).reshape(-1, DIM))
                step(("f", w), model.filters[w], grad + 1e-5 * model.filters[w])
            ids, where = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, where, np.concatenate(grads))
            total[ids == 0] = 0
            step("table", model.table, total, ids)
    return model


def _calibrate(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit with softened targets, moved from the sample's share of positives to `prior`."""
    up, n1, n0 = y == 1, y.sum(), (1 - y).sum()
    target = np.where(up, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(z.std()), 1e-6)
    x, a, b = (z - z.mean()) / scale, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w, e = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(h, [(e * x).sum() + 1e-3 * a, e.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    share = n1 / len(y)
    b += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return a / scale, b - a * z.mean() / scale


def _f1(s: np.ndarray, y: np.ndarray, cut: float, clean_weight: float) -> float:
    """F1 of a cut; each clean row stands for clean_weight rows, as the sample holds too few of them."""
    hits, wrong = ((s >= cut) & (y == 1)).sum(), clean_weight * ((s >= cut) & (y == 0)).sum()
    return 2 * hits / max(1.0, hits + wrong + (y == 1).sum())


def _middle(f1: np.ndarray) -> float:
    """Middle of the cuts of GRID whose F1 is within 0.002 of the best."""
    return float(np.median(GRID[f1 >= f1.max() - 0.002]))


def _threshold(s: np.ndarray, y: np.ndarray, clean_weight: float) -> float:
    return _middle(np.array([_f1(s, y, c, clean_weight) for c in GRID]))


def _aside(y: np.ndarray) -> np.ndarray:
    """Which rows of a sample are held back from training: every fourth of each label, none if a label would lose all."""
    aside = np.zeros(len(y), bool)
    for label in (0, 1):
        aside[np.flatnonzero(y == label)[::4]] = True
    if aside[y == 1].all() or aside[y == 0].all():
        aside[:] = False
    return aside


def fit(texts: list[str], toxic: np.ndarray, prior: float, seed: int = 11) -> Model:
    """Model from sampled rows; prior is the share of toxic rows among all labelled ones."""
    y = np.asarray(toxic, np.int64)
    if len(y) < 8 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.int32), np.zeros((1, DIM), np.float32), [], [], np.zeros(0, np.float32), 0.0, constant=float(prior))
    buckets = Buckets()
    tokens = [buckets.of(t) for t in texts]
    aside = _aside(y)
    keep = np.flatnonzero(~aside)
    model = _train([tokens[i] for i in keep], y[keep], seed)
    back = np.flatnonzero(aside) if aside.any() else keep
    rows = [model.rows[tokens[i]] for i in back]
    model.slope, model.shift = _calibrate(logits(model, rows).astype(np.float64), y[back], float(np.clip(prior, 1e-3, 1 - 1e-3)))
    share = float(np.clip(prior, 1e-3, 1 - 1e-3))
    weight = (1 - share) / share * (y[back] == 1).sum() / (y[back] == 0).sum()
    best = _threshold(score(model, rows), y[back], weight)
    model.shift += np.log(DEFAULT_THRESHOLD / (1 - DEFAULT_THRESHOLD)) - np.log(best / (1 - best))
    return model


def language_cut(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> float:
    """Threshold of a language from its rows that were not trained on, counted by how many cuts of GRID their scores reach; n_toxic and n_clean are all its labelled rows."""
    reached = lambda x: x.sum() - np.cumsum(x)[:-1]
    hits, wrong = n_toxic / toxic.sum() * reached(toxic), n_clean / clean.sum() * reached(clean)
    n = min(toxic.sum(), clean.sum())
    return float((n * _middle(2 * hits / np.maximum(1.0, hits + wrong + n_toxic)) + SHRINK * DEFAULT_THRESHOLD) / (n + SHRINK))


def language_thresholds(documents: DataFrame, known: DataFrame, trained: list[int], model: Model) -> dict[str, float]:
    """Threshold of each lang that has rows of both labels in known (doc_id, toxic) besides those trained on, from all of these. Texts are scored where they lie and scores
    meet labels; what comes to the driver is bounded by the number of languages."""
    seen = documents.sparkSession.createDataFrame([(i,) for i in trained], "doc_id bigint").withColumn("trained", F.lit(1))
    cuts = F.size(F.filter(F.array(*map(F.lit, GRID.tolist())), lambda c: F.col("score") >= c))
    rows = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    scored = with_scores(rows, model).select("doc_id", "lang", cuts.alias("cuts")).join(known, "doc_id").join(F.broadcast(seen), "doc_id", "left")
    counts: dict[str, np.ndarray] = {}
    n: dict[tuple[str, int], int] = {}
    for r in scored.groupBy("lang", "toxic", "cuts").agg(F.count("*").alias("n"), F.count_if(F.col("trained").isNull()).alias("n_own")).collect():
        counts.setdefault(r["lang"], np.zeros((2, len(GRID) + 1)))[r["toxic"], r["cuts"]] = r["n_own"]
        n[r["lang"], r["toxic"]] = n.get((r["lang"], r["toxic"]), 0) + r["n"]
    return {lang: language_cut(c[1], c[0], n[lang, 1], n[lang, 0]) for lang, c in sorted(counts.items()) if c.sum(axis=1).all()}


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit from labels (doc_id, toxic) joined with documents; the ids sampled are at most SAMPLE_POSITIVE + SAMPLE_NEGATIVE, so they are broadcast."""
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter("toxic = 1").orderBy(*order).limit(SAMPLE_POSITIVE).unionAll(known.filter("toxic = 0").orderBy(*order).limit(SAMPLE_NEGATIVE))
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("of")).select("doc_id", "toxic", "of.text")
    rows = sampled(stored(rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))))
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    model = fit([r["text"] for r in rows], toxic, prior)
    if model.constant is None:
        model.thresholds = language_thresholds(documents, known, [r["doc_id"] for r, back in zip(rows, _aside(toxic), strict=True) if not back], model)
    return model


def sampled(rows: DataFrame, most: int = SAMPLE_BYTES, longest: int = SAMPLE_TEXT_BYTES) -> list:
    """Rows (doc_id, toxic, text, size) in the order of doc_id: those up to `longest` bytes, by the hash of their id as long as all are within `most`."""
    sizes = rows.filter(F.col("size") <= longest).select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total = np.cumsum([r["size"] for r in sizes])
    kept = [(r["doc_id"],) for r, n in zip(sizes, total, strict=True) if n <= most]
    few = rows.sparkSession.createDataFrame(kept, "doc_id bigint")
    return sorted(rows.join(F.broadcast(few), "doc_id").collect(), key=lambda r: r["doc_id"])


def _scorer(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            for start, end, texts in slices(batch, "text", SLICE):
                s = score(model, [model.rows[buckets.of(t)] for t in texts])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])

    return run


def with_scores(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """documents with a column for the score, whose name must be free; no shuffle."""
    if name in documents.columns:
        raise ValueError(f"documents has a column {name}")
    return documents.mapInArrow(_scorer(model, name), StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def threshold(model: Model, lang: Column) -> Column:
    """Threshold of each row's language."""
    if not model.thresholds:
        return F.lit(DEFAULT_THRESHOLD)
    cuts = F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair))
    return F.coalesce(F.try_element_at(cuts, lang), F.lit(DEFAULT_THRESHOLD))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), threshold of the language and rejected (score >= threshold) of each row of documents (doc_id, text, lang)."""
    model = learn(documents, labels)
    scored = with_scores(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), model)
    cut = threshold(model, F.col("lang"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= DEFAULT_THRESHOLD).cast("int").alias("predicted"), cut.alias("threshold"), (F.col("score") >= cut).alias("rejected"))
