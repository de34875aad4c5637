"""A regularised quadratic discriminant over statistics of whole texts.

Each class gets a Gaussian; its covariance is shrunk towards the common one and that towards
a multiple of the identity.  Scores come from the difference of the two log densities, taken
with Cholesky factors that are computed once.  Shrinkage is chosen by the log loss on
folds left out, all from per-fold sums of the statistics and their products.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.quality_rules import text_stats
from candor.llm.shared import column, keep

FEATURES = (
    "words", "word_length", "symbols", "bars", "exclaim", "upper", "digits", "marks", "distinct",
    "adjacent", "repeats", "dup_lines", "top_word", "entropy", "packed", "line_length", "odd_words",
)
SHRINK = (0.1, 0.5, 0.9)
RIDGE = (0.01, 0.1)
SOFTEN = (1.0, 3.0)
THRESHOLD = 0.3


def text_features(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES; null is empty."""
    raw = (text or "").encode()
    n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, n_exclaim = text_stats(text)
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum())
    per_char, per_word = 1 / max(1, word_chars), 1 / max(1, n_words)
    share = counts[counts > 0] / max(1, len(raw))
    often = Counter(words)
    top = max(often.values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(not w[:1].isalpha() and w[:1] < b"\x80" for w in often.elements())
    return [
        math.log1p(n_words),
        math.log1p(word_chars * per_word),
        math.asinh(100 * n_symbols * per_char),
        math.asinh(100 * int(counts[124]) * per_word),
        math.asinh(100 * n_exclaim * per_word),
        math.asinh(10 * int(counts[65:91].sum()) / max(1, letters)),
        math.asinh(50 * int(counts[48:58].sum()) * per_char),
        math.asinh(10 * int(counts[[33, 44, 46, 58, 59, 63]].sum()) * per_word),
        math.log1p(len(often)) / math.log(n_words + 3),
        math.asinh(50 * same * per_word),
        math.asinh(10 * n_repeat * per_word),
        math.asinh(10 * n_dup / max(1, n_lines)),
        math.log((top + 1) * per_word),
        float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
        math.log(len(zlib.compress(raw, 1)) / (len(raw) + 8)),
        math.log1p(word_chars / max(1, n_lines)),
        math.asinh(10 * odd * per_word),
    ]


def document_features(text: Column) -> Column:
    """The features as an array column."""

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([text_features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return features(text)


@dataclass(frozen=True)
class Moments:
    """Sums over rows: their number, the features, and the products of any two."""

    n: float
    first: np.ndarray
    second: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.first + other.first, self.second + other.second)

    def mean(self) -> np.ndarray:
        return self.first / max(1.0, self.n)

    def scatter(self) -> np.ndarray:
        return self.second - np.outer(self.mean(), self.first)


def nothing() -> Moments:
    p = len(FEATURES)
    return Moments(0.0, np.zeros(p), np.zeros((p, p)))


def fold_moments(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments per (fold, label); ``rows`` has fold, label and features.

    Each task sends one row per fold and label, and as many come to the driver.
    """
    p = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, p)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for f, y in set(zip(fold.tolist(), label.tolist())):
                own = x[(fold == f) & (label == y)]
                flat = np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
                sums[f, y] = sums.get((f, y), 0) + flat
        for (f, y), flat in sums.items():
            i = np.arange(len(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), f)), pa.array(np.full(len(flat), y)), pa.array(i), pa.array(flat)],
                ["fold", "label", "i", "v"],
            )

    cells = rows.select("fold", "label", "features").mapInArrow(
        add, "fold bigint, label bigint, i bigint, v double"
    )
    total = cells.groupBy("fold", "label", "i").agg(F.sum("v").alias("v")).collect()
    flat: dict[tuple[int, int], np.ndarray] = {}
    for r in total:
        flat.setdefault((r["fold"], r["label"]), np.zeros(1 + p + p * p))[r["i"]] = r["v"]
    return {k: Moments(v[0], v[1 : p + 1], v[p + 1 :].reshape(p, p)) for k, v in flat.items()}


@dataclass(frozen=True)
class QualityModel:
    """Scale of the features, and each class's mean, inverse Cholesky factor and constant."""

    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    inverses: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]
    soften: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0, with priors."""
        z = x / self.scale
        density = [
            c - 0.5 * (((z - m) @ inverse.T) ** 2).sum(axis=1)
            for m, inverse, c in zip(self.means, self.inverses, self.constants)
        ]
        return (density[1] - density[0]) / self.soften

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; far odds are bent towards 30, so that they stay apart."""
        odds = self.log_odds(x)
        return 1 / (1 + np.exp(-odds / (1 + np.abs(odds) / 30)))

    def score(self, features: Column) -> Column:
        p = len(FEATURES)

        @F.arrow_udf("double")
        def of(rows: pa.Array) -> pa.Array:
            return pa.array(self.probability(rows.flatten().to_numpy().reshape(-1, p)))

        return of(features)


def fit_moments(bad: Moments, good: Moments, shrink: float, ridge: float, soften: float) -> QualityModel:
    """The model of two classes; a class without rows takes the other's mean and covariance."""
    p, n = len(FEATURES), bad.n + good.n
    pooled = (bad.scatter() + good.scatter()) / max(1.0, n - 2)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    common = pooled / np.outer(scale, scale)
    means, inverses, constants = [], [], []
    for own, other in ((bad, good), (good, bad)):
        mean = (own if own.n else other).mean() / scale
        within = own.scatter() / max(1.0, own.n - 1) / np.outer(scale, scale)
        weight = own.n * (1 - shrink)
        mixed = (weight * within + (n * shrink + 1) * common) / (weight + n * shrink + 1)
        shrunk = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / p, 1e-3) * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        means.append(mean)
        inverses.append(np.linalg.solve(factor, np.eye(p)))
        constants.append(math.log((own.n + 1) / (n + 2)) - float(np.log(np.diag(factor)).sum()))
    return QualityModel(scale, tuple(means), tuple(inverses), tuple(constants), soften)


def fit_quality(rows: DataFrame) -> QualityModel:
    """Fit on rows with ``fold``, ``label`` (0 or 1) and ``features``.

    Without rows, or with one class only, every text scores alike or close to it.
    """
    moments = fold_moments(rows)
    folds = sorted({f for f, _ in moments})
    total = {y: sum((m for (f, l), m in moments.items() if l == y), nothing()) for y in (0, 1)}
    grid = list(product(SHRINK, RIDGE, SOFTEN))
    if len(folds) < 2 or not (total[0].n and total[1].n):
        return fit_moments(total[0], total[1], *grid[-1])

    def rest(fold: int, y: int) -> Moments:
        return sum((m for (f, l), m in moments.items() if l == y and f != fold), nothing())

    models = {f: [fit_moments(rest(f, 0), rest(f, 1), *g) for g in grid] for f in folds}
    p = len(FEATURES)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(grid))
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, p)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                own = fold == f
                for g, model in enumerate(models[int(f)]):
                    q = np.clip(model.probability(x[own]), 1e-12, 1 - 1e-12)
                    sums[g] -= np.log(np.where(label[own] == 1, q, 1 - q)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(sums)], ["g", "loss"])

    cells = rows.select("fold", "label", "features").mapInArrow(losses, "g bigint, loss double")
    loss = {r["g"]: r["loss"] for r in cells.groupBy("g").agg(F.sum("loss").alias("loss")).collect()}
    return fit_moments(total[0], total[1], *grid[min(loss, key=lambda g: (loss[g], g))])


def score_quality(
    docs: DataFrame, labels: DataFrame, fold: Column, held_out: int, key: str = "doc_id",
    text: str = "text", label: str = "quality",
) -> DataFrame:
    """One row (key, held_out, score, predicted) per row of ``docs``.

    Labels of fold ``held_out`` are not used.  Null and empty texts are scored on
    the statistics of an empty text.  Null labels, and null keys in either table, are
    not learned from; a key labelled twice counts once, as its lowest label.  Repeated
    rows each get their row; other columns are not read.
    """
    rows = docs.select(
        column(key).alias("key"), fold.cast("bigint").alias("fold"),
        document_features(column(text)).alias("features"),
    )
    rows = keep(rows, "quality-features")
    known = labels.select(column(key).alias("key"), column(label).cast("bigint").alias("label"))
    known = known.dropna().where("label in (0, 1)").groupBy("key").agg(F.min("label").alias("label"))
    train = keep(
        rows.where(F.col("fold") != held_out).join(known, "key").select("fold", "label", "features"),
        "quality-train",
    )
    model = fit_quality(train)
    scored = rows.withColumn("score", model.score(F.col("features")))
    return scored.select(
        F.col("key").alias(key), (F.col("fold") == held_out).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
