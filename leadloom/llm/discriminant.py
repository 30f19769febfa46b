"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Every text becomes ``FIGURES``, counts and shares of the whole text on scales (logarithms)
on which a class is roughly normal.  They are stored once, as a narrow table; labels are
joined to that table and texts are never shuffled.

A class is a normal distribution: its mean, and a covariance that is shrunk twice, towards
the covariance that both classes share (``pooled``) and towards a multiple of the unit
matrix (``round``), so that a figure which hardly varies in one class does not rule the
verdict.  Means and covariances come from sums over all training rows, made by Spark.  The
score is the class-1 posterior of the difference of the two log densities, each from the
Cholesky factor of its covariance, taken once for a model: the Mahalanobis distance is the
length of the vector that the inverse factor makes of a document, and the log determinant
is the sum over the factor's diagonal.

The two shrinkages, and a scale and a shift of the difference (a logistic curve), are chosen
on about ``CHOICE_ROWS`` training rows, taken by a hash of the id, with moments of the
others; the moments that count are then those of all training rows.

Edge cases: null, empty and blank texts have all-zero counts and are scored like others;
a long text is counted whole; without labelled rows of both classes (two of each at least)
every score is the share of label 1 (0.5 without labels); several labels of a document
count as 1 if one is; labels of rows that share an id count for each row; labels without a
document and null labels are passed over; repeated rows score alike; empty tables give no
rows; other columns are left out unless named in ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import fold
from .quality import counts
from .shared import stored, workspace
from .toxicity import fitted

FIGURES = ["size", "word_length", "symbols", "dup_lines", "repeats", "distinct", "twins", "short", "stops", "line_length", "digits"]
PREDICT_FROM = 0.3
CHOICE_ROWS = 8_000
POOLED, ROUND = (0.0, 0.1, 0.3, 0.6, 0.9), (0.01, 0.05, 0.1, 0.3)
#: Labels up to which they are joined by a broadcast; beyond it by a shuffle of the narrow table.
BROADCAST_IDS = 1_000_000
#: Shares are taken as logarithms from here on.
_FLOOR = 0.02
#: A figure that varies less than this says nothing; what is left is rounding.
_CONSTANT = 1e-9
_Moments = tuple[float, np.ndarray, np.ndarray]


def figures_of(text: str | None) -> list[float]:
    """``FIGURES`` of one text."""
    text = text or ""
    n_words, word_chars, n_symbols, dup_lines, repeats, n_lines, n_distinct, short, stops = counts(text)
    words, lines, chars = max(n_words, 1), max(n_lines, 1), max(word_chars, 1)
    parts = text.split()
    twins = sum(map(str.__eq__, parts[:-1], parts[1:]))
    digits = sum(map(text.count, "0123456789"))
    shares = [n_symbols / words, dup_lines / lines, repeats / words, (n_distinct + 1) / (words + 1), twins / words, short / words, stops / words, digits / chars]
    symbols, dup, again, distinct, twin, few, stop, digit = np.log(_FLOOR + np.array(shares)).tolist()
    return [float(np.log1p(n_words)), float(np.log1p(word_chars / words)), symbols, dup, again, distinct, twin, few, stop, float(np.log1p(n_words / lines)), digit]


def figures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Adds ``FIGURES`` of whole texts to the columns in ``keep``."""
    names = [f"__{c}" for c in FIGURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([figures_of(x.as_py()) for x in batch.column(at)], float).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(found[:, k]) for k in range(len(FIGURES)))], names=[*keep, *names])

    at = keep.index(text_col) if text_col in keep else len(keep)
    held = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*(F.col(f"`{c}`") for c in keep), *[text_col][: at == len(keep)]).mapInArrow(run, held + ", ".join(f"{c} double" for c in names))


def _moments(rows: DataFrame) -> dict[tuple[int, bool], _Moments]:
    """Count, sums and sums of products of the figures, by class and by whether a row is for the choice."""
    x = [F.col(f"__{c}") for c in FIGURES]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = rows.groupBy("quality", "choice").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for row in sums:  # four at most
        products = np.zeros((len(x), len(x)))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        out[row["quality"], row["choice"]] = (row["n"], np.array([row[f"s{i}"] for i in range(len(x))]), products)
    return out


def _added(a: _Moments | None, b: _Moments | None) -> _Moments | None:
    return a and b and tuple(x + y for x, y in zip(a, b, strict=True)) or a or b


class Discriminant:
    """Two normal classes over standardised figures, with the factors of their shrunk covariances."""

    def __init__(self, moments: dict[int, _Moments], pooled: float, round_: float):
        n, total, products = _added(moments[0], moments[1])
        self.middle = total / n
        variance = np.diag(products) / n - self.middle**2
        self.spread = np.sqrt(np.where(variance > _CONSTANT, variance, 1.0))
        means, covariances, shares = [], [], []
        for k in (0, 1):
            m, s, p = moments[k]
            mean = s / m
            means.append((mean - self.middle) / self.spread)
            covariances.append((p / m - np.outer(mean, mean)) / np.outer(self.spread, self.spread))
            shares.append(m / n)
        both = shares[0] * covariances[0] + shares[1] * covariances[1]
        self.classes = []
        for mean, own, share in zip(means, covariances, shares, strict=True):
            shrunk = (1 - pooled) * own + pooled * both
            shrunk = (1 - round_) * shrunk + round_ * max(np.trace(shrunk) / len(shrunk), 1e-6) * np.eye(len(shrunk))
            factor = np.linalg.cholesky(shrunk)
            inverse = np.linalg.solve(factor, np.eye(len(factor)))  # lower triangular, like the factor
            self.classes.append((mean, inverse, np.log(share) - np.log(np.diag(factor)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the classes' shares, for rows of figures."""
        z = (x - self.middle) / self.spread
        one, two = (const - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, const in self.classes)
        return two - one

    def column(self) -> Column:
        """``difference`` as a Spark expression over the columns of ``figures``."""
        densities = []
        for mean, inverse, const in self.classes:
            out = F.lit(float(const))
            for row in range(len(FIGURES)):
                scaled = inverse[row, : row + 1] / self.spread[: row + 1]
                shift = float((inverse[row, : row + 1] * (mean + self.middle / self.spread)[: row + 1]).sum())
                side = F.lit(-shift)
                for c, w in zip(FIGURES, scaled.tolist()):
                    side = side + F.col(f"__{c}") * w
                out = out - side * side * 0.5
            densities.append(out)
        return densities[1] - densities[0]


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean())


def train(table: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, choice_rows: int = CHOICE_ROWS) -> tuple[Discriminant, np.ndarray] | float:
    """The model, and scale and shift of its difference; without two classes, the share of label 1. ``table`` has doc_id and ``figures``."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    total = marked.count()
    if not total:
        return 0.5
    share = min(0.25, choice_rows / total)
    marked = marked.select("doc_id", "quality", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 32)) < int(share * (1 << 32))).alias("choice"))
    rows = table.join(F.broadcast(marked) if total <= BROADCAST_IDS else marked, "doc_id")
    found = _moments(rows)
    every = {k: _added(found.get((k, False)), found.get((k, True))) for k in (0, 1)}
    if not all(m and m[0] > 1 for m in every.values()):
        n = sum(m[0] for m in every.values() if m)
        return float(every[1][0] / n) if every[1] else (0.0 if n else 0.5)
    names = [f"__{c}" for c in FIGURES]
    chosen = rows.where("choice").select("doc_id", "quality", *names).toArrow().sort_by([(c, "ascending") for c in ("doc_id", *names)])  # about choice_rows
    x, y = np.column_stack([chosen.column(c).to_numpy() for c in names]), chosen.column("quality").to_numpy()
    others = {k: found.get((k, False)) for k in (0, 1)}
    if not all(m and m[0] > 1 for m in others.values()) or len(set(y.tolist())) < 2:
        return Discriminant(every, 0.3, 0.05), np.array([1.0, 0.0])
    best = None
    for pooled in POOLED:
        for round_ in ROUND:
            z = Discriminant(others, pooled, round_).difference(x)
            curve = fitted(np.clip(z, -60, 60)[:, None], y, ridge=1.0)
            loss = _loss(np.clip(z, -60, 60) * curve[0] + curve[1], y)
            if best is None or loss < best[0] - 1e-6:
                best = (loss, pooled, round_, curve)
    return Discriminant(every, best[1], best[2]), best[3]


def score(docs: DataFrame, labels: DataFrame, keep: list[str], folds: int = 5, held: int = 0, score_col: str = "score") -> DataFrame:
    """Adds ``score_col`` (0 to 1) to the columns in ``keep``. Learns from the labels outside fold ``held``."""
    spark = docs.sparkSession
    needed = keep if "doc_id" in keep else [*keep, "doc_id"]
    table = stored(figures(docs, needed), f"{workspace(spark)}/figures")
    found = train(table, labels, folds, held)
    if isinstance(found, float):
        return table.select(*(F.col(f"`{c}`") for c in keep), F.lit(found).alias(score_col))
    model, (scale, shift) = found
    z = F.greatest(F.least(model.column(), F.lit(60.0)), F.lit(-60.0)) * float(scale) + float(shift)
    return table.select(*(F.col(f"`{c}`") for c in keep), (1 / (1 + F.exp(-z))).alias(score_col))
