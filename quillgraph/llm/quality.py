"""Quality classifier (operator 3): regularised quadratic discriminant.

1. *Statistics*: one Arrow scan turns each text into a few transformed statistics (``NAMES``). They are written to the
   shared folder, some 100 bytes a document, so that texts are read once for fitting and scoring.
2. *Fit*: class sizes, means and second moments of all training rows are Spark sums. What reaches the driver is
   2 * (1 + d + d * d) numbers, however many rows there are. Each class covariance is shrunk towards the pooled one and
   towards a multiple of the unit matrix; its Cholesky factor is computed and inverted once and kept in the model.
3. *Score*: the difference of the two classes' log-densities (Mahalanobis distances by the kept factors) and the log
   prior ratio give the probability of label 1.

Labels, languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.storage import materialize

NAMES = ("length", "upper", "symbol", "exclaim", "digit", "sentence", "break", "word", "repeat", "variety")
#: Bytes of usual prose that each text is thought to be preceded by, and bytes to its words.
STEADY, USUAL_WORD = 400.0, 6.0
_UPPER = bytes(range(65, 91))
_SYMBOL = b"#$%&*|<>{}[]=\\^~_@"
_EXCLAIM = b"!?"
_DIGIT = bytes(range(48, 58))
_SENTENCE = b".,;:"
_BREAK = b"\n\r"


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; all finite, for a null or empty text too."""
    raw = (text or "").encode()
    size = len(raw)
    count = lambda chars: size - len(raw.translate(None, chars))
    words = raw.split()
    n = len(words)
    repeated = sum(map(operator.eq, words, words[1:]))
    # shares are those of the text and STEADY bytes of plain prose, so a few characters of a short text say little;
    # roots spread small shares out and keep their noise about equal
    share = lambda k, usual: ((k + usual * STEADY) / (size + STEADY)) ** 0.5
    extra = STEADY / USUAL_WORD
    return [
        float(np.log(size + STEADY)),
        share(count(_UPPER), 0.025),
        share(count(_SYMBOL), 0.0),
        share(count(_EXCLAIM), 0.0),
        share(count(_DIGIT), 0.002),
        share(count(_SENTENCE), 0.025),
        share(count(_BREAK), 0.004),
        float(np.log((size + STEADY) / (n + extra))),
        (repeated / (n + extra)) ** 0.5,
        float(np.log((len(set(words)) + extra) / (n + extra) ** 0.9)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([statistics(x) for x in texts], dtype=object)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats array<double>`` in place of the text."""
    return docs.withColumn("stats", _statistics(F.col(text_col).cast("string"))).drop(text_col)


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes with their Cholesky factors (of the shrunk covariances), kept inverted (``whiten``), and log
    prior ratio."""

    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    log_prior_ratio: float

    def log_density_difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | 1) - log p(x | 0) for the rows of ``x``."""
        parts = []
        for mean, whiten in zip(self.means, self.whiten, strict=True):
            z = (x - mean) @ whiten.T
            parts.append(-0.5 * (z * z).sum(axis=1) + np.log(np.diag(whiten)).sum())
        return parts[1] - parts[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1. The spread is limited so that it never reaches 0 or 1 exactly."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_density_difference(x) + self.log_prior_ratio, -700.0, 36.0)))


def shrink(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float, to_unit: float) -> Discriminant:
    """Class moments -> model. ``to_pooled`` and ``to_unit`` are the shares given to the pooled covariance and, after
    that, to a multiple of the unit matrix."""
    counts = counts.astype(float)
    d = sums.shape[1]
    total = counts.sum()
    means = [sums[c] / counts[c] if counts[c] else (sums.sum(0) / total if total else np.zeros(d)) for c in (0, 1)]
    covs = [squares[c] / counts[c] - np.outer(means[c], means[c]) if counts[c] else np.zeros((d, d)) for c in (0, 1)]
    pooled = sum(n * cov for n, cov in zip(counts, covs, strict=True)) / max(total, 1.0)
    whiten = []
    for cov in covs:
        shrunk = (1 - to_pooled) * cov + to_pooled * pooled
        shrunk = (1 - to_unit) * shrunk + (to_unit * max(np.trace(shrunk) / d, 0.0) + 1e-9) * np.eye(d)
        whiten.append(np.linalg.inv(np.linalg.cholesky((shrunk + shrunk.T) / 2)))
    prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    return Discriminant((means[0], means[1]), (whiten[0], whiten[1]), prior)


def fit(stats: DataFrame, labels: DataFrame, training: Column, to_pooled: float = 0.05, to_unit: float = 0.002) -> Discriminant:
    """Fit on the rows of ``stats`` (doc_id, stats) that satisfy ``training`` and have a label in ``labels`` (doc_id,
    quality of 0 or 1).

    Rows without a usable label are no training rows. If a document has several labels, the smaller one holds, so
    repeated label rows count once; repeated documents count each. With no training rows at all, or none of a class,
    the model falls back to the other class's moments and the (smoothed) prior.
    """
    d = len(NAMES)
    one_each = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = stats.where(training).select("doc_id", "stats").join(one_each, "doc_id")
    moments = [F.count("*").alias("n"), *(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(d))]
    moments += [F.sum(F.col("stats")[i] * F.col("stats")[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
    counts, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in rows.groupBy("quality").agg(*moments).collect():  # two rows at most
        c = row["quality"]
        counts[c] = row["n"]
        for i in range(d):
            sums[c, i] = row[f"s{i}"]
            for j in range(i, d):
                squares[c, i, j] = squares[c, j, i] = row[f"q{i}_{j}"]
    return shrink(counts, sums, squares, to_pooled, to_unit)


def score(stats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """``stats`` with ``score`` and ``predicted`` in place of the statistics."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            x = np.array(rows.tolist(), dtype=float).reshape(len(rows), len(NAMES))
            yield pd.Series(model.probability(x))

    return stats.withColumn("score", scored("stats")).drop("stats").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the rows that no label is learnt from. A null id is never held out and has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    A null or empty text has statistics and a score like any other; repeated rows are scored each; an empty table gives
    no rows; other columns are ignored. Texts of any length are read whole.
    """
    stats = materialize(with_statistics(docs.select("doc_id", "text")), "quality_stats")
    model = fit(stats, labels, ~held_out())
    return score(stats.withColumn("held_out", held_out()), model, threshold)
