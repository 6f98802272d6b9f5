"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has the mean and a shrunken covariance of the statistics (towards the pooled covariance, then towards its
diagonal). A score is the logistic of the difference of the classes' log densities, which come from Mahalanobis
distances under cached Cholesky factors, plus the log prior odds, scaled by a temperature.

Spark sums the moments: one pass gives each class its count, sums and products, d(d+3)/2 + 1 numbers, which is all that
reaches the driver. All labelled rows take part.

Edge cases: a null text counts as empty; an empty text has statistics and so a score. With rows of one class only, or
none, every score is the share of label 1 (0.5 without rows). Repeated rows each count and each give a row, and a
document with several labels counts once for each. Labels other than 0 and 1 and null ids take no part in the fit. A
score has no ties to break. A very long text is one row of one task. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

NAMES = (
    "log_chars", "log_words", "mean_word", "sd_word", "letters", "upper", "digits", "spaces", "symbols", "line_ends",
    "punctuation", "distinct_words", "distinct_lines", "log_mean_line", "capital_words", "marked_words", "entropy", "common_words", "bars", "long_words",
)
PUNCT = re.compile(r"[.,;:!?]")
MARKED = re.compile(r"[^\w\s.,;:!?'\"()-]{2,}|!!|[|#$%&*]")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text: shares as log odds, sizes as logarithms."""
    text = text or ""
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    size = np.fromiter(map(len, words), np.float64, len(words))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    tally = np.bincount(raw, minlength=256)
    total = max(len(raw), 1)
    letters = tally[65:91].sum() + tally[97:123].sum() + tally[128:].sum()

    def odds(k: float, of: float) -> float:
        return float(np.log((k + 0.5) / (of - k + 0.5))) if of >= k else 0.0

    freq = tally[tally > 0] / total
    distinct = set(words)
    # Of long texts the share of distinct words falls; its exponent (Heaps' law) does so far less.
    heaps = np.log(len(distinct) + 1.0) / np.log(len(words) + 2.0)
    marked = sum(1 for w in words if MARKED.search(w)) if len(words) else 0
    symbols = tally[35:39].sum() + tally[42] + tally[124] + tally[33] + tally[64] + tally[94] + tally[60:63].sum() + tally[126]
    return [
        np.log1p(n), np.log1p(len(words)), float(np.log1p(size.mean())) if len(size) else 0.0, float(np.log1p(size.std())) if len(size) else 0.0,
        odds(letters, total), odds(tally[65:91].sum(), total), odds(tally[48:58].sum(), total), odds(tally[32], total), odds(symbols, total), odds(tally[10], total),
        odds(len(PUNCT.findall(text)), max(n, 1)), float(heaps), odds(len(set(lines)), max(len(lines), 1)), float(np.log1p(n / max(len(lines), 1))),
        odds(sum(1 for w in words if w.isupper() and len(w) > 1), max(len(words), 1)), odds(marked, max(len(words), 1)), float(-(freq * np.log(freq)).sum()),
        odds(int((size <= 3).sum()), max(len(words), 1)), odds(tally[124], total), odds(int((size >= 14).sum()), max(len(words), 1)),
    ]


def features(text: Column) -> Column:
    """array<double> of the statistics of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in slices(batches):
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


@dataclass(frozen=True)
class FitOptions:
    """to_pooled and to_diagonal: shrinkage of the class covariances, 0 to 1. ridge: added to standardised variances. temperature: divides log odds."""

    to_pooled: float = 0.3
    to_diagonal: float = 0.1
    ridge: float = 0.05
    temperature: float = 2.0


@dataclass
class Model:
    """Of each class its mean, the inverse of its Cholesky factor and log determinant, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    logdet: list[float]
    log_prior: float
    temperature: float
    constant: float | None = None


def moments(labelled: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products by class, of columns (label, x array<double>)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                x = np.concatenate([np.ones((len(part), 1)), np.stack(part["x"].to_list())], axis=1)
                held[int(label)] = held.get(int(label), 0) + x.T @ x
        for label, m in held.items():
            yield pd.DataFrame({"label": label, "at": np.arange(m.size), "v": m.ravel()})

    sums = labelled.mapInPandas(partial, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["at"]] = r["v"]
    return {k: (m[0], m[1 : d + 1], m.reshape(d + 1, d + 1)[1:, 1:]) for k, m in out.items()}


def fit(labelled: DataFrame, options: FitOptions = FitOptions()) -> Model:
    """Fit on columns (label 0 or 1, x array<double>)."""
    d = len(NAMES)
    got = moments(labelled.where("label in (0, 1)"), d)
    n = sum(c for c, _, _ in got.values())
    if len(got) < 2:
        return Model(np.zeros(d), np.ones(d), [], [], [], 0.0, 1.0, constant=0.5 if not got else float(next(iter(got))))
    centre = sum(s for _, s, _ in got.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(q for _, _, q in got.values())) / n - centre**2, 1e-9))
    means, covs = [], []
    for k in (0, 1):
        c, s, q = got[k]
        mean = s / c
        means.append((mean - centre) / scale)
        covs.append((q / c - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = sum(got[k][0] * covs[k] for k in (0, 1)) / n
    whiten, logdet = [], []
    for cov in covs:
        cov = (1 - options.to_pooled) * cov + options.to_pooled * pooled
        cov = (1 - options.to_diagonal) * cov + options.to_diagonal * np.diag(np.diag(cov)) + options.ridge * np.eye(d)
        low = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(low))
        logdet.append(2 * float(np.log(np.diag(low)).sum()))
    return Model(centre, scale, means, whiten, logdet, float(np.log(got[1][0] / got[0][0])), options.temperature)


def log_odds(x: np.ndarray, model: Model) -> np.ndarray:
    z = (x - model.centre) / model.scale
    density = [-0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - 0.5 * ld for m, w, ld in zip(model.means, model.whiten, model.logdet, strict=True)]
    return (density[1] - density[0] + model.log_prior) / model.temperature


def score(x: Column, model: Model) -> Column:
    """P(label 1) of a column of statistics."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            if not len(xs) or model.constant is not None:
                yield pd.Series(np.full(len(xs), model.constant if model.constant is not None else 0.5))
            else:
                yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(log_odds(np.stack(xs.to_list()), model), -500, 500))))

    return F.pandas_udf(run, "double")(x)
