"""Quality scores by a regularised quadratic discriminant over document statistics.

Each class has a mean and a shrunken covariance of transformed text statistics. A score is
the logistic of the difference of log densities, whose Mahalanobis distances come from
Cholesky factors made once per model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spelltally.llm.common import fold, stored, without

FOLDS = 5
ACCEPTED = 0.3
# Weight of the common covariance in each class, and of its diagonal in the common one.
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
# The difference of log densities is divided by this: statistics of one text are not independent.
TEMPER = 4.0
_NAMES = (
    "words", "word_length", "word_spread", "upper", "digits", "symbols", "stops", "other_ascii",
    "distinct_words", "top_word", "lines", "repeated_lines", "line_words", "edge_symbols", "all_upper_words", "runs",
)
WIDTH = len(_NAMES)
_CLASS = np.zeros(256, dtype=np.int64)
for _byte in range(256):
    _char = chr(_byte)
    _CLASS[_byte] = (
        0 if _byte >= 128 or "a" <= _char <= "z"
        else 1 if "A" <= _char <= "Z"
        else 2 if _char.isdigit()
        else 3 if _char in " \t\n\r\v\f"
        else 4 if _char in ".,;:'\"-"
        else 5
    )


def _share(part: float, whole: float) -> float:
    """Log odds of a share, smoothed so that 0 and 1 are finite."""
    return log((part + 0.5) / (max(whole - part, 0) + 0.5)) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * WIDTH
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=6)
    words = raw.split()
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line]
    solid = len(raw) - int(kinds[3])
    edges = sum(n for w, n in counts.items() if _CLASS[w[-1]] == 5)
    shouted = sum(n for w, n in counts.items() if len(w) > 1 and w.isupper())
    again = sum(n - 1 for n in Counter(lines).values())
    pairs = sum(1 for a, b in zip(words, words[1:]) if a == b)
    mean = float(sizes.mean()) if len(words) else 0.0
    spread = float(sizes.std()) if len(words) else 0.0
    return [
        log1p(len(words)), log1p(mean), log1p(spread),
        _share(float(kinds[1]), solid), _share(float(kinds[2]), solid), _share(float(kinds[5]), solid),
        _share(float(kinds[4]), solid), log1p(kinds[5]),
        _share(len(counts), len(words)), _share(max(counts.values(), default=0), len(words)),
        log1p(len(lines)), _share(again, len(lines)), log1p(len(words) / max(len(lines), 1)),
        _share(edges, len(words)), _share(shouted, len(words)), _share(pairs, len(words)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and constants of both classes, class 0 first."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            solved = np.linalg.solve(factor, (rows - mean).T)
            logs.append(constant - 0.5 * (solved**2).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPER, -50, 50)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products per class, added up on the executors.

    What reaches the driver has a fixed size: 1 + width + width squared numbers per class.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, part in batch.groupby("label"):
                rows = np.array(part["statistics"].tolist())
                values = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
                yield pd.DataFrame({"label": int(label), "place": np.arange(len(values)), "value": values})

    added = labelled.mapInPandas(sums, "label int, place int, value double").groupBy("label", "place")
    totals: dict[int, np.ndarray] = {}
    for label, place, value in added.agg(F.sum("value").alias("value")).collect():
        totals.setdefault(label, np.zeros(1 + WIDTH + WIDTH * WIDTH))[place] = value
    return {
        label: (v[0], v[1 : 1 + WIDTH], v[1 + WIDTH :].reshape(WIDTH, WIDTH)) for label, v in totals.items()
    }


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant | None:
    """None unless both classes have rows."""
    if set(sums) != {0, 1}:
        return None
    counts = np.array([sums[c][0] for c in (0, 1)])
    means = np.array([sums[c][1] / sums[c][0] for c in (0, 1)])
    own = np.array([sums[c][2] / sums[c][0] - np.outer(m, m) for c, m in zip((0, 1), means)])
    pooled = (own * counts[:, None, None]).sum(axis=0) / counts.sum()
    common = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    ridge = np.eye(WIDTH) * 1e-3
    factors = np.array([np.linalg.cholesky((1 - TO_POOLED) * c + TO_POOLED * common + ridge) for c in own])
    constants = np.log(counts / counts.sum()) - np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, factors, constants)


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``_score``. Labels come from the training fold only."""
    described = docs.withColumn("_statistics", statistics_of("text"))
    training = stored(
        described.where(fold("doc_id", FOLDS) != 0).select("doc_id", F.col("_statistics").alias("statistics")),
        "quality-statistics",
    )
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1)")
    sums = moments(training.join(marks, "doc_id").select("label", "statistics"))
    model = discriminant(sums)
    seen = sum(n for n, _, _ in sums.values())
    constant = float(sums[1][0] / seen) if 1 in sums else 0.0 if seen else 0.5

    @F.pandas_udf("double")
    def score(statistics: pd.Series) -> pd.Series:
        if model is None or not len(statistics):
            return pd.Series([constant] * len(statistics), dtype="float64")
        return pd.Series(model.scores(np.array(statistics.tolist())))

    return described.withColumn("_score", score("_statistics")).drop("_statistics")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted`` to each document.

    Needs ``doc_id`` and ``text``; only the text is scored. A null text counts as empty and
    gets a score like any other. Labels other than 0 and 1 are ignored; without both kinds
    the score is the share of ones, 0.5 without any label. Columns named like a result are
    replaced; repeated rows are scored each; an empty input gives an empty result.
    """
    docs = without(docs, "held_out", "score", "predicted")
    return (
        _scored(docs, labels)
        .withColumn("held_out", fold("doc_id", FOLDS) == 0)
        .withColumn("score", F.col("_score"))
        .withColumn("predicted", (F.col("_score") >= ACCEPTED).cast("int"))
        .drop("_score")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a predicted quality of 1, with their own columns."""
    return _scored(docs, labels).where(F.col("_score") >= ACCEPTED).drop("_score")
