"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams of words (one and two words in small letters) and of word shapes (one to three words; a
word that repeats the one before has a shape of its own), hashed to buckets. Indicators are scaled by the log ratio of their
smoothed counts in the two classes, then a linear hinge-loss model is fitted by dual coordinate descent and
its margins are turned into probabilities by a logistic curve, in which the classes count by their true shares.

Fitted on a bounded sample of labelled rows (``sampling.ROWS_PER_CLASS`` of each class, by hash of the
id); the driver gets the buckets of those texts, at most twice ``BUCKETS`` numbers a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.sampling import ROWS_PER_CLASS, class_sample, label_counts, one_text

# Buckets of shapes, and as many of words after them.
BUCKETS = 1 << 14
EPOCHS = 20
COST = 0.5
_RUNS = re.compile(r"(.)\1+")
_REPEATED = 1


class _Shapes(dict):
    """Codes of a word: of its shape - runs of capitals, small letters, digits and each other character - and of itself."""

    # Words kept so as not to be read again, and the longest of them.
    LIMIT = 100_000
    LENGTH = 40

    def __missing__(self, word: str) -> tuple[int, int]:
        marks = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
        code = 2
        for c in _RUNS.sub(r"\1", marks):
            code = (code * 1_000_003 + ord(c)) & 0xFFFFFFFFFFFF
        codes = code, int.from_bytes(hashlib.blake2b(word.lower().encode("utf-8", "replace"), digest_size=6).digest())
        if len(word) <= self.LENGTH:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = codes
        return codes


def shape_ngrams(text: str | None, shapes: _Shapes) -> np.ndarray:
    """Buckets of the n-grams that occur in the whole text, in order."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int32)
    code, word = np.array([shapes[w] for w in words], np.uint64).T.copy()
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, len(words) - 1)
    code[1:][same] = _REPEATED
    factor = np.uint64(0x9E3779B97F4A7C15)
    parts, rolled = [code], code
    for n in (2, 3):
        rolled = (rolled[: len(code) - n + 1] * factor) ^ code[n - 1 :]
        parts.append(rolled + np.uint64(n << 50))
    bits = np.uint64(64 - (BUCKETS.bit_length() - 1))
    of_shapes = (np.concatenate(parts) * factor) >> bits
    pairs = (word[:-1] * np.uint64(1_000_003)) ^ word[1:]
    of_words = ((np.concatenate((word, pairs + np.uint64(1 << 50))) * factor) >> bits) + np.uint64(BUCKETS)
    return np.unique(np.concatenate((of_shapes, of_words)).astype(np.int32))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, text: str | None, shapes: _Shapes) -> float:
        grams = shape_ngrams(text, shapes)
        margin = (self.weights[grams].sum() / np.sqrt(max(1, len(grams))) if len(grams) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit_rows(samples: list[np.ndarray], labels: Iterable[int], shares: dict[int, int] | None = None) -> QualityModel:
    """Log-count ratios, dual coordinate descent and the logistic curve; no rows or one class give a constant.

    ``shares``: how many rows of each class there are, if not as in the sample.
    """
    y = np.asarray(list(labels), int)
    share = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(2 * BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.ones((2, 2 * BUCKETS))
    for grams, label in zip(samples, y):
        counts[label, grams] += 1
    ratio = np.log(counts[1] / (1 + (y == 1).sum())) - np.log(counts[0] / (1 + (y == 0).sum()))
    rows = [ratio[g] / np.sqrt(max(1, len(g))) for g in samples]
    sign = np.where(y == 1, 1.0, -1.0)
    # One class may be rare: its errors cost as much in total as those of the other.
    limit = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) * COST
    norm = np.array([r @ r + 1 for r in rows])
    w, bias, alpha = np.zeros(2 * BUCKETS), 0.0, np.zeros(len(y))
    random = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in random.permutation(len(y)):
            g, x = samples[i], rows[i]
            gradient = sign[i] * (w[g] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[g] += step * x
                bias += step
                alpha[i] = new
    margins = np.array([w[g] @ x + bias for g, x in zip(samples, rows)])
    true = shares if shares and shares.get(0) and shares.get(1) else {c: int((y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, true[1] / (y == 1).sum(), true[0] / (y == 0).sum())
    slope, offset = logistic_curve(margins, y, weight * len(y) / weight.sum())
    return QualityModel(w * ratio, float(bias), slope, offset)


def logistic_curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton's method with softened targets and a weight for each row."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.column_stack((margins, np.ones(len(margins))))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (target - p)) - 1e-3 * (beta - [1, 0]))
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labelled: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """The model of docs (doc_id, text) with labelled (doc_id, label); label 1 is good quality.

    Of an id with several texts the one of the smallest hash is learned.
    """

    @F.pandas_udf("array<int>")
    def grams(texts: pd.Series) -> pd.Series:
        shapes = _Shapes()
        return pd.Series([shape_ngrams(t, shapes) for t in texts])

    sample = F.broadcast(class_sample(labelled, rows_per_class))
    rows = one_text(docs.select("doc_id", "text").join(sample, "doc_id")).select("doc_id", "label", grams("text").alias("grams"))
    found = rows.toPandas().sort_values("doc_id")
    return fit_rows([np.asarray(g, np.int32) for g in found["grams"]], found["label"], label_counts(labelled))


def score(docs: DataFrame, model: QualityModel, columns: list[str]) -> DataFrame:
    """``columns`` of docs with score and predicted, from the whole ``text`` alone.

    A null or empty text has no n-gram and gets the score of the bias. Other columns do not matter;
    repeated rows get equal scores.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        shapes = _Shapes()
        return pd.Series([model.score(t, shapes) for t in texts], dtype="float64")

    return docs.select(*columns, scored("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
