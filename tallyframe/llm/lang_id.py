"""Language identification by error-correcting output codes.

Each language gets a binary codeword. For every bit a naive Bayes classifier over hashed letter n-grams
(one to three letters, words padded with blanks) tells the languages with a 1 from those with a 0. A text
gets the language whose codeword costs least: the logistic loss of each bit, weighted by how well its
classifier does on the training texts. A close second codeword flags the text as ambiguous.

The counts cover all training rows and languages; they are added up in each task to one vector a language, so what is
shuffled depends on the number of tasks and languages, not on the rows. The driver reads one language after
the other and keeps sums for each bit, whose number grows with the logarithm of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import written

UNKNOWN = "und"
BUCKETS = 1 << 14
AMBIGUOUS_BELOW = 0.75
# Languages whose counts a task holds at a time; with more it hands on partial counts.
_HELD = 256


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether a code point is a letter; made once in each worker."""
    if not _LETTERS:
        points = np.arange(0x110000, dtype=np.uint32)
        points[0xD800:0xE000] = 0
        _LETTERS.append(np.fromiter((c.isalpha() for c in points.tobytes().decode("utf-32-le")), bool, len(points)))
    return _LETTERS[0]


def letter_ngrams(text: str | None) -> np.ndarray:
    """Hashed letter n-grams of the whole text, in order; empty where it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _letter_table()[codes]
    if not letters.any():
        return np.empty(0, np.int64)
    blank = np.where(letters, codes, 32).astype(np.uint64)
    after_letter = np.concatenate(([False], letters[:-1]))
    a = np.concatenate(([np.uint64(32)], blank[letters | after_letter]))
    if a[-1] != 32:
        a = np.append(a, np.uint64(32))
    one, factor = a[1:], np.uint64(0x9E3779B97F4A7C15)
    two = a[:-1] * np.uint64(1_000_003) + a[1:]
    three = two[:-1] * np.uint64(1_000_003) + a[2:]
    hashes = np.concatenate((one[one != 32], two ^ np.uint64(1 << 60), three ^ np.uint64(1 << 61)))
    return ((hashes * factor) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of 0 and 1: every split of the languages up to 6 of them, else seeded random splits."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        splits = range(1, 1 << (n - 1))
        return np.array([[(s >> i) & 1 if i < n - 1 else 0 for s in splits] for i in range(n)], np.int8)
    random = np.random.default_rng(7)
    best, distance = None, -1
    for _ in range(20):
        code = (random.random((n, int(10 * np.log2(n)))) < 0.5).astype(np.int8)
        code = code[:, (code.min(0) == 0) & (code.max(0) == 1)]
        least = _least_distance(code)
        if least > distance:
            best, distance = code, least
    return best


def _least_distance(code: np.ndarray) -> int:
    """Least number of bits in which two codewords differ, some rows against all at a time."""
    bits = code.astype(np.float32)
    ones, least = bits.sum(1), code.shape[1]
    for begin in range(0, len(code), 512):
        some = bits[begin : begin + 512]
        apart = ones[begin : begin + 512, None] + ones[None, :] - 2 * (some @ bits.T)
        apart[np.arange(len(some)), begin + np.arange(len(some))] = np.inf
        least = min(least, int(apart.min()))
    return least


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log ratio of an n-gram under bit 1 and bit 0
    bit_weights: np.ndarray

    def losses(self, text: str | None) -> np.ndarray | None:
        """Loss of each language's codeword; None where the text has no letter."""
        grams = letter_ngrams(text)
        if not len(grams) or not self.languages:
            return None
        margins = np.bincount(grams, minlength=BUCKETS) @ self.weights / np.sqrt(len(grams))
        signed = np.where(self.codes == 1, 1, -1) * margins
        return np.logaddexp(0, -signed) @ self.bit_weights

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence and whether a second one comes close; the first by name wins a tie."""
        losses = self.losses(text)
        if losses is None:
            return UNKNOWN, 0.0, True
        odds = np.exp(losses.min() - losses)
        best = int(losses.argmin())
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, score < AMBIGUOUS_BELOW


def fit(rows: DataFrame) -> LanguageModel:
    """The model of all rows (text, lang) whose lang is not null, whatever the number of languages."""
    rows = rows.where("lang IS NOT NULL").select("text", "lang")
    kept = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not kept:
        return LanguageModel([], codewords(0), np.zeros((BUCKETS, 0)), np.zeros(0))
    place = {lang: i for i, lang in enumerate(kept)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if place[lang] not in totals and len(totals) == _HELD:
                    yield from map(nonzero, totals.items())
                    totals.clear()
                totals.setdefault(place[lang], np.zeros(BUCKETS, np.int64))[:] += np.bincount(letter_ngrams(text), minlength=BUCKETS)
        yield from map(nonzero, totals.items())

    def nonzero(item: tuple[int, np.ndarray]) -> pd.DataFrame:
        lang, counts = item
        used = np.flatnonzero(counts)
        return pd.DataFrame({"lang": lang, "bucket": used, "n": counts[used]})

    grams = rows.mapInPandas(counted, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_language = grams.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
    by_language = written(by_language, "language_counts")  # at most BUCKETS counts a language

    def shares() -> Iterator[tuple[int, np.ndarray]]:
        """The smoothed shares of each language's n-grams; languages without any come last."""
        seen = set()
        for r in by_language.toLocalIterator():
            counts = np.full(BUCKETS, 0.5)
            counts[r["buckets"]] += r["counts"]
            seen.add(r["lang"])
            yield r["lang"], counts / counts.sum()
        for lang in range(len(kept)):
            if lang not in seen:
                yield lang, np.full(BUCKETS, 1 / BUCKETS)

    codes = codewords(len(kept))
    ones, all_shares = np.zeros((BUCKETS, codes.shape[1])), np.zeros(BUCKETS)
    for lang, share in shares():
        ones[:, codes[lang] == 1] += share[:, None]
        all_shares += share
    with_one = codes.sum(0)
    weights = np.log(ones / np.maximum(1, with_one)) - np.log((all_shares[:, None] - ones) / np.maximum(1, len(kept) - with_one))
    # A bit counts by the least margin that it gives a language on its side of the split.
    bit_weights = np.full(codes.shape[1], np.inf)
    for lang, share in shares():
        bit_weights = np.minimum(bit_weights, share @ weights * np.where(codes[lang] == 1, 1, -1))
    bit_weights = np.clip(bit_weights, 0.05, None)
    return LanguageModel(kept, codes, weights, bit_weights / bit_weights.mean() if len(bit_weights) else bit_weights)


def identify(docs: DataFrame, model: LanguageModel, columns: list[str]) -> DataFrame:
    """``columns`` of docs with lang_pred, score and ambiguous, from the whole ``text`` alone.

    A null text and one without a letter get ``und`` with score 0, and so does every text where no
    language was learned. Other columns do not matter; repeated rows get equal results, rows of one id with other texts
    their own.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return docs.select(*columns, guess("text").alias("__guess")).select(*columns, "__guess.*")
