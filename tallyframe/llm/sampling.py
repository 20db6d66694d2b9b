"""Held-out folds and bounded training samples for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of each class that a classifier is fitted on, at most.
ROWS_PER_CLASS = 4000


def fold(doc_id: Column, folds: int) -> Column:
    """Fold of a row: crc32 of its id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def thinned(rows: DataFrame, wanted: int, total: int, *keys: str) -> DataFrame:
    """About twice ``wanted`` of ``total`` rows, by the hash of their keys, so that a limit has few rows to sort.

    Rows with equal keys stay or go together.
    """
    if total <= 4 * wanted:
        return rows
    spread = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 31))
    return rows.where(spread < (1 << 32) * wanted // total)


def class_sample(labelled: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, label): at most ``rows_per_class`` ids of each class 0 and 1, the first by hash.

    ``labelled`` has doc_id and label. Null ids and labels, labels other than 0 and 1, and ids with
    both labels are left out.
    """
    known = (
        labelled.where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    seeded = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    of_class = {c: thinned(known.where(F.col("label") == c), rows_per_class, totals.get(c, 0), "doc_id") for c in (0, 1)}
    parts = [of_class[c].orderBy(seeded, "doc_id").limit(rows_per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def one_text(sampled: DataFrame) -> DataFrame:
    """(doc_id, label, text) of sampled rows, one for each id: of several texts that of the smallest hash, then the smallest."""
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")
    return sampled.groupBy("doc_id").agg(first).select("doc_id", "r.label", "r.text")


def label_counts(labelled: DataFrame) -> dict[int, int]:
    """How many rows have label 0 and label 1."""
    return {r["label"]: r["count"] for r in labelled.where("label IN (0, 1)").groupBy("label").count().collect()}
