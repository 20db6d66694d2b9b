"""A corpus pipeline of five operators: each stage works on what the one before kept.

Stages take (spark, docs, sf_dir) and return the columns of documents; the last one adds ``epoch``. Tables
that a stage needs besides its documents come from the folder ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import toxicity
from tallyframe.llm.decontaminate import without_leaks
from tallyframe.llm.jaccard_join import one_of_each
from tallyframe.llm.line_dedup import drop_repeated_lines
from tallyframe.llm.mixing import mix
from tallyframe.llm.queries import MIX_SHARE, MIX_WEIGHTS, labels_of, mix_levels, table
from tallyframe.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject. It learns from the labelled documents of this stage."""
    model = toxicity.fit(docs, labels_of(spark, sf_dir, "toxic", 5, 0))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines. One that loses all its text goes; one that had none stays.

    ``n_chars`` counts the text that is left.
    """
    left = drop_repeated_lines(docs)
    kept = left.where("n_dropped = 0 OR text != ''").drop("n_lines", "n_dropped")
    changed = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.withColumns(changed)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id; texts without words all stay."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and epochs that the target weights select."""
    return mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
]

# SQL cannot express the learned grammar of the first stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows by id and epoch, with a digest of the text that is left."""
    return run(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "epoch", F.md5("text").alias("text_md5"))


QUERIES = {"pipeline": pipeline}
ORACLES: dict[str, str] = {}
