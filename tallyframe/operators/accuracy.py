"""Accuracy over problems, samples and runs.

Samples are collapsed to one row per problem first, with partial aggregation on the map side, so a
problem with very many samples costs no more than others. Counts and token sums are integers and
divided once, which keeps every mean exact and independent of row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import ratio
from tallyframe.functions.answers import PARSE_FAILURE
from tallyframe.operators.joins import keyed_join
from tallyframe.operators.scoring import CATEGORIES, complete_samples, with_categories

_PARTIALS = ("total", "correct", "samples", "failures", "out_tokens", "in_tokens")


def parse_failures(results: DataFrame) -> DataFrame:
    """Number of samples without a readable answer, and their share of all samples."""
    return results.agg(
        F.count("*").alias("total_samples"),
        F.count_if(F.col("match_type") == PARSE_FAILURE).alias("parse_failures"),
    ).withColumn("parse_failure_share", ratio(F.col("parse_failures"), F.col("total_samples")))


def _per_problem(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy("id", *keys).agg(
        F.bool_or("is_correct").alias("is_correct"),
        F.count("*").alias("samples"),
        F.count_if(F.col("match_type") == PARSE_FAILURE).alias("failures"),
        F.sum(F.coalesce(F.col("output_tokens"), F.lit(0)).cast("bigint")).alias("out_tokens"),
        F.sum(F.coalesce(F.col("prompt_tokens"), F.lit(0)).cast("bigint")).alias("in_tokens"),
    )


def problem_verdicts(results: DataFrame) -> DataFrame:
    """One row per problem of scored samples that carry level and type; any correct sample solves.

    Level and type belong to the problem, so they are constant within an id.
    """
    return _per_problem(results, *CATEGORIES)


def problem_verdicts_of(outputs: DataFrame, examples: DataFrame) -> DataFrame:
    """The same from judged samples and examples: samples collapse by id before the join.

    A repeated example id raises.
    """
    per_problem = _per_problem(complete_samples(outputs))
    problems = with_categories(examples).select("id", *CATEGORIES)
    return keyed_join(per_problem, problems, "id", unique=True, hot_rows=None)


def any_correct(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("id", *CATEGORIES, "is_correct")


def _partials() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if("is_correct").alias("correct"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _PARTIALS[2:]],
    ]


def _sample_metrics() -> list[Column]:
    return [
        F.col("samples").alias("total_samples"),
        F.col("failures").alias("parse_failures"),
        ratio(F.col("out_tokens"), F.col("samples")).alias("avg_output_tokens"),
        ratio(F.col("in_tokens"), F.col("samples")).alias("avg_prompt_tokens"),
    ]


def overall(verdicts: DataFrame) -> DataFrame:
    """Accuracy over problems with token means and parse failures over samples; always one row."""
    return verdicts.agg(*_partials()).select(
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        "correct",
        "total",
        *_sample_metrics(),
    )


def accuracy_by(verdicts: DataFrame, key: str) -> DataFrame:
    """Accuracy over the problems of each level or type, in key order."""
    return (
        verdicts.groupBy(key)
        .agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))
        .select(key, "correct", "total", ratio(F.col("correct"), F.col("total")).alias("accuracy"))
        .orderBy(key)
    )


def accuracy_report(verdicts: DataFrame) -> DataFrame:
    """Overall, by-level and by-type accuracy from one pass, as rows ``(section, key, ...)``.

    Problems collapse to (level, type) cells first, so the grouping sets only triple that small
    table. A cell of zero problems keeps the overall row when the input is empty.
    """
    cells = verdicts.groupBy(*CATEGORIES).agg(*_partials())
    no_problems = cells.sparkSession.range(0, 1, 1, 1).select(
        *[F.lit(None).cast("string").alias(c) for c in CATEGORIES],
        *[F.lit(0).cast("bigint").alias(c) for c in _PARTIALS],
    )
    grouped = (
        cells.unionByName(no_problems)
        .groupingSets([[], ["level"], ["type"]], *CATEGORIES)
        .agg(
            F.grouping("level").alias("no_level"),
            F.grouping("type").alias("no_type"),
            *[F.sum(c).alias(c) for c in _PARTIALS],
        )
    )
    whole = (F.col("no_level") == 1) & (F.col("no_type") == 1)
    section = F.when(whole, "overall").when(F.col("no_level") == 0, "level").otherwise("type")
    return (
        grouped.where(whole | (F.col("total") > 0))
        .select(
            section.alias("section"),
            F.coalesce("level", "type").alias("key"),
            ratio(F.col("correct"), F.col("total")).alias("accuracy"),
            "correct",
            "total",
            *_sample_metrics(),
        )
        .orderBy(F.col("section") != "overall", "section", "key")
    )


def row_accuracy(samples: DataFrame, *run: str) -> DataFrame:
    """Share of correct rows per run."""
    return (
        samples.groupBy(*run)
        .agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("n"))
        .withColumn("accuracy", ratio(F.col("correct"), F.col("n")))
    )


def pass_at_1(
    samples: DataFrame,
    run: Sequence[str],
    num_gen: int | None = None,
    n_problems: int | None = None,
    problem: str = "problem_id",
) -> DataFrame:
    """Mean over problems of ``correct / num_gen`` per run, and the sum it comes from.

    Without ``num_gen`` each problem is divided by the samples it has. ``n_problems`` counts
    problems that left no sample in a run as zero.
    """
    run = list(run)
    per_problem = samples.groupBy(*run, problem).agg(
        F.count_if("is_correct").alias("correct"), F.count("*").alias("n")
    )
    if num_gen is None:
        solved = F.sum(F.col("correct") / F.col("n"))
    else:
        solved = F.sum("correct") / F.lit(float(num_gen))
    problems = F.count("*") if n_problems is None else F.lit(n_problems).cast("bigint")
    return (
        per_problem.groupBy(*run)
        .agg(problems.alias("problems"), solved.cast("double").alias("problems_solved"))
        .withColumn("accuracy", ratio(F.col("problems_solved"), F.col("problems")))
    )
