"""Comparisons across checkpoints and runs; each is one job over all of them, not one per run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyframe import schemas
from tallyframe.operators.accuracy import pass_at_1
from tallyframe.operators.checkpoints import (
    accuracy_curve,
    accuracy_grid,
    accuracy_series,
    mean_length_curve,
    with_failed,
)
from tallyframe.operators.lengths import length_frequencies, length_histogram, length_stats
from tallyframe.operators.scoring import score_samples
from tallyframe.session import written
from tallyframe.sources.checkpoint_dirs import checkpoint_dirs, read_checkpoints, read_run_steps

CHECKPOINT = "checkpoint_num"
RUN = ("sft_epoch", "rl_step")


@dataclass(frozen=True)
class LengthSweep:
    summary: DataFrame
    mean_length: DataFrame
    accuracy: DataFrame
    histogram: DataFrame


def sweep_lengths(samples: DataFrame, manifest: DataFrame, keep: bool = False) -> LengthSweep:
    """Summary of every listed checkpoint, curves without the failed ones, and histograms.

    All four read one frequency table; ``keep`` writes that small table first, so that using
    several of them scans the samples once.
    """
    counts = length_frequencies(samples, [CHECKPOINT], correct="is_correct")
    counts = written(counts, "lengths") if keep else counts
    summary = with_failed(manifest, length_stats(counts, [CHECKPOINT]), CHECKPOINT)
    return LengthSweep(
        summary, mean_length_curve(summary), accuracy_curve(summary), length_histogram(counts, [CHECKPOINT])
    )


def sweep_checkpoint_dir(
    spark: SparkSession,
    parent: str,
    examples: DataFrame,
    schema: T.StructType = schemas.GENERATIONS,
    files: str | None = None,
) -> LengthSweep:
    """Score the generations in every checkpoint folder and compare the checkpoints."""
    samples = read_checkpoints(spark, parent, schema, files=files)
    results = score_samples(samples, examples, run=[CHECKPOINT])
    manifest = checkpoint_dirs(spark, parent).select(CHECKPOINT)
    return sweep_lengths(results, manifest, keep=True)


@dataclass(frozen=True)
class AccuracySweep:
    accuracy: DataFrame
    series: DataFrame
    grid: DataFrame


def sweep_accuracy(
    samples: DataFrame,
    num_gen: int | None = 8,
    steps: Sequence[int] | None = None,
    n_problems: int | None = None,
    problem: str = "problem_id",
    keep: bool = False,
) -> AccuracySweep:
    """pass@1 per (SFT epoch, RL step) as a table, as series per epoch and as a grid."""
    accuracy = pass_at_1(samples, RUN, num_gen, n_problems, problem)
    accuracy = written(accuracy, "accuracy") if keep else accuracy
    return AccuracySweep(accuracy, accuracy_series(accuracy), accuracy_grid(accuracy, steps))


def sweep_run_dirs(
    spark: SparkSession,
    parent: str,
    examples: DataFrame,
    num_gen: int = 8,
    epochs: Sequence[int] | None = None,
    schema: T.StructType = schemas.GENERATIONS,
    files: str | None = None,
) -> AccuracySweep:
    """Score the generations in every run and step folder and compare the runs.

    The mean is over all examples: one without samples in a run counts as unsolved there.
    """
    samples = read_run_steps(spark, parent, schema, epochs, files=files)
    results = score_samples(samples, examples, run=RUN)
    return sweep_accuracy(results, num_gen, n_problems=examples.count(), problem="id", keep=True)
