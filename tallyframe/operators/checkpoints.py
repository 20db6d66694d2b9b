"""Comparing checkpoints and (epoch, step) runs.

These tables have one row per run, so ordering and pivoting them is cheap whatever the number of
samples behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import fixed
from tallyframe.operators.lengths import length_frequencies, length_stats


# Folder names of numbered checkpoints and of training steps.
CHECKPOINT_NAME = r"^.+_(\d+)$"
STEP_NAME = r"^global_step_(\d+)$"


def trailing_number(name: Column) -> Column:
    """Checkpoint number at the end of a name such as ``model_12``, null for other names."""
    return F.regexp_extract(name, CHECKPOINT_NAME, 1).try_cast("bigint")


def step_number(name: Column) -> Column:
    """Step of a name such as ``global_step_40``, null for other names."""
    return F.regexp_extract(name, STEP_NAME, 1).try_cast("bigint")


def checkpoint_stats(samples: DataFrame, checkpoint: str = "checkpoint_num") -> DataFrame:
    """Length statistics and row accuracy per checkpoint, from one scan of the samples."""
    return length_stats(length_frequencies(samples, [checkpoint], correct="is_correct"), [checkpoint])


def with_failed(manifest: DataFrame, stats: DataFrame, checkpoint: str = "checkpoint_num") -> DataFrame:
    """Every checkpoint of the manifest; those without rows have n = 0 and status FAILED."""
    return (
        manifest.join(stats, checkpoint, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("status", F.when(F.col("n") > 0, "OK").otherwise("FAILED"))
        .orderBy(checkpoint)
    )


def mean_length_curve(summary: DataFrame, checkpoint: str = "checkpoint_num") -> DataFrame:
    return summary.where(F.col("n") > 0).select(checkpoint, F.col("mean").alias("mean_length")).orderBy(checkpoint)


def accuracy_curve(summary: DataFrame, checkpoint: str = "checkpoint_num") -> DataFrame:
    shown = (F.col("accuracy") * 100).alias("accuracy_pct")
    return summary.where(F.col("accuracy").isNotNull()).select(checkpoint, shown).orderBy(checkpoint)


def step_ordinals(manifest: DataFrame, run: Sequence[str], step: str) -> DataFrame:
    """Steps of each run renumbered from 1 in numeric order."""
    order = Window.partitionBy(*run).orderBy(F.col(step).cast("bigint"))
    return manifest.withColumn("ordinal", F.row_number().over(order))


def distinct_steps(accuracy: DataFrame, step: str = "rl_step") -> DataFrame:
    """Steps seen in any run, ascending."""
    return accuracy.select(F.col(step).cast("bigint").alias(step)).distinct().orderBy(step)


def accuracy_series(accuracy: DataFrame, epoch: str = "sft_epoch", step: str = "rl_step") -> DataFrame:
    """Accuracy in percent along the steps of each run."""
    return accuracy.select(epoch, step, (F.col("accuracy") * 100).alias("accuracy_pct")).orderBy(epoch, step)


def accuracy_grid(
    accuracy: DataFrame, steps: Sequence[int] | None = None, epoch: str = "sft_epoch", step: str = "rl_step"
) -> DataFrame:
    """One row per epoch and one percent column per step, null where a run lacks the step.

    Steps are looked up when not given; that reads the small accuracy table once more.
    """
    if steps is None:
        steps = [r[step] for r in distinct_steps(accuracy, step).collect()]
    if not steps:
        return accuracy.select(epoch).distinct().orderBy(epoch)
    cells = [(F.max(F.when(F.col(step) == s, F.col("accuracy"))) * 100).alias(f"step_{s}") for s in steps]
    return accuracy.groupBy(epoch).agg(*cells).orderBy(epoch)


def grid_text(grid: DataFrame, epoch: str = "sft_epoch") -> DataFrame:
    """The grid with one decimal, and ``n/a`` for missing cells."""
    cells = [c for c in grid.columns if c != epoch]
    return grid.select(epoch, *[F.coalesce(fixed(F.col(c), 1), F.lit("n/a")).alias(c) for c in cells])
