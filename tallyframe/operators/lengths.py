"""Length statistics and histograms from one frequency table.

Token counts are integers below the generation limit, so a run has few distinct lengths however
many samples it has. All samples are counted once per (run, length); everything else reads that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import ratio

# Bins of a histogram and the percentiles of a summary.
BINS = 40
PERCENTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def length_frequencies(
    samples: DataFrame, run: Sequence[str] = (), length: str = "output_tokens", correct: str | None = None
) -> DataFrame:
    """Rows per (run, length), with the number of correct ones if a verdict column is named."""
    counts = [F.count("*").alias("n_rows")]
    if correct:
        counts.append(F.count_if(correct).alias("n_correct"))
    value = F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("length")
    return samples.select(*run, value, *([correct] if correct else [])).groupBy(*run, "length").agg(*counts)


def _sample_std() -> Column:
    """Sample deviation from integer sums, exact up to the final division; 0.0 for one row."""
    rows = F.col("n_rows").cast("decimal(19,0)")
    value = F.col("length").cast("decimal(10,0)")
    n = F.sum(rows).cast("decimal(19,0)")
    total = F.sum(rows * value).cast("decimal(19,0)")
    squares = F.sum(rows * value * value)
    spread = (n * squares - total * total).cast("double")
    pairs = n.cast("double") * (n.cast("double") - 1)
    return F.sqrt(F.coalesce(F.try_divide(spread, pairs), F.lit(0.0)))


def length_stats(frequencies: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, extremes and linearly interpolated percentiles per run.

    Frequencies that count correct rows add the accuracy. Runs without rows are absent; without run
    columns an empty table gives one row with n = 0.
    """
    shares = F.array(*[F.lit(p) for p in PERCENTILES.values()])
    judged = "n_correct" in frequencies.columns
    n, total = F.sum("n_rows"), F.sum(F.col("n_rows") * F.col("length"))
    stats = frequencies.groupBy(*run).agg(
        F.coalesce(n, F.lit(0)).alias("n"),
        F.try_divide(total, n).cast("double").alias("mean"),
        _sample_std().alias("std"),
        F.min("length").alias("min"),
        F.percentile("length", shares, F.col("n_rows")).alias("p"),
        F.max("length").alias("max"),
        *([ratio(F.sum("n_correct"), n).alias("accuracy")] if judged else []),
    )
    ranked = [F.col("p")[i].alias(name) for i, name in enumerate(PERCENTILES)]
    shown = F.when(F.col("n") > 0, F.col("std")).alias("std")
    return stats.select(*run, "n", "mean", shown, "min", *ranked, "max", *(["accuracy"] if judged else []))


def length_histogram(frequencies: DataFrame, run: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Equal bins between a run's shortest and longest length; the last one includes its end.

    Empty bins are present. If all lengths are equal, the range is one wide around them. Edges are
    double-precision steps from the shortest length, and a length on an edge opens the next bin.
    """
    run = list(run)
    group = Window.partitionBy(*run) if run else Window.partitionBy(F.lit(0))
    low, high = F.min("length").over(group), F.max("length").over(group)
    ranged = frequencies.withColumns(
        {
            "start": F.when(low == high, low - 0.5).otherwise(low.cast("double")),
            "step": F.when(low == high, 1.0).otherwise((high - low).cast("double")) / bins,
        }
    )

    def edge(bin_no: Column) -> Column:
        return F.col("start") + F.col("step") * bin_no

    inner = F.sequence(F.lit(1), F.lit(bins - 1)) if bins > 1 else F.array().cast("array<int>")
    passed = F.size(F.filter(inner, lambda k: edge(k) <= F.col("length")))
    filled = (
        ranged.groupBy(*run, "start", "step", passed.alias("bin"))
        .agg(F.sum("n_rows").alias("n"))
        .groupBy(*run, "start", "step")  # at most `bins` entries per group
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    )
    return filled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *run,
        "bin",
        edge(F.col("bin")).alias("bin_start"),
        edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("n"),
    )
