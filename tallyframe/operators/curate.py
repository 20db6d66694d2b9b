"""Input checks, length filter and row accounting of the training-data path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import ratio


def require_columns(
    df: DataFrame, prompt_key: str = "prompt", response_key: str = "generated_solution"
) -> DataFrame:
    """Raise unless the table has rows and both columns, each with a value in some row.

    A read schema makes every column exist, so a column that is null throughout counts as missing.
    Each check stops at the first row it finds; ``missing_counts`` counts nulls in full.
    """
    if df.isEmpty():
        raise ValueError("input has no rows")
    wanted = [prompt_key, response_key]
    missing = [c for c in wanted if c not in df.columns or df.where(F.col(c).isNotNull()).isEmpty()]
    if missing:
        raise ValueError(f"missing columns {missing}; available columns {df.columns}")
    return df


def missing_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and nulls per required column, in one pass."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.isnull(c)).alias(f"null_{c}") for c in columns])


def total_tokens(df: DataFrame) -> Column:
    """Prompt plus output tokens; an absent column or a null counts as 0."""
    parts = [
        F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c in df.columns else F.lit(0).cast("bigint")
        for c in ("prompt_tokens", "output_tokens")
    ]
    return parts[0] + parts[1]


def within_length(df: DataFrame, max_tokens: int) -> DataFrame:
    """Rows of at most ``max_tokens`` tokens, all columns kept."""
    return df.where(total_tokens(df) <= max_tokens)


def length_filter_counts(df: DataFrame, max_tokens: int) -> list[Column]:
    return [
        F.count("*").alias("input"),
        F.count_if(total_tokens(df) <= max_tokens).alias("kept"),
    ]


def length_filter_report(df: DataFrame, max_tokens: int) -> DataFrame:
    """Input, kept and dropped rows with shares in percent; empty input gives 0 percent."""
    counts = df.agg(*length_filter_counts(df, max_tokens))
    dropped = F.col("input") - F.col("kept")
    return counts.select(
        "input",
        "kept",
        dropped.alias("dropped"),
        (ratio(F.col("kept"), F.col("input")) * 100).alias("kept_pct"),
        (ratio(dropped, F.col("input")) * 100).alias("dropped_pct"),
    )


def row_conservation(source: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """Row counts of a split's input and outputs, one row."""
    tagged = [
        part.select(F.lit(tag).alias("part"))
        for tag, part in (("input", source), ("train", train), ("val", val))
    ]
    counted = tagged[0].union(tagged[1]).union(tagged[2])
    return counted.agg(
        *[F.count_if(F.col("part") == tag).alias(f"{tag}_rows") for tag in ("input", "train", "val")]
    ).withColumn("conserved", F.col("train_rows") + F.col("val_rows") == F.col("input_rows"))


def check_conservation(source: DataFrame, train: DataFrame, val: DataFrame) -> dict:
    counts = row_conservation(source, train, val).first().asDict()
    if not counts["conserved"]:
        raise ValueError(f"split lost or repeated rows: {counts}")
    return counts


def steps_per_epoch(
    train: DataFrame,
    batch: int | None = None,
    micro_batch: int = 1,
    processes: int = 2,
    accumulation: int = 256,
) -> DataFrame:
    """Training steps per pass over the rows, at least one."""
    batch = batch or micro_batch * processes * accumulation
    return train.agg(
        F.count("*").alias("rows"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.count("*") / F.lit(batch))).alias("steps_per_epoch"),
    )
