"""From problem sets to examples, prompts and flat sample rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import math_prompt, normalize_type, token_count
from tallyframe.operators.order import RowOrder, with_position
from tallyframe.session import constant

ALL_SUBSETS = "all"


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant column where the table lacks it; nulls of a present column stay."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def to_examples(problems: DataFrame, id_col: str = "id") -> DataFrame:
    """Example rows with prompts; absent ``level`` and ``type`` columns read ``Unknown``."""
    for name in ("level", "type"):
        problems = with_default(problems, name, "Unknown")
    return problems.select(
        F.col(id_col).cast("bigint").alias("id"),
        "problem",
        "solution",
        "level",
        "type",
        math_prompt(F.col("problem")).alias("prompt"),
    )


def number_examples(order: RowOrder) -> DataFrame:
    """Example rows whose id is the position in the order (after a shuffle or a cap)."""
    return to_examples(with_position(order, "_position"), "_position")


def available_types(problems: DataFrame, limit: int = 20) -> DataFrame:
    """The first normalised types in code-point order; null types are left out."""
    return (
        problems.select(normalize_type(F.col("type")).alias("type"))
        .where(F.col("type").isNotNull())
        .distinct()
        .orderBy("type")
        .limit(limit)
    )


def select_subset(problems: DataFrame, subset: str = ALL_SUBSETS) -> DataFrame:
    """Problems of one category; ``all`` keeps every row."""
    wanted = normalize_type(F.lit(subset))
    if "type" not in problems.columns:
        if constant(problems.sparkSession, wanted) == ALL_SUBSETS:
            return problems
        raise ValueError("problem set has no 'type' column")
    return problems.where((wanted == ALL_SUBSETS) | (normalize_type(F.col("type")) == wanted))


def require_subset(problems: DataFrame, subset: str) -> DataFrame:
    """``select_subset`` that raises, naming the available types, where nothing is left."""
    chosen = select_subset(problems, subset)
    if chosen.isEmpty():
        known = [r["type"] for r in available_types(problems).collect()] if "type" in problems.columns else []
        raise ValueError(f"subset '{subset}' not found in types {known}")
    return chosen


def concat_configs(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables of one dataset; columns missing in some are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def replicate(df: DataFrame, n: int, name: str = "sample_idx") -> DataFrame:
    """Each row n times, numbered from 0."""
    if n < 1:
        return df.withColumn(name, F.lit(0)).limit(0)
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def flatten_outputs(nested: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (prompt, sample) from rows that hold an array of outputs."""
    return nested.select(
        "id",
        *carry,
        token_count(F.col("prompt_token_ids")).cast("bigint").alias("prompt_tokens"),
        F.posexplode("outputs").alias("sample_idx", "output"),
    ).select(
        "id",
        *carry,
        "sample_idx",
        F.col("output.text").alias("generated_solution"),
        "prompt_tokens",
        token_count(F.col("output.token_ids")).cast("bigint").alias("output_tokens"),
    )


def from_position(df: DataFrame, n: int, position: str = "position") -> DataFrame:
    """Ids of rows known only by their place in a run of n samples per problem."""
    pos = F.col(position).cast("bigint")
    return df.withColumn("problem_id", F.floor(pos / n).cast("bigint")).withColumn(
        "sample_idx", F.pmod(pos, F.lit(n)).cast("int")
    )


def prompt_response(df: DataFrame, prompt_key: str = "prompt", response_key: str = "generated_solution") -> DataFrame:
    """The two training columns under fixed names."""
    return df.select(F.col(prompt_key).alias("prompt"), F.col(response_key).alias("response"))
