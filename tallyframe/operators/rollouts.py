"""Rewards and advantages of scored rollouts: several responses of one policy to each prompt.

These are columns and joins over a table of samples, for looking at what a trainer would see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import keyed_join

# Response length, the part of it in which the penalty grows, its size, and prompt tokens kept.
MAX_RESPONSE = 16384
OVERLONG_BUFFER = 4096
PENALTY = 1.0
MAX_PROMPT = 2048
# Added to a group's deviation, so that groups of nearly equal rewards do not blow up.
EPSILON = 1e-6

# Rewards are counted in millionths, so that their sums are whole numbers.
_UNIT = 10**6


def binary_reward(is_correct: Column) -> Column:
    """1 for a right answer, 0 for a wrong one or none."""
    return F.coalesce(is_correct, F.lit(False)).cast("int")


def overlong_penalty(
    length: Column, max_length: int = MAX_RESPONSE, buffer: int = OVERLONG_BUFFER, penalty: float = PENALTY
) -> Column:
    """0 up to ``max_length - buffer`` tokens, then falling in a line to ``-penalty`` at ``max_length`` and beyond; null counts as 0 tokens."""
    if not 0 < buffer <= max_length:
        raise ValueError("the buffer must be positive and within the length")
    over = F.coalesce(length, F.lit(0)) - F.lit(max_length - buffer)
    return F.greatest(F.lit(-float(penalty)), F.least(F.lit(0.0), -over / F.lit(float(buffer)) * F.lit(float(penalty))))


def left_truncate(tokens: Column, max_tokens: int = MAX_PROMPT) -> Column:
    """The last ``max_tokens`` tokens; null stays null."""
    if max_tokens < 0:
        raise ValueError("max_tokens must not be negative")
    return F.slice(tokens, F.greatest(F.size(tokens) - max_tokens, F.lit(0)) + 1, F.lit(max_tokens))


def group_moments(rollouts: DataFrame, prompt: list[str], reward: str = "reward") -> DataFrame:
    """Per prompt the number of rewards, their mean and sample deviation, 0 for a single one.

    Rewards are taken to six digits and summed as whole numbers, so moments do not depend on the order of rows. Rows without a
    reward do not count.
    """
    r = _units(F.col(reward))
    sums = rollouts.groupBy(*prompt).agg(F.count(reward).alias("n_rewards"), F.sum(r).alias("_s"), F.sum(r * r).alias("_q"))
    n, s, q = F.col("n_rewards"), F.col("_s"), F.col("_q")
    # n * sum of squares - square of the sum: exact where it fits 38 digits, so equal rewards deviate by 0.
    exact = F.try_subtract(F.try_multiply(q, n.cast("decimal(19,0)")), F.try_multiply(s, s)).cast("double")
    spread = F.greatest(F.coalesce(exact, q.cast("double") * n - s.cast("double") * s.cast("double")), F.lit(0.0))
    deviation = F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1))) / _UNIT).otherwise(0.0)
    mean = F.try_divide(s.cast("double"), n.cast("double")) / _UNIT
    return sums.select(*prompt, "n_rewards", mean.alias("mean_reward"), deviation.alias("std_reward"))


def _units(reward: Column) -> Column:
    return F.round(reward.cast("double") * _UNIT).cast("decimal(18,0)")


def group_advantages(rollouts: DataFrame, prompt: str | list[str], reward: str = "reward", **sizes: int) -> DataFrame:
    """All rows with ``advantage``: how far a reward lies from its prompt's mean, in deviations of the prompt's rewards.

    A prompt's only reward has advantage 0; rows without a reward have none. Rewards become one row per prompt by
    partial sums, which are joined back: broadcast if they are small, else with hot prompts split over tasks.
    """
    prompt = [prompt] if isinstance(prompt, str) else list(prompt)
    moments = group_moments(rollouts.where(" AND ".join(f"`{c}` IS NOT NULL" for c in prompt)), prompt, reward)
    joined = keyed_join(rollouts, moments, prompt, "left", **sizes)
    off = _units(F.col(reward)).cast("double") / _UNIT - F.col("mean_reward")
    advantage = F.when(F.col("n_rewards") > 1, off / (F.col("std_reward") + EPSILON)).otherwise(F.col(reward).cast("double") * 0.0)
    return joined.withColumn("advantage", advantage).drop("n_rewards", "mean_reward", "std_reward")
