"""Equi-joins of a large table with a keyed table, safe against hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Size of a value: texts and binaries by their length, collections by all that is in them."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            inside = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + _bytes(x, kind.elementType))
        else:
            inside = F.size(value) * 16
        own = inside + 16
    elif isinstance(kind, T.MapType):
        own = _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        own = reduce(add, [_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(16))
    else:
        return F.lit(16).cast("bigint")
    return F.coalesce(own.cast("bigint"), F.lit(16).cast("bigint"))


def measure(keyed: DataFrame, on: Sequence[str], unique: bool = False) -> int:
    """Size of a table in bytes, from all values of its rows, in one job.

    With ``unique`` the same job finds the largest group of rows with one key, and raises if that
    is more than one row.
    """
    size = reduce(add, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in keyed.schema.fields])
    sized = keyed.select(*on, size.cast("bigint").alias("_size"))
    per_key = sized.groupBy(*on) if unique else sized
    counted = per_key.agg(F.count("*").alias("_n"), F.sum("_size").alias("_size"))
    total, most = counted.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.max("_n")).first()
    if unique and most and most > 1:
        raise ValueError(f"a value of {list(on)} occurs {most} times")
    return total


def keyed_join(
    large: DataFrame,
    keyed: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    unique: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Join ``large`` to ``keyed`` (``inner``, ``left`` or ``left_semi``).

    ``keyed`` is measured: up to ``broadcast_bytes`` it is broadcast and ``large`` is not shuffled.
    Beyond that, keys with more than ``hot_rows`` rows are split over several tasks: their large
    rows get a part number from ``spread_by`` (all columns by default) and their keyed row is
    repeated once per part. There are at most ``rows / hot_rows`` such keys, which bounds the
    hot-key table. None says that no key of ``large`` is hot. ``unique`` checks that no key of
    ``keyed`` occurs twice.
    """
    on = [on] if isinstance(on, str) else list(on)
    if measure(keyed, on, unique) <= broadcast_bytes:
        return large.join(F.broadcast(keyed), on, how)
    if hot_rows is None:
        return large.join(keyed, on, how)

    hot = (
        large.select(*on)
        .dropna()
        .groupBy(*on)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    )
    # The input partition spreads copies too, which agree in every column. Unlike a random number it
    # comes out the same when a lost task runs again.
    hashable = [f.name for f in large.schema.fields if not isinstance(f.dataType, T.MapType)]
    spread = F.xxhash64(F.spark_partition_id(), *(list(spread_by) or hashable))
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    # Rows without a key match nothing; negative part numbers only spread them over tasks.
    part = F.when(keyless, -1 - F.pmod(spread, F.lit(4096))).otherwise(
        F.pmod(spread, F.coalesce("_parts", F.lit(1)))
    )
    left = (
        large.join(F.broadcast(hot), on, "left").withColumn("_part", part.cast("int")).drop("_parts")
    )
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = (
        keyed.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    )
    return left.join(right, [*on, "_part"], how).drop("_part")
