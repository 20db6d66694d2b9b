"""JSON lines: one object per line, blank lines skipped, nulls kept on write."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import strip
from tallyframe.operators.joins import keyed_join

_BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Rows of JSONL files; a malformed line fails the query with its text.

    Pass a schema for large inputs. Without one Spark reads the files once more to infer it. Within
    ``naming_bad_lines`` the failure names the file and the line as well.
    """
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines with their file, block and place; places count up within a block, as one task reads it."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines that are not blank, with their ``row``; its field for malformed records is filled for those."""
    target = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    row = F.from_json("value", target, {"columnNameOfCorruptRecord": _BAD})
    return lines.where(strip(F.col("value")) != "").withColumn("row", row)


def bad_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """(file, line_no, line) of malformed lines; lines count from 1 within a file, blank ones too.

    A line's number is its place in its block plus the lines of the file's blocks before, which one
    pass counts without parsing anything. Only a row per block meets in a task.
    """
    lines = _lines(spark, path)
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("offset"))
    bad = _parsed(lines, schema or T.StructType([])).where(F.col(f"row.{_BAD}").isNotNull()).drop("row")
    found = keyed_join(bad, offsets, ["file", "block"], spread_by=["place"])
    return found.select("file", (F.col("place") + F.col("offset")).alias("line_no"), F.col("value").alias("line"))


def read_jsonl_checked(
    spark: SparkSession, path: str | list[str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and malformed lines with their file and line number, instead of a failure."""
    parsed = _parsed(_lines(spark, path), schema)
    good = parsed.where(F.col(f"row.{_BAD}").isNull()).select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in schema.fields])
    return good, bad_lines(spark, path, schema)


@contextmanager
def naming_bad_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> Iterator[None]:
    """If a job inside fails on a malformed line of ``path``, raise an error that names the first one's file and line.

    The lines are counted only then, so a run without a malformed line pays nothing.
    """
    try:
        yield
    except Exception as error:  # Spark's own, or the JVM's as it stands
        if "MALFORMED_RECORD" not in str(error):
            raise
        first = bad_lines(spark, path, schema).orderBy("file", "line_no").first()
        if first is None:
            raise
        raise ValueError(f"Malformed line {first['line_no']} of {first['file']}: {first['line'][:500]}") from error


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
