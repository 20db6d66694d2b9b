"""Problem sets from the first source that can be read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import normalize_type
from tallyframe.operators.prepare import ALL_SUBSETS, require_subset
from tallyframe.session import constant


@dataclass(frozen=True)
class ProblemSource:
    """A data set laid out as ``<path>/<split>`` or ``<path>/<config>/<split>``."""

    name: str
    path: str
    format: str = "parquet"
    schema: T.StructType | None = None

    def read(self, spark: SparkSession, *parts: str) -> DataFrame:
        reader = spark.read.format(self.format).option("mode", "FAILFAST")
        if self.schema:
            reader = reader.schema(self.schema)
        elif "*" in parts:  # configs need not have the same columns
            reader = reader.option("mergeSchema", "true")
        return reader.load("/".join([self.path.rstrip("/"), *parts]))

    def read_split(self, spark: SparkSession, split: str) -> DataFrame:
        """The whole split; where only configs exist, all of them in one scan."""
        try:
            return self.read(spark, split)
        except AnalysisException:
            return self.read(spark, "*", split)

    def read_subset(self, spark: SparkSession, split: str, subset: str) -> DataFrame:
        """The config of that name if there is one, else the rows of that type."""
        config = constant(spark, normalize_type(F.lit(subset)))
        if config == ALL_SUBSETS:
            return self.read_split(spark, split)
        try:
            return self.read(spark, config, split)
        except AnalysisException:
            return require_subset(self.read_split(spark, split), subset)


def load_problems(
    spark: SparkSession, sources: Sequence[ProblemSource], split: str, subset: str = ALL_SUBSETS
) -> tuple[DataFrame, str]:
    """Problems and the name of the first source that gave them; lists every error if none did."""
    errors = []
    for source in sources:
        try:
            return source.read_subset(spark, split, subset), source.name
        except (AnalysisException, ValueError) as error:
            errors.append(f"{source.name}: {error}")
    raise ValueError("no source could be read\n" + "\n".join(errors))
