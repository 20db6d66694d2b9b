"""The length filter over JSONL files as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyframe.operators.curate import within_length
from tallyframe.session import shared_dir


def stream_jsonl(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_length_filter(
    rows: DataFrame, output: str, max_tokens: int, name: str = "length_filter", checkpoint: str | None = None
) -> StreamingQuery:
    """Filter all files present, then stop; a rerun to the same output goes on where the last one ended.

    Progress is kept in the cluster's shared folder, in a folder of its own for each output, so a
    restart on other machines finds it and another output starts from the beginning.
    """
    place = hashlib.md5(output.rstrip("/").encode()).hexdigest()
    return (
        within_length(rows, max_tokens)
        .writeStream.format("json")
        .option("ignoreNullFields", "false")
        .option("path", output)
        .option("checkpointLocation", checkpoint or f"{shared_dir(rows.sparkSession)}/{name}-{place}")
        .trigger(availableNow=True)
        .start()
    )
