"""From JSONL generations to a length-filtered, split training set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import strip
from tallyframe.operators.curate import length_filter_counts, require_columns, within_length
from tallyframe.operators.order import seeded_order, source_order, split_rows
from tallyframe.session import written
from tallyframe.sources.jsonl import naming_bad_lines, read_jsonl
from tallyframe.sources.sinks import filtered_path, write_split


TOKENS = "prompt_tokens double, output_tokens double"


def filter_generations(
    spark: SparkSession, path: str, max_tokens: int, output: str | None = None, mode: str = "errorifexists"
) -> dict:
    """Copy the lines within the token limit as they stand; counts come from the same pass over the input.

    Only the two token fields are parsed. Blank lines are left out; a malformed line fails with its file and number.
    """
    output = output or filtered_path(path, max_tokens)
    lines = spark.read.text(path)
    lines = lines.where(strip(lines["value"]) != "")
    rows = lines.select("value", F.from_json("value", TOKENS, {"mode": "FAILFAST"}).alias("tokens")).select("value", "tokens.*")
    seen = Observation("length_filter")
    counted = rows.observe(seen, *length_filter_counts(rows, max_tokens))
    with naming_bad_lines(spark, path, T.StructType.fromDDL(TOKENS)):
        within_length(counted, max_tokens).select("value").write.mode(mode).text(output)
    total, kept = seen.get["input"], seen.get["kept"]
    return {"input": total, "kept": kept, "dropped": total - kept, "output": output}


def make_training_set(
    spark: SparkSession,
    path: str,
    out_dir: str,
    keys: Sequence[str],
    val_ratio: float = 0.1,
    seed: int = 42,
    shuffle: bool = True,
    prompt_key: str = "prompt",
    response_key: str = "generated_solution",
    schema: T.StructType | None = None,
    files: int = 200,
    mode: str = "errorifexists",
) -> dict:
    """Split JSONL rows into ``train.parquet`` and ``val.parquet`` with exact counts.

    ``keys`` identify a row and seed its place; where they are not there, the prompt and the response do.
    Without shuffling rows come as they stand in the input. The rows are written as parquet first: the
    checks and the cut then read the columns they need only, and JSON is parsed once. A malformed line fails
    with its file and number; either both files are written or none.
    """
    with naming_bad_lines(spark, path, schema):
        lines = read_jsonl(spark, path, schema)
        if shuffle:
            rows = require_columns(written(lines, "training-rows"), prompt_key, response_key)
            order = seeded_order(rows, keys if set(keys) <= set(rows.columns) else [prompt_key, response_key], seed)
        else:
            order = source_order(lines, at_least=files)
            require_columns(order.plain, prompt_key, response_key)
    return write_split(split_rows(order, val_ratio), out_dir, files, mode)
