"""Scoring of generations as their files arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyframe.operators.scoring import score_samples
from tallyframe.session import shared_dir


def stream_scores(
    samples: DataFrame, examples: DataFrame, output: str, name: str = "scores", checkpoint: str | None = None, broadcast_bytes: int | None = None
) -> StreamingQuery:
    """Score all files present, then stop; a rerun to the same output goes on where the last one ended.

    ``samples`` is a stream of generations (``stream_jsonl``), ``examples`` a table. Each sample meets its problem in a
    join of the stream with the table; the result rows are appended to parquet files, every one exactly once, and
    can be read as a table at any time: reports and solved problems over all files so far come from there. Nothing
    is kept in memory between batches. Progress is kept by output path in the cluster's shared folder.
    """
    sizes = {} if broadcast_bytes is None else {"broadcast_bytes": broadcast_bytes}
    # Hot keys would have to be counted over the whole stream; adaptive execution does not split streams either.
    scored = score_samples(samples, examples, hot_rows=None, **sizes)
    place = hashlib.md5(output.rstrip("/").encode()).hexdigest()
    return (
        scored.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint or f"{shared_dir(samples.sparkSession)}/{name}-{place}")
        .trigger(availableNow=True)
        .start()
    )
