"""Output names and parquet sinks."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import clock_time, run_stamp, slug
from tallyframe.operators.order import Split, in_order
from tallyframe.session import constant, file_system


def run_name(spark: SparkSession, model: str, run_ts: datetime, split: str | None = None) -> str:
    """``<model slug>[_<split>]_<stamp>``; the time is an argument, so a rerun agrees."""
    parts = [slug(F.lit(model)), *([F.lit(split)] if split else []), run_stamp(clock_time(run_ts))]
    return constant(spark, F.concat_ws("_", *parts))


def filtered_path(path: str, max_tokens: int) -> str:
    """Output path of the length filter, next to its input; ``.correct.jsonl`` endings stay."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    ending = ".correct.jsonl" if name.endswith(".correct.jsonl") else ".jsonl"
    stem = name.removesuffix(ending)
    if stem == name and "." in name[1:]:
        stem = name[: name.rindex(".")]
    return f"{folder}{slash}{stem}.filtered{max_tokens // 1000}k{ending}"


def write_if_absent(df: DataFrame, path: str) -> None:
    """Write parquet unless the path exists; an existing one is left alone and nothing is read."""
    df.write.mode("ignore").parquet(path)


def write_tagged(
    df: DataFrame, base: str, model: str, split: str, run_ts: datetime, mode: str = "append"
) -> None:
    """Collect runs in one parquet table, partitioned by model slug, split and run stamp."""
    df.select(
        "*",
        slug(F.lit(model)).alias("model_slug"),
        F.lit(split).alias("split"),
        run_stamp(clock_time(run_ts)).alias("run_ts"),
    ).write.mode(mode).partitionBy("model_slug", "split", "run_ts").parquet(base)


def write_split(split: Split, out_dir: str, files: int = 200, mode: str = "errorifexists") -> dict:
    """Write ``train.parquet`` and ``val.parquet`` in row order, both or neither.

    Both are written to a folder of their own in ``out_dir`` first, and rows are counted meanwhile. Only if each has
    the rows that it shall have are they moved to their places; if anything fails before that, or the second move does, none is
    there and what was there before still is. ``mode`` is ``errorifexists`` or ``overwrite``. ``files`` is
    the part file count of a full table; both outputs share that layout.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"a split cannot be written with mode '{mode}'")
    spark, out_dir = split.train.rows.sparkSession, out_dir.rstrip("/")
    staging = f"{out_dir}/.split-{uuid.uuid4().hex}"
    fs, folder = file_system(spark, staging)
    places = {part: file_system(spark, f"{out_dir}/{part}.parquet")[1] for part in ("train", "val")}
    if mode == "errorifexists" and (there := [str(p) for p in places.values() if fs.exists(p)]):
        raise ValueError(f"{there} exist already")
    counts = {"input": split.n_rows}
    try:
        for part, order in (("train", split.train), ("val", split.val)):
            seen = Observation(part)
            rows = in_order(order, files).observe(seen, F.count(F.lit(1)).alias("rows"))
            rows.write.parquet(f"{staging}/{part}.parquet")
            counts[part] = seen.get["rows"]
        if (counts["train"], counts["val"]) != (split.n_rows - split.n_val, split.n_val):
            raise ValueError(f"split lost or repeated rows: {counts}")
        _publish(fs, {file_system(spark, f"{staging}/{part}.parquet")[1]: place for part, place in places.items()}, folder)
    finally:
        fs.delete(folder, True)
    return counts


def _publish(fs, moves: dict, folder) -> None:
    """Move all folders to their places; if a move fails, put everything back."""
    done = []
    try:
        for source, place in moves.items():
            if fs.exists(place):
                old = place.suffix("-before-" + folder.getName().removeprefix(".split-"))
                _move(fs, place, old)
                done.append((old, place))
            _move(fs, source, place)
            done.append((place, source))
    except Exception:
        for there, back in reversed(done):
            _move(fs, there, back)
        raise
    for there, back in done:
        if there.getName() != back.getName():
            fs.delete(there, True)


def _move(fs, source, place) -> None:
    if not fs.rename(source, place):
        raise OSError(f"cannot move {source} to {place}")
