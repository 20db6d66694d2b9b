"""One table over many per-checkpoint folders, numbered by folder name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import file_system

# How names carry numbers, and the folders inside.
TRAILING = re.compile(r"^.+_(\d+)$")
STEP = re.compile(r"^global_step_(\d+)$")
MODEL_FOLDER, ACTOR_FOLDER = "huggingface", "actor"
_URI_HEAD = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/*"


def _folders(spark: SparkSession, parent: str) -> list[str]:
    """Names of the folders one level below, also of empty ones; a listing, whose size is their number."""
    fs, path = file_system(spark, parent)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def _has_folder(spark: SparkSession, path: str) -> bool:
    fs, path = file_system(spark, path)
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def _plain(spark: SparkSession, path: str) -> str:
    """A path as it is reported: without the scheme of local files."""
    return re.sub(r"^file:/*", "/", file_system(spark, path)[1].toString()).rstrip("/")


def _numbered(names: list[str], pattern: re.Pattern) -> list[tuple[int, str]]:
    return sorted((int(m[1]), name) for name in names if (m := pattern.search(name)))


def checkpoint_dirs(spark: SparkSession, parent: str) -> DataFrame:
    """``(checkpoint_num, name, model_path)`` of folders named ``<text>_<number>``, ascending.

    Folders without files are listed too. The model path is the ``huggingface`` folder inside, where
    there is one.
    """
    root = _plain(spark, parent)
    rows = []
    for number, name in _numbered(_folders(spark, parent), TRAILING):
        inner = f"/{MODEL_FOLDER}" if _has_folder(spark, f"{parent}/{name}/{MODEL_FOLDER}") else ""
        rows.append((number, name, f"{root}/{name}{inner}"))
    return spark.createDataFrame(rows, "checkpoint_num long, name string, model_path string").orderBy("checkpoint_num")


def step_dirs(spark: SparkSession, run_dir: str) -> DataFrame:
    """``(rl_step, actor_path)`` of folders ``global_step_<n>/actor``, ascending."""
    root = _plain(spark, run_dir)
    steps = _numbered(_folders(spark, run_dir), STEP)
    rows = [(n, f"{root}/{name}/{ACTOR_FOLDER}") for n, name in steps if _has_folder(spark, f"{run_dir}/{name}/{ACTOR_FOLDER}")]
    return spark.createDataFrame(rows, "rl_step long, actor_path string").orderBy("rl_step")


def read_checkpoints(
    spark: SparkSession, parent: str, schema: T.StructType, format: str = "json", files: str | None = None
) -> DataFrame:
    """Rows of all checkpoint folders with their ``checkpoint_num``; other folders are not read.

    ``files`` is a name pattern for folders that hold other files too. Folders that share a number
    are an error. One row per folder comes to the driver.
    """
    found = _numbered(_folders(spark, parent), TRAILING)
    if not found:
        raise ValueError(f"no checkpoint folders in {parent}")
    _refuse_shared([(number, name) for number, name in found], "checkpoint numbers")
    rows, folder = _read_folders(spark, parent, [(name,) for _, name in found], schema, format, files)
    return rows.withColumn("checkpoint_num", _number_of(folder, {(name,): n for n, name in found}))


def read_run_steps(
    spark: SparkSession,
    parent: str,
    schema: T.StructType,
    epochs: Sequence[int] | None = None,
    format: str = "json",
    files: str | None = None,
) -> DataFrame:
    """Rows of all ``<run>_<epoch>/global_step_<step>`` folders with ``sft_epoch`` and ``rl_step``.

    Epochs that are asked for but not there are left out, as are other folders. Two folders with one
    epoch and step are an error.
    """
    places: dict[tuple[str, str], tuple[int, int]] = {}
    for epoch, run in _numbered(_folders(spark, parent), TRAILING):
        if epochs is None or epoch in epochs:
            for step, name in _numbered(_folders(spark, f"{parent}/{run}"), STEP):
                places[run, name] = (epoch, step)
    if not places:
        raise ValueError(f"no runs with steps in {parent}")
    _refuse_shared([(number, "/".join(names)) for names, number in places.items()], "epochs and steps")
    rows, folder = _read_folders(spark, parent, list(places), schema, format, files)
    return rows.withColumns(
        {
            "sft_epoch": _number_of(folder, {names: epoch for names, (epoch, _) in places.items()}),
            "rl_step": _number_of(folder, {names: step for names, (_, step) in places.items()}),
        }
    )


def _refuse_shared(numbered: list[tuple], what: str) -> None:
    by_number: dict = {}
    for number, name in numbered:
        by_number.setdefault(number, []).append(name)
    shared = {number: names for number, names in by_number.items() if len(names) > 1}
    if shared:
        raise ValueError(f"{what} used by several folders: {shared}")


def _encoded(spark: SparkSession, path: str) -> str:
    """A path as file paths of rows spell it: without scheme and host, and with its characters encoded."""
    return file_system(spark, path)[1].toUri().getRawPath()


def _number_of(folder: Column, numbers: dict[tuple[str, ...], int]) -> Column:
    pairs = F.create_map(*[F.lit(x) for names, number in numbers.items() for x in ("/".join(names), number)])
    unknown = F.raise_error(F.concat(F.lit("row of an unlisted folder: "), F.coalesce(folder, F.lit("")))).cast("int")
    return F.coalesce(F.try_element_at(pairs, folder), unknown).cast("bigint")


def _read_folders(
    spark: SparkSession, parent: str, places: list[tuple[str, ...]], schema: T.StructType, format: str, files: str | None
) -> tuple[DataFrame, Column]:
    """Rows of the listed folders, and each row's folder as its names joined by ``/``."""
    base = parent.rstrip("/")
    reader = spark.read.format(format).schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    if files:
        reader = reader.option("pathGlobFilter", files)
    rows = reader.load([f"{base}/{'/'.join(names)}" for names in places])
    file_path = F.regexp_replace(F.col("_metadata.file_path"), _URI_HEAD, "/")
    start = len(_encoded(spark, base).rstrip("/")) + 2
    below = F.slice(F.split(F.substring(file_path, start, 1_000_000), "/"), 1, len(places[0]))
    known = {"/".join(_encoded(spark, f"{base}/{'/'.join(names)}").rsplit("/", len(names))[1:]): "/".join(names) for names in places}
    spelled = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return rows, F.try_element_at(spelled, F.array_join(below, "/"))
