import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import schemas
from tallyframe.operators.order import seeded_order, split_rows
from tallyframe.session import remove_written, shared_dir, written
from tallyframe.sources import sinks
from tallyframe.sources.checkpoint_dirs import checkpoint_dirs, read_checkpoints, read_run_steps, step_dirs
from tallyframe.sources.jsonl import bad_lines, naming_bad_lines, read_jsonl, read_jsonl_checked, write_jsonl
from tallyframe.sources.problems import ProblemSource, load_problems

ROW = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
RUN_TS = datetime(2025, 1, 2, 3, 4, 5)


def test_jsonl_skips_blank_lines_and_keeps_nulls(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "é"}\n\n   \t\n{"a": null}\n{"b": "z", "c": 5}\n', encoding="utf-8")
    assert sorted(map(repr, map(tuple, read_jsonl(spark, str(tmp_path), ROW).collect()))) == ["(1, 'é')", "(None, 'z')", "(None, None)"]
    assert read_jsonl(spark, str(tmp_path)).columns == ["a", "b", "c"]
    good, bad = read_jsonl_checked(spark, str(tmp_path), ROW)
    assert good.count() == 3 and bad.count() == 0


def test_malformed_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        read_jsonl(spark, str(tmp_path), ROW).collect()
    good, bad = read_jsonl_checked(spark, str(tmp_path), ROW)
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert [(r.file.endswith("x.jsonl"), r.line) for r in bad.collect()] == [(True, "{bad")]


def test_jsonl_sink(spark, tmp_path):
    out = str(tmp_path / "out.jsonl")
    write_jsonl(spark.createDataFrame([(1, "é\n"), (None, None)], ROW), out)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out.jsonl").glob("part-*"))
    assert sorted(text.splitlines()) == ['{"a":1,"b":"é\\n"}', '{"a":null,"b":null}']
    with pytest.raises(Exception, match="exist"):
        write_jsonl(spark.range(1), out)
    write_jsonl(spark.range(1), out, mode="overwrite")
    assert read_jsonl(spark, out).columns == ["id"]


@pytest.fixture
def dataset(spark, tmp_path):
    """Two configs of one data set, one without a level column."""
    for config, rows in {"algebra": [("p0", "s0", "Algebra")], "geometry": [("p1", "s1", "Geometry")]}.items():
        df = spark.createDataFrame(rows, "problem string, solution string, type string")
        df = df.withColumn("level", F.lit("Level 1")) if config == "algebra" else df
        df.write.parquet(str(tmp_path / "by_config" / config / "test"))
    whole = spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "by_config" / "*" / "test"))
    whole.write.parquet(str(tmp_path / "whole" / "test"))
    return tmp_path


def test_source_failover(spark, dataset):
    missing = ProblemSource("gone", str(dataset / "nowhere"))
    whole = ProblemSource("whole", str(dataset / "whole"))
    configs = ProblemSource("configs", str(dataset / "by_config"))
    df, name = load_problems(spark, [missing, whole, configs], "test")
    assert (name, df.count()) == ("whole", 2)
    df, name = load_problems(spark, [missing, configs], "test", "ALL ")
    assert (name, df.count(), df.where("level IS NULL").count()) == ("configs", 2, 1)
    for source in (whole, configs):
        df, name = load_problems(spark, [missing, source], "test", "Geometry")
        assert (name, [r.problem for r in df.collect()]) == (source.name, ["p1"])
    with pytest.raises(ValueError) as error:
        load_problems(spark, [missing, whole], "test", "topology")
    assert "gone: " in str(error.value) and "topology" in str(error.value) and "['algebra', 'geometry']" in str(error.value)
    with pytest.raises(ValueError, match="whole"):
        load_problems(spark, [whole], "train")


def test_checkpoint_folders(spark, tmp_path):
    for path in ("m_10/huggingface/config.json", "m_10/log.txt", "m_2/x.json", "other/y.json", "m_x/z.json", "top_3"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("{}")
    got = [(r.checkpoint_num, r.name, r.model_path.removeprefix("file:")) for r in checkpoint_dirs(spark, str(tmp_path)).collect()]
    assert got == [(2, "m_2", f"{tmp_path}/m_2"), (10, "m_10", f"{tmp_path}/m_10/huggingface")]


def test_step_folders(spark, tmp_path):
    for path in ("global_step_100/actor/a.pt", "global_step_100/actor/b.pt", "global_step_20/actor/huggingface/c", "global_step_40/other/x", "step_60/actor/y"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
    got = [(r.rl_step, r.actor_path.removeprefix("file:")) for r in step_dirs(spark, f"file://{tmp_path}/").collect()]
    assert got == [(20, f"{tmp_path}/global_step_20/actor"), (100, f"{tmp_path}/global_step_100/actor")]


def test_reading_checkpoints(spark, tmp_path):
    for folder, values in {"run_1": [1, 2], "run_12": [3], "junk": ["x"]}.items():
        (tmp_path / folder).mkdir()
        text = "\n".join(json.dumps({"a": v}) if folder != "junk" else "{broken" for v in values)
        (tmp_path / folder / "part.jsonl").write_text(text)
    got = read_checkpoints(spark, str(tmp_path), ROW).select("a", "checkpoint_num").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 12)]
    (tmp_path / "again_12").mkdir()
    (tmp_path / "again_12" / "part.jsonl").write_text("{}")
    with pytest.raises(ValueError, match="again_12"):
        read_checkpoints(spark, str(tmp_path), ROW)
    with pytest.raises(ValueError, match="no checkpoint folders"):
        read_checkpoints(spark, str(tmp_path / "junk"), ROW)


def test_checkpoint_folders_that_hold_nothing_are_listed(spark, tmp_path):
    parent = tmp_path / "a model m_5 x" / "runs"
    for name, text in {"m_1": '{"a": 1}', "m_2": "", "m_3": None}.items():
        (parent / name / "runs").mkdir(parents=True)
        if text is not None:
            (parent / name / "runs" / "é part.jsonl").write_text(text)
    assert [r.checkpoint_num for r in checkpoint_dirs(spark, str(parent)).collect()] == [1, 2, 3]
    assert [tuple(r) for r in read_checkpoints(spark, str(parent), ROW).select("a", "checkpoint_num").collect()] == [(1, 1)]
    assert [tuple(r) for r in read_checkpoints(spark, f"file://{parent}/".replace(" ", " "), ROW).select("checkpoint_num").collect()] == [(1,)]


def test_reading_runs(spark, tmp_path):
    for run, step, values in (("a_1", 20, [1, 2]), ("a_1", 40, [3]), ("b_3", 20, []), ("c_5", 20, [4])):
        folder = tmp_path / run / f"global_step_{step}" / "gen é"
        folder.mkdir(parents=True)
        (folder / "x y.jsonl").write_text("\n".join(json.dumps({"a": v}) for v in values))
    (tmp_path / "a_1" / "other").mkdir()
    got = read_run_steps(spark, str(tmp_path), ROW, epochs=[1, 3, 7]).select("a", "sft_epoch", "rl_step").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 20), (2, 1, 20), (3, 1, 40)]
    (tmp_path / "z_1" / "global_step_20").mkdir(parents=True)
    with pytest.raises(ValueError, match="z_1/global_step_20"):
        read_run_steps(spark, str(tmp_path), ROW)


def test_written_tables_can_be_removed(spark):
    remove_written(spark)
    table = written(spark.range(3), "gone")
    assert table.count() == 3 and remove_written(spark) == 1 and remove_written(spark) == 0


def test_names(spark):
    assert sinks.run_name(spark, "Qwen/Qwen2.5-Math-1.5B", RUN_TS, "test") == "qwen_qwen2_5_math_1_5b_test_20250102_030405"
    assert sinks.run_name(spark, "m", RUN_TS) == "m_20250102_030405"
    assert sinks.filtered_path("o/x.correct.jsonl", 16000) == "o/x.filtered16k.correct.jsonl"
    assert sinks.filtered_path("/o/x.jsonl", 16384) == "/o/x.filtered16k.jsonl"
    assert sinks.filtered_path("x.json", 999) == "x.filtered0k.jsonl"
    assert sinks.filtered_path("x", 2000) == "x.filtered2k.jsonl"


def test_write_if_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_if_absent(spark.range(3), path)
    sinks.write_if_absent(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3


def test_tagged_table(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.write_tagged(spark.range(2), path, "A/B", "test", RUN_TS)
    sinks.write_tagged(spark.range(3), path, "A/C", "train", RUN_TS)
    counts = spark.read.parquet(path).groupBy("model_slug", "split", "run_ts").count().collect()
    assert sorted(map(tuple, counts)) == [("a_b", "test", "20250102_030405", 2), ("a_c", "train", "20250102_030405", 3)]


def test_split_files(spark, tmp_path):
    rows = spark.range(1000).withColumn("t", F.col("id").cast("string"))
    counts = sinks.write_split(split_rows(seeded_order(rows, "id"), 0.1), str(tmp_path), files=4)
    assert counts == {"input": 1000, "train": 900, "val": 100}
    train, val = (spark.read.parquet(str(tmp_path / f"{p}.parquet")) for p in ("train", "val"))
    assert train.columns == ["id", "t"]
    assert sorted(r.id for r in train.union(val).collect()) == list(range(1000))


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_generation_schema_roundtrip(spark, tmp_path):
    row = (1, "p", "s", None, "t", "q", "g", 0, 5, None)
    write_jsonl(spark.createDataFrame([row], schemas.GENERATIONS), str(tmp_path / "g"))
    assert tuple(read_jsonl(spark, str(tmp_path / "g"), schemas.GENERATIONS).first()) == row


@pytest.mark.parametrize("splits", [1, 8])
def test_malformed_lines_are_named_by_file_and_number(spark, tmp_path, splits):
    """Blank lines count, long lines cross blocks, and the numbers do not depend on how files are split."""
    lines = [json.dumps({"a": i, "b": "x" * (i * 37 % 400)}) for i in range(900)]
    for i in (0, 311, 640, 899):
        lines[i] = "{bad" + "y" * i
    lines[5] = lines[312] = ""
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text('{"a": 1}\n\n   \n{"a": "no number"}')
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    settings = {"spark.sql.files.maxPartitionBytes": str(size // splits + 1), "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        good, bad = read_jsonl_checked(spark, str(tmp_path), ROW)
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line[:5]) for r in bad.collect())
        assert got == [("one.jsonl", n, "{bady"[: 4 + (n > 1)]) for n in (1, 312, 641, 900)] + [("two.jsonl", 4, '{"a":')]
        assert good.count() == 900 - 4 - 2 + 1
        with pytest.raises(ValueError, match=r"Malformed line 1 of .*one\.jsonl: \{bad"):
            with naming_bad_lines(spark, str(tmp_path), ROW):
                read_jsonl(spark, str(tmp_path), ROW).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_other_errors_are_left_alone(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    with pytest.raises(ZeroDivisionError):
        with naming_bad_lines(spark, str(tmp_path), ROW):
            raise ZeroDivisionError
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        with naming_bad_lines(spark, str(tmp_path), ROW):
            read_jsonl(spark, str(tmp_path), ROW).selectExpr("a / 0").collect()
    assert bad_lines(spark, str(tmp_path)).collect() == []


@pytest.fixture
def split(spark):
    rows = spark.range(200).withColumn("t", F.col("id").cast("string"))
    return split_rows(seeded_order(rows, "id"), 0.1)


def names_in(folder):
    return sorted(f.name for f in folder.iterdir() if not f.name.endswith(".crc"))


def test_a_split_is_written_whole_or_not_at_all(spark, tmp_path, split, monkeypatch):
    from dataclasses import replace

    failing = split.val.rows.withColumn("t", F.raise_error(F.lit("val cannot be written")).cast("string"))
    with pytest.raises(Exception, match="val cannot be written"):
        sinks.write_split(replace(split, val=replace(split.val, rows=failing)), str(tmp_path), files=2)
    assert names_in(tmp_path) == []
    with pytest.raises(ValueError, match="lost or repeated"):
        sinks.write_split(replace(split, n_val=21), str(tmp_path), files=2)
    assert names_in(tmp_path) == []

    sinks.write_split(split, str(tmp_path), files=2)
    assert names_in(tmp_path) == ["train.parquet", "val.parquet"]
    with pytest.raises(ValueError, match="exist already"):
        sinks.write_split(split, str(tmp_path), files=2)
    with pytest.raises(ValueError, match="mode 'append'"):
        sinks.write_split(split, str(tmp_path), files=2, mode="append")


def test_an_overwritten_split_comes_back_if_the_second_move_fails(spark, tmp_path, split, monkeypatch):
    sinks.write_split(split, str(tmp_path), files=2)
    other = split_rows(seeded_order(spark.range(50).withColumn("t", F.lit("new")), "id"), 0.5)
    move, moves = sinks._move, []

    def breaks(fs, source, place):
        moves.append(place.getName())
        if len(moves) == 4:
            raise OSError("disk is gone")
        move(fs, source, place)

    monkeypatch.setattr(sinks, "_move", breaks)
    with pytest.raises(OSError, match="disk is gone"):
        sinks.write_split(other, str(tmp_path), files=2, mode="overwrite")
    assert names_in(tmp_path) == ["train.parquet", "val.parquet"]
    assert [spark.read.parquet(str(tmp_path / f"{p}.parquet")).count() for p in ("train", "val")] == [180, 20]
    monkeypatch.setattr(sinks, "_move", move)
    assert sinks.write_split(other, str(tmp_path), files=2, mode="overwrite") == {"input": 50, "train": 25, "val": 25}
    assert names_in(tmp_path) == ["train.parquet", "val.parquet"]
    assert spark.read.parquet(str(tmp_path / "val.parquet")).where("t = 'new'").count() == 25
