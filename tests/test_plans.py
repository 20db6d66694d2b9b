import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from tallyframe import schemas
from tallyframe.operators.accuracy import accuracy_report, problem_verdicts
from tallyframe.operators.curate import within_length
from tallyframe.operators.scoring import score_samples
from tallyframe.plans.curate import filter_generations, make_training_set
from tallyframe.plans.evaluate import evaluate_generations
from tallyframe.plans.sweep import sweep_accuracy, sweep_checkpoint_dir, sweep_lengths, sweep_run_dirs
from tallyframe.sources.jsonl import read_jsonl, write_jsonl
from tallyframe.streaming.length_filter import stream_jsonl, stream_length_filter
from tallyframe.streaming.scoring import stream_scores

RUN_TS = datetime(2025, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def examples(spark):
    rows = [(i, f"p{i}", rf"\boxed{{{i}}}", f"Level {1 + i % 2}", "Algebra", f"prompt {i}") for i in range(10)]
    return spark.createDataFrame(rows, schemas.EXAMPLES)


@pytest.fixture(scope="module")
def generations(spark, examples):
    """Three samples per problem; odd problems are solved by their last sample only."""
    answer = F.when((F.col("id") % 2 == 1) & (F.col("sample_idx") == 2), F.col("id")).otherwise(-1)
    return (
        examples.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
        .withColumn("generated_solution", F.concat(F.lit("é \\boxed{"), answer.cast("string"), F.lit("}")))
        .withColumn("prompt_tokens", F.lit(10).cast("bigint"))
        .withColumn("output_tokens", F.col("id") * 100)
        .select(*schemas.GENERATIONS.names)
    )


def test_evaluation(spark, tmp_path, generations, examples):
    done = evaluate_generations(
        generations, examples, "A/Model-1", "test", RUN_TS, str(tmp_path / "out"), str(tmp_path / "eval"),
        source="files", save_correct=True,
    )
    assert done.results.columns == schemas.RESULTS.names and done.results.count() == 30
    assert (done.report.first().correct, done.report.first().total) == (5, 10)
    assert done.report_path.endswith("eval/a_model_1_20250102_030405.md")
    lines = [r.value for r in spark.read.text(done.report_path).collect()]
    assert lines == [
        "# MATH Evaluation Report",
        "- Model: `A/Model-1`",
        "- Dataset source: `files`",
        "- Split: `test`",
        "- Subset: `all`",
        "- Generated at: `2025-01-02T03:04:05`",
        "",
        "## Overall",
        "- Accuracy: **50.00%**",
        "- Correct: **5 / 10**",
        "- Avg output tokens: **450.0**",
        "- Avg prompt tokens: **10.0**",
        "- Parse Failures: **0** (0.00%)",
        "",
        "## Accuracy by Level",
        "| Level | Accuracy | Correct | Total |",
        "|---|---:|---:|---:|",
        "| Level 1 | 0.00% | 0 | 5 |",
        "| Level 2 | 100.00% | 5 | 5 |",
        "",
        "## Accuracy by Type",
        "| Type | Accuracy | Correct | Total |",
        "|---|---:|---:|---:|",
        "| Algebra | 50.00% | 5 | 10 |",
    ]
    kept = read_jsonl(spark, done.correct_path, schemas.GENERATIONS)
    assert sorted((r.id, r.sample_idx) for r in kept.collect()) == [(i, s) for i in range(1, 10, 2) for s in range(3)]


def test_filter_and_split(spark, tmp_path, generations):
    source = str(tmp_path / "g.correct.jsonl")
    write_jsonl(generations, source)
    counts = filter_generations(spark, source, 500)
    output = str(tmp_path / "g.filtered0k.correct.jsonl")
    assert counts == {"input": 30, "kept": 15, "dropped": 15, "output": output}
    kept = read_jsonl(spark, output, schemas.GENERATIONS)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, within_length(generations, 500).collect()))

    out = str(tmp_path / "sft")
    assert make_training_set(spark, output, out, ["id", "sample_idx"], files=3) == {"input": 15, "train": 14, "val": 1}
    both = spark.read.parquet(f"{out}/train.parquet").unionByName(spark.read.parquet(f"{out}/val.parquet"))
    assert both.count() == 15 and both.columns == sorted(schemas.GENERATIONS.names)
    with pytest.raises(ValueError, match="missing columns"):
        make_training_set(spark, output, str(tmp_path / "bad"), ["id", "sample_idx"], prompt_key="question")


def test_split_in_source_order(spark, tmp_path):
    source = str(tmp_path / "rows.jsonl")
    rows = spark.range(50).selectExpr("id AS line", "'p' AS prompt", "concat('g', id % 3) AS generated_solution")
    write_jsonl(rows.repartition(3), source)
    as_they_stand = [json.loads(x)["line"] for part in sorted(Path(source).glob("part-*")) for x in part.read_text().splitlines()]
    counts = make_training_set(spark, source, str(tmp_path / "sft"), ["id", "sample_idx"], 0.2, shuffle=False, files=2)
    assert counts == {"input": 50, "train": 40, "val": 10}
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "sft/val.parquet")).collect()) == sorted(as_they_stand[:10])
    # Without the usual keys the rows are shuffled by what they hold; equal ones may fall on both sides of a cut.
    counts = make_training_set(spark, source, str(tmp_path / "shuffled"), ["id", "sample_idx"], 0.0, files=2)
    assert counts == {"input": 50, "train": 50, "val": 0}


def test_filter_keeps_lines_as_they_are(spark, tmp_path):
    lines = ['{"x":1, "output_tokens": 5,"b":null}', '{"x":"1","prompt_tokens":3, "é": [1.50]}', "", "   ", '{"output_tokens": 900}', '{"y":{"k":2}}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines), encoding="utf-8")
    counts = filter_generations(spark, str(tmp_path / "in.jsonl"), 100, str(tmp_path / "out"))
    kept = [x for part in sorted((tmp_path / "out").glob("part-*")) for x in part.read_text(encoding="utf-8").splitlines()]
    assert kept == [lines[0], lines[1], lines[5]] and (counts["input"], counts["dropped"]) == (4, 1)
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\n{bad\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        filter_generations(spark, str(tmp_path / "bad.jsonl"), 100, str(tmp_path / "bad_out"))


def test_streams_to_two_outputs_are_independent(spark, tmp_path):
    schema = "id long, output_tokens long"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"id": i, "output_tokens": i}) for i in range(10)))
    kept = {}
    for limit in (2, 9, 2):
        rows = stream_jsonl(spark, str(tmp_path / "in"), T._parse_datatype_string(schema))
        stream_length_filter(rows, str(tmp_path / f"out{limit}"), limit).awaitTermination()
        kept[limit] = spark.read.schema(schema).json(str(tmp_path / f"out{limit}")).count()
    assert kept == {2: 3, 9: 10}


def test_sweeps(spark):
    samples = spark.createDataFrame([(1, 10, True), (1, 20, False)], "checkpoint_num int, output_tokens long, is_correct boolean")
    manifest = spark.createDataFrame([(1,), (2,)], "checkpoint_num int")
    sweep = sweep_lengths(samples, manifest)
    assert [r.status for r in sweep.summary.collect()] == ["OK", "FAILED"]
    assert [tuple(r) for r in sweep.mean_length.collect()] == [(1, 15.0)]
    runs = spark.createDataFrame([(1, 20, 0, True), (3, 40, 0, False)], "sft_epoch int, rl_step int, problem_id long, is_correct boolean")
    rl = sweep_accuracy(runs, 2)
    assert [tuple(r) for r in rl.grid.collect()] == [(1, 50.0, None), (3, None, 0.0)]
    assert [tuple(r) for r in rl.series.collect()] == [(1, 20, 50.0), (3, 40, 0.0)]


def test_streamed_filter_equals_batch(spark, tmp_path, generations):
    source, output = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    lines = [json.dumps(r.asDict()) for r in generations.orderBy("id", "sample_idx").collect()]
    (source / "a.jsonl").write_text("\n".join(lines[:12]))

    def run():
        rows = stream_jsonl(spark, str(source), schemas.GENERATIONS)
        stream_length_filter(rows, output, 500, checkpoint=str(tmp_path / "state")).awaitTermination()
        return sorted(map(repr, read_jsonl(spark, output, schemas.GENERATIONS).collect()))

    first = run()
    (source / "b.jsonl").write_text("\n".join(lines[12:]))
    both = run()
    assert set(first) < set(both)
    assert both == sorted(map(repr, within_length(generations, 500).collect()))


def test_sweeping_folders(spark, tmp_path, examples):
    """Two checkpoints and a folder without generations; four runs, one of them not asked for."""
    def samples(solved, length):
        return examples.selectExpr(
            "id", "0 AS sample_idx", f"concat('\\\\boxed{{', IF(id < {solved}, id, -1), '}}') AS generated_solution",
            "5L AS prompt_tokens", f"{length} + id AS output_tokens",
        )

    write_jsonl(samples(5, 100), str(tmp_path / "sft/m_1/out"))
    write_jsonl(samples(10, 50), str(tmp_path / "sft/m_2/out"))
    (tmp_path / "sft/m_3").mkdir()
    (tmp_path / "sft/m_3/log.txt").write_text("failed")
    sweep = sweep_checkpoint_dir(spark, str(tmp_path / "sft"), examples, files="part-*")
    assert [(r.checkpoint_num, r.n, r.accuracy, r["mean"], r.status) for r in sweep.summary.collect()] == [
        (1, 10, 0.5, 104.5, "OK"), (2, 10, 1.0, 54.5, "OK"), (3, 0, None, None, "FAILED"),
    ]
    assert sweep.histogram.groupBy("checkpoint_num").sum("n").orderBy("checkpoint_num").collect()[0][1] == 10

    for run, step, solved in (("r_1", 20, 5), ("r_1", 40, 10), ("r_3", 20, 1), ("r_9", 20, 10)):
        write_jsonl(samples(solved, 1).limit(8), str(tmp_path / f"rl/{run}/global_step_{step}/out"))
    (tmp_path / "rl/notes").mkdir()
    (tmp_path / "rl/notes/x.txt").write_text("-")
    rl = sweep_run_dirs(spark, str(tmp_path / "rl"), examples, num_gen=1, epochs=[1, 3, 5])
    got = {(r.sft_epoch, r.rl_step): r.problems for r in rl.accuracy.collect()}
    assert got == {(1, 20): 10, (1, 40): 10, (3, 20): 10}
    assert rl.grid.columns == ["sft_epoch", "step_20", "step_40"]
    solved = {tuple(r)[0]: tuple(r)[1:] for r in rl.grid.collect()}
    assert solved[1][1] == pytest.approx(80.0) and solved[3][1] is None
    with pytest.raises(ValueError, match="no runs"):
        sweep_run_dirs(spark, str(tmp_path / "rl"), examples, epochs=[7])


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": -1}])
def test_streamed_scores_equal_batch(spark, tmp_path, generations, examples, sizes):
    """Three files, one a batch, in two runs to the same output."""
    source, output = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    lines = [json.dumps(r.asDict()) for r in generations.orderBy("id", "sample_idx").collect()]
    cuts = [0, 5, 9, len(lines)]

    def run(*parts):
        for i in parts:
            (source / f"{i}.jsonl").write_text("\n".join(lines[cuts[i] : cuts[i + 1]]))
        rows = stream_jsonl(spark, str(source), schemas.GENERATIONS, files_per_batch=1)
        query = stream_scores(rows, examples, output, checkpoint=str(tmp_path / "state"), **sizes)
        query.awaitTermination()
        return query.lastProgress["batchId"], spark.read.parquet(output)

    batch, first = run(0, 1)
    assert batch == 1 and 0 < first.count() < len(lines)
    _, both = run(2)
    want = score_samples(generations, examples)
    assert sorted(map(repr, both.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    got = accuracy_report(problem_verdicts(both)).collect()
    assert got == accuracy_report(problem_verdicts(want)).collect()


def test_streamed_report_writes_files_of_bounded_size_in_three_batches(spark, tmp_path, monkeypatch):
    docs = "/root/testdata/sf0.001"
    want = entry.scored_report(spark, docs).collect()
    monkeypatch.setattr(entry, "STREAM_FILE_BYTES", 20_000, raising=False)
    monkeypatch.setattr(entry, "_run_dir", lambda spark, name: str(tmp_path / name))
    assert sorted(map(repr, entry.streamed_report(spark, docs).collect())) == sorted(map(repr, want))
    sizes = [file.stat().st_size for file in (tmp_path / "stream" / "in").glob("*.json")]
    batches = [file for file in (tmp_path / "stream" / "progress" / "commits").iterdir() if file.name.isdigit()]
    assert len(sizes) >= sum(sizes) / 40_000 > 6 and len(batches) == 3
