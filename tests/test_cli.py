import pytest

from tallyframe import schemas
from tallyframe.__main__ import main
from tallyframe.sources.jsonl import read_jsonl, write_jsonl


@pytest.fixture
def files(spark, tmp_path):
    problems = spark.range(20).selectExpr(
        "id AS row_no", "concat('p', id) AS problem", "concat('\\\\boxed{', id, '}') AS solution",
        "'Level 1' AS level", "IF(id % 2 = 0, 'Algebra', 'Geometry') AS type",
    )
    problems.write.parquet(str(tmp_path / "problems/test"))
    return tmp_path


def test_from_problems_to_training_set(spark, files, capsys):
    at = lambda name: str(files / name)
    main(["prepare", "--source", at("none"), at("problems"), "--subset", "algebra", "--max-samples", "5", "--shuffle", "--output", at("e.jsonl")])
    examples = read_jsonl(spark, at("e.jsonl"), schemas.EXAMPLES)
    assert sorted(r.id for r in examples.collect()) == [0, 1, 2, 3, 4]
    assert {r.type for r in examples.collect()} == {"Algebra"}

    main(["prepare", "--source", at("problems"), "--keys", "row_no", "--max-samples", "6", "--output", at("all.jsonl")])
    examples = read_jsonl(spark, at("all.jsonl"), schemas.EXAMPLES)
    assert [r.problem for r in examples.orderBy("id").collect()] == [f"p{i}" for i in range(6)]

    generations = examples.selectExpr(
        "*", "concat('\\\\boxed{', IF(id < 3, id, -1), '}') AS generated_solution", "0 AS sample_idx",
        "7L AS prompt_tokens", "100 * id AS output_tokens",
    )
    write_jsonl(generations, at("g.jsonl"))
    main([
        "evaluate", "--generations", at("g.jsonl"), "--examples", at("all.jsonl"), "--model", "M", "--output-dir", at("out"),
        "--eval-dir", at("eval"), "--save-correct-jsonl", "--run-time", "2025-01-02T03:04:05",
    ])
    assert "accuracy 50.00% (3/6)" in capsys.readouterr().out

    main(["filter", "--input", at("out/m_test_20250102_030405.correct.jsonl"), "--max-tokens", "150"])
    filtered = at("out/m_test_20250102_030405.filtered0k.correct.jsonl")
    assert sorted(r.id for r in read_jsonl(spark, filtered, schemas.GENERATIONS).collect()) == [0, 1]

    write_jsonl(read_jsonl(spark, filtered, schemas.GENERATIONS).selectExpr("*", "'kept' AS note"), at("noted.jsonl"))
    main(["filter", "--input", at("noted.jsonl"), "--max-tokens", "2000"])
    assert {r.note for r in read_jsonl(spark, at("noted.filtered2k.jsonl")).collect()} == {"kept"}
    main(["prepare", "--source", at("problems"), "--max-samples", "7", "--output", at("as_they_stand.jsonl")])
    examples = read_jsonl(spark, at("as_they_stand.jsonl"), schemas.EXAMPLES)
    assert [r.problem for r in examples.orderBy("id").collect()] == [f"p{i}" for i in range(7)]
    main(["convert", "--input", at("noted.jsonl"), "--output-dir", at("in_order"), "--no-shuffle", "--val-ratio", "0.5", "--files", "2"])
    assert spark.read.parquet(at("in_order/val.parquet")).count() == 1

    main(["convert", "--input", filtered, "--output-dir", at("sft"), "--val-ratio", "0.5", "--files", "2"])
    assert spark.read.parquet(at("sft/train.parquet")).count() == 1
    assert spark.read.parquet(at("sft/val.parquet")).count() == 1


def test_sweeps(spark, files, capsys):
    at = lambda name: str(files / name)
    main(["prepare", "--source", at("problems"), "--keys", "row_no", "--output", at("e.jsonl")])
    examples = read_jsonl(spark, at("e.jsonl"), schemas.EXAMPLES)
    rows = examples.selectExpr("id", "solution AS generated_solution", "id + 1 AS output_tokens")
    write_jsonl(rows, at("sft/m_4/gen"))
    main(["sweep-lengths", "--checkpoint-dir", at("sft"), "--examples", at("e.jsonl"), "--files", "part-*", "--output-dir", at("s")])
    summary = spark.read.parquet(at("s/summary.parquet")).first()
    assert (summary.checkpoint_num, summary.n, summary.accuracy, summary["mean"]) == (4, 20, 1.0, 10.5)
    write_jsonl(rows, at("rl/r_3/global_step_20/gen"))
    main(["sweep-accuracy", "--base-dir", at("rl"), "--examples", at("e.jsonl"), "--num-gen", "2", "--files", "part-*", "--output-dir", at("r")])
    assert tuple(spark.read.parquet(at("r/grid.parquet")).first()) == (3, 50.0)
