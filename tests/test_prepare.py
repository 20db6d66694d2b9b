import pytest
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.operators import checkpoints, curate, prepare
from tallyframe.operators.order import column_order, first_rows, seeded_order


@pytest.fixture(scope="module")
def problems(spark):
    rows = [(0, "p0", "s0", "Level 1", "Algebra"), (1, "p1", "s1", None, " Counting & Probability"), (2, "p2", "s2", "Level 2", None)]
    return spark.createDataFrame(rows, "id long, problem string, solution string, level string, type string")


def test_examples_keep_nulls_and_fill_absent_columns(problems):
    rows = prepare.to_examples(problems).orderBy("id").collect()
    assert [(r.level, r.type) for r in rows] == [("Level 1", "Algebra"), (None, " Counting & Probability"), ("Level 2", None)]
    assert prepare.to_examples(problems).columns == schemas.EXAMPLES.names
    bare = prepare.to_examples(problems.drop("level", "type")).collect()
    assert {(r.level, r.type) for r in bare} == {("Unknown", "Unknown")}


def test_numbering_after_cap_and_shuffle(problems):
    capped = first_rows(column_order(problems, "id"), 2)
    rows = prepare.number_examples(seeded_order(capped, "id", 1)).collect()
    assert sorted(r.id for r in rows) == [0, 1] and {r.problem for r in rows} == {"p0", "p1"}


def test_subsets(problems):
    assert prepare.select_subset(problems, "all").count() == 3
    assert [r.id for r in prepare.select_subset(problems, "counting_and_probability").collect()] == [1]
    assert [r.id for r in prepare.require_subset(problems, " Counting & Probability ").collect()] == [1]
    with pytest.raises(ValueError, match=r"'topology' not found in types \['algebra', 'counting_and_probability'\]"):
        prepare.require_subset(problems, "topology")
    untyped = problems.drop("type")
    assert prepare.select_subset(untyped, " ALL").count() == 3
    with pytest.raises(ValueError, match="no 'type' column"):
        prepare.select_subset(untyped, "algebra")


def test_available_types_stop_at_twenty(spark):
    many = spark.range(30).select(F.concat(F.lit("T "), F.col("id").cast("string")).alias("type"))
    got = [r.type for r in prepare.available_types(many).collect()]
    assert got == sorted(f"t_{i}" for i in range(30))[:20]


def test_concat_configs(spark, problems):
    both = prepare.concat_configs([problems, problems.drop("level"), problems.limit(0)])
    assert both.count() == 6 and both.where("level IS NULL").count() == 4


@pytest.mark.parametrize("n", [0, 1, 3])
def test_replicate(problems, n):
    rows = prepare.replicate(problems, n).collect()
    assert sorted((r.id, r.sample_idx) for r in rows) == [(i, s) for i in range(3) for s in range(n)]


def test_flatten(spark):
    rows = [(5, [1, 2, 3], [("a", [1]), ("b", [])]), (6, [], []), (7, [9], [("c", [1, 2])])]
    nested = spark.createDataFrame(rows, schemas.NESTED_OUTPUTS).withColumn("level", F.lit("x"))
    flat = prepare.flatten_outputs(nested, ["level"])
    assert sorted(map(tuple, flat.collect())) == [(5, "x", 0, "a", 3, 1), (5, "x", 1, "b", 3, 0), (7, "x", 0, "c", 1, 2)]


def test_from_position(spark):
    rows = prepare.from_position(spark.range(7).withColumnRenamed("id", "position"), 3).orderBy("position").collect()
    assert [(r.problem_id, r.sample_idx) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]


def test_length_filter_edges(spark):
    rows = [(1, 10, 90), (2, 10, 91), (3, None, 100), (4, None, None), (5, 101, None)]
    df = spark.createDataFrame(rows, "id int, prompt_tokens long, output_tokens long")
    assert sorted(r.id for r in curate.within_length(df, 100).collect()) == [1, 3, 4]
    assert tuple(curate.length_filter_report(df, 100).first()) == (5, 3, 2, pytest.approx(60.0), pytest.approx(40.0))
    assert tuple(curate.length_filter_report(df.limit(0), 100).first()) == (0, 0, 0, 0.0, 0.0)
    assert sorted(r.id for r in curate.within_length(df.drop("prompt_tokens"), 90).collect()) == [1, 4, 5]


def test_required_columns(spark):
    df = spark.createDataFrame([("p", None), ("q", None)], "prompt string, generated_solution string")
    assert curate.require_columns(df, "prompt", "prompt") is df
    with pytest.raises(ValueError, match="generated_solution"):
        curate.require_columns(df)
    with pytest.raises(ValueError, match=r"missing columns \['answer'\].*prompt"):
        curate.require_columns(df, "prompt", "answer")
    with pytest.raises(ValueError, match="no rows"):
        curate.require_columns(df.limit(0))
    assert tuple(curate.missing_counts(df, "prompt", "generated_solution").first()) == (2, 0, 2)


def test_conservation(spark):
    df = spark.range(10)
    assert curate.check_conservation(df, df.where("id > 2"), df.where("id <= 2"))["conserved"]
    with pytest.raises(ValueError, match="lost or repeated"):
        curate.check_conservation(df, df.where("id > 2"), df.where("id < 2"))


@pytest.mark.parametrize(("rows", "batch", "steps"), [(0, 8, 1), (1, 8, 1), (8, 8, 1), (9, 8, 2), (1000, None, 2)])
def test_steps_per_epoch(spark, rows, batch, steps):
    assert tuple(curate.steps_per_epoch(spark.range(rows), batch).first()) == (rows, steps)


def test_checkpoint_numbers(spark):
    names = ["model_12", "a_b_007", "_5", "model_x", "model_5x", "5", "global_step_40", "x_global_step_40", "m_99999999999"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: (r.a, r.b) for r in df.select("n", checkpoints.trailing_number(F.col("n")).alias("a"), checkpoints.step_number(F.col("n")).alias("b")).collect()}
    assert got == {
        "model_12": (12, None), "a_b_007": (7, None), "_5": (None, None), "model_x": (None, None),
        "model_5x": (None, None), "5": (None, None), "global_step_40": (40, 40),
        "x_global_step_40": (40, None), "m_99999999999": (99999999999, None),
    }


def test_failed_checkpoints(spark):
    samples = spark.createDataFrame([(2, 10, True), (2, 30, False), (10, 5, True)], "checkpoint_num int, output_tokens long, is_correct boolean")
    manifest = spark.createDataFrame([(10,), (3,), (2,)], "checkpoint_num int")
    summary = checkpoints.with_failed(manifest, checkpoints.checkpoint_stats(samples))
    assert [(r.checkpoint_num, r.n, r.status, r.accuracy, r["mean"]) for r in summary.collect()] == [
        (2, 2, "OK", 0.5, 20.0), (3, 0, "FAILED", None, None), (10, 1, "OK", 1.0, 5.0),
    ]
    assert [tuple(r) for r in checkpoints.mean_length_curve(summary).collect()] == [(2, 20.0), (10, 5.0)]
    assert [tuple(r) for r in checkpoints.accuracy_curve(summary).collect()] == [(2, 50.0), (10, 100.0)]


def test_grid(spark):
    cells = [(1, 20, 0.25), (1, 100, 0.5), (10, 20, 0.125), (3, 40, 1.0)]
    accuracy = spark.createDataFrame(cells, "sft_epoch int, rl_step int, accuracy double")
    grid = checkpoints.accuracy_grid(accuracy)
    assert grid.columns == ["sft_epoch", "step_20", "step_40", "step_100"]
    assert [tuple(r) for r in grid.collect()] == [(1, 25.0, None, 50.0), (3, None, 100.0, None), (10, 12.5, None, None)]
    assert [tuple(r) for r in checkpoints.grid_text(grid).collect()][0] == (1, "25.0", "n/a", "50.0")
    assert [r.rl_step for r in checkpoints.distinct_steps(accuracy).collect()] == [20, 40, 100]
    assert [r.accuracy_pct for r in checkpoints.accuracy_series(accuracy).collect()] == [25.0, 50.0, 100.0, 12.5]


def test_step_ordinals_are_numeric(spark):
    manifest = spark.createDataFrame([("a", "100"), ("a", "20"), ("b", "3"), ("a", "9")], "run string, step string")
    got = {(r.run, r.step): r.ordinal for r in checkpoints.step_ordinals(manifest, ["run"], "step").collect()}
    assert got == {("a", "9"): 1, ("a", "20"): 2, ("a", "100"): 3, ("b", "3"): 1}
