from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import scoring
from tallyframe.operators.accuracy import (
    accuracy_by,
    accuracy_report,
    overall,
    parse_failures,
    pass_at_1,
    problem_verdicts,
    problem_verdicts_of,
    row_accuracy,
)
from tallyframe.operators.joins import keyed_join

EXAMPLES = [
    (0, r"\boxed{4}", "Level 1", "Algebra"),
    (1, r"\boxed{\frac{1}{2}}", "Level 2", None),
    (2, "it is 7", "Level 1", "Geometry"),
    (3, r"\boxed{9}", "Level 3", "Geometry"),
]
OUTPUTS = [
    (0, 0, r"so \boxed{4.0}", 10, 100),
    (0, 1, r"so \boxed{5}", 10, 200),
    (1, 0, r"\boxed{0.5}", 20, 50),
    (1, 1, "no idea", 20, 60),
    (2, 0, "maybe 8", 30, 70),
    (9, 0, r"\boxed{1}", 99, 99),
]


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(EXAMPLES, "id long, solution string, level string, type string")


@pytest.fixture(scope="module")
def outputs(spark):
    return spark.createDataFrame(
        OUTPUTS, "id long, sample_idx int, generated_solution string, prompt_tokens long, output_tokens long"
    )


SALTED = {"broadcast_bytes": -1, "hot_rows": 1}


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": -1}, SALTED])
def test_score_samples(outputs, examples, sizes):
    got = scoring.score_samples(outputs, examples, **sizes).orderBy("id", "sample_idx").collect()
    assert [(r.id, r.sample_idx, r.is_correct, r.match_type) for r in got] == [
        (0, 0, True, "numeric_equiv"),
        (0, 1, False, "different"),
        (1, 0, True, "numeric_equiv"),
        (1, 1, False, "parse_failure"),
        (2, 0, False, "different"),
    ]
    assert [(r.generated_answer, r.ground_truth_answer) for r in got][:4] == [
        ("4.0", "4"), ("5", "4"), ("0.5", r"\frac{1}{2}"), ("no idea", r"\frac{1}{2}")
    ]
    assert [r.type for r in got] == ["Algebra", "Algebra", None, None, "Geometry"]


def test_single_label(outputs, examples):
    labels = {r.match_type for r in scoring.score_samples(outputs, examples, single_label=True).collect()}
    assert labels == {"sympy_equiv", "parse_failure"}


def test_defaults_for_missing_columns(spark, outputs, examples):
    got = scoring.score_samples(
        outputs.select("id", "generated_solution").where("id = 2"), examples.drop("level", "type")
    ).first()
    assert (got.sample_idx, got.level, got.type, got.output_tokens, got.prompt_tokens) == (0, "Unknown", "Unknown", 0, 0)


def test_repeated_example_id_raises(outputs, examples):
    twice = examples.union(examples.where("id = 1"))
    for build in (scoring.join_examples, scoring.score_samples):
        with pytest.raises(ValueError, match="occurs 2 times"):
            build(outputs, twice)


def test_report(outputs, examples):
    results = scoring.score_samples(outputs, examples)
    verdicts = problem_verdicts(results)
    row = overall(verdicts).first().asDict()
    assert row == {
        "accuracy": 2 / 3, "correct": 2, "total": 3, "total_samples": 5, "parse_failures": 1,
        "avg_output_tokens": 96.0, "avg_prompt_tokens": 18.0,
    }
    assert [tuple(r) for r in accuracy_by(verdicts, "level").collect()] == [("Level 1", 1, 2, 0.5), ("Level 2", 1, 1, 1.0)]
    report = [(r.section, r.key, r.correct, r.total, r.accuracy) for r in accuracy_report(verdicts).collect()]
    assert report == [
        ("overall", None, 2, 3, 2 / 3),
        ("level", "Level 1", 1, 2, 0.5),
        ("level", "Level 2", 1, 1, 1.0),
        ("type", None, 1, 1, 1.0),
        ("type", "Algebra", 1, 1, 1.0),
        ("type", "Geometry", 0, 1, 0.0),
    ]
    failures = parse_failures(results).first()
    assert tuple(failures) == (5, 1, 0.2)


def test_report_adds_up(outputs, examples):
    report = accuracy_report(problem_verdicts(scoring.score_samples(outputs, examples))).collect()
    for section in ("level", "type"):
        parts = [r for r in report if r.section == section]
        assert sum(r.total for r in parts) == report[0].total
        assert sum(r.correct for r in parts) == report[0].correct


def test_empty_report(outputs, examples):
    verdicts = problem_verdicts(scoring.score_samples(outputs.where("id > 100"), examples))
    for rows in (accuracy_report(verdicts).collect(), overall(verdicts).collect()):
        assert len(rows) == 1
        assert (rows[0].accuracy, rows[0].correct, rows[0].total, rows[0].total_samples) == (0.0, 0, 0, 0)
        assert rows[0].avg_output_tokens == 0.0


def test_verdicts_before_or_after_the_join(outputs, examples):
    results = scoring.score_samples(outputs, examples)
    judged = results.select("id", "sample_idx", "is_correct", "match_type", "output_tokens", "prompt_tokens")
    a = problem_verdicts(results).collect()
    b = problem_verdicts_of(judged, examples).select(problem_verdicts(results).columns).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("sizes", [{}, SALTED])
def test_solved_and_correct_rows(outputs, examples, sizes):
    results = scoring.score_samples(outputs, examples)
    solved = scoring.solved_rows(outputs, results, **sizes).select("id", "sample_idx").collect()
    assert sorted(map(tuple, solved)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    right = scoring.correct_rows(outputs, results, **sizes).select("id", "sample_idx").collect()
    assert sorted(map(tuple, right)) == [(0, 0), (1, 0)]


def test_verifier_sees_each_pair_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def verifier(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
        import uuid

        (log / uuid.uuid4().hex).write_text("".join(f"{p}|{g}\n" for p, g in zip(pred, gold)))
        return pd.DataFrame({"is_correct": pred.str.lower() == gold.str.lower(), "match_type": "folded"})

    pairs = [("A", "a"), ("b", "a"), (None, "a"), ("a", None)]
    rows = [(i, *pairs[i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, pred string, gold string").repartition(5)
    for sizes in ({}, {"broadcast_bytes": -1, "hot_rows": 7}):
        for old in log.iterdir():
            old.write_text("")
        got = scoring.verify_pairs(df, verifier, **sizes)
        assert got.columns == ["i", "pred", "gold", "is_correct", "match_type"] or set(got.columns) == {
            "i", "pred", "gold", "is_correct", "match_type"
        }
        seen = Counter((r.pred, r.gold, r.is_correct, r.match_type) for r in got.collect())
        assert seen == {
            ("A", "a", True, "folded"): 100,
            ("b", "a", False, "folded"): 100,
            (None, "a", False, "parse_failure"): 100,
            ("a", None, False, "parse_failure"): 100,
        }
        calls = sorted(line for f in log.iterdir() for line in f.read_text().splitlines())
        assert calls == ["A|a", "b|a"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_key_join_equals_plain_join(spark, how):
    """A third of the rows share one key and some rows have none."""
    large = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 5 WHEN id % 50 = 1 THEN NULL ELSE id % 200 END AS k"
    )
    keyed = spark.range(0, 150).selectExpr("id AS k", "concat('v', id) AS v")
    want = large.join(keyed, "k", how)
    got = keyed_join(large, keyed, "k", how, ["id"], broadcast_bytes=-1, hot_rows=50)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_key_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS k")
        keyed = spark.range(0, 4000).selectExpr("id AS k", "id AS v")
        joined = keyed_join(large, keyed, "k", "inner", ["id"], broadcast_bytes=-1, hot_rows=100)
        per_task = joined.where("k = 5").groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) == 4 and max(r["count"] for r in per_task) < 800
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_of_a_hot_row_are_spread_too(spark):
    """Rows that agree in every column, from 200 input partitions, joined in 16 tasks."""
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        large = spark.range(0, 20000, 1, 200).select(F.lit(5).cast("bigint").alias("k"), F.lit("x").alias("t"))
        keyed = spark.range(0, 4000).selectExpr("id AS k", "id AS v")
        joined = keyed_join(large, keyed, "k", "inner", ["t"], broadcast_bytes=-1, hot_rows=100)
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per_task) == 20000
        assert len(per_task) == 16 and max(r["count"] for r in per_task) < 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", tasks)


def test_pass_at_1(spark):
    rows = [(1, 20, 0, True), (1, 20, 0, False), (1, 20, 1, True), (1, 40, 0, False), (3, 20, 2, True)]
    runs = spark.createDataFrame(rows, "sft_epoch int, rl_step int, problem_id long, is_correct boolean")
    run = ["sft_epoch", "rl_step"]

    def table(**options):
        return {tuple(r)[:2]: tuple(r)[2:] for r in pass_at_1(runs, run, **options).collect()}

    assert table(num_gen=4) == {(1, 20): (2, 0.5, 0.25), (1, 40): (1, 0.0, 0.0), (3, 20): (1, 0.25, 0.25)}
    assert table() == {(1, 20): (2, 1.5, 0.75), (1, 40): (1, 0.0, 0.0), (3, 20): (1, 1.0, 1.0)}
    assert table(num_gen=4, n_problems=10)[(1, 20)] == (10, 0.5, 0.05)
    rates = {tuple(r)[:2]: r.accuracy for r in row_accuracy(runs, *run).collect()}
    assert rates == {(1, 20): 2 / 3, (1, 40): 0.0, (3, 20): 1.0}


def test_nested_columns_are_measured(spark):
    from tallyframe.operators.joins import keyed_join, measure

    wide = spark.range(1000).select("id", F.array_repeat(F.lit(1), 2048).alias("tokens"), F.create_map(F.lit("k"), F.array(F.lit("text"))).alias("m"))
    assert measure(wide, ["id"]) > 8 * 1024 * 2048 // 2
    assert measure(wide.select("id", F.struct("tokens").alias("s")), ["id"]) > 8 * 1024 * 2048 // 2
    assert measure(wide.select("id", F.lit(None).cast("array<string>").alias("n")), ["id"]) < 100_000
    plan = keyed_join(spark.range(10), wide, "id", broadcast_bytes=1_000_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" in plan and "strategy=broadcast" not in plan.split("tokens")[0]
