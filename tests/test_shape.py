"""Shapes of the physical plans: what is read, what is shuffled, what runs in one task."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyframe.functions import answer_candidate, normalize_answer
from tallyframe.operators.accuracy import problem_verdicts_of
from tallyframe.operators.curate import within_length
from tallyframe.operators.order import seeded_order, split_rows
from tallyframe.sources.jsonl import write_jsonl
from tallyframe.streaming.length_filter import stream_jsonl

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# One task over something small: bucket counts, the lines of a report, one-row totals.
SINGLE_TASK = {
    "shuffle", "shuffled_examples", "positional_id", "positional_join", "report_text", "overall",
    "parse_failures", "filter_report", "input_contract", "conservation", "steps_per_epoch", "length_stats_all",
    "checkpoint_summary", "mean_length_curve", "accuracy_curve", "types",
}


@pytest.mark.parametrize("name", entry.library_queries())
def test_no_query_pairs_everything_or_funnels_rows(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ("SinglePartition" in plan) <= (name in SINGLE_TASK)
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["report", "any_correct", "overall", "length_stats", "rl_grid", "filter_report"])
def test_text_is_not_read_where_it_is_not_needed(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "text" not in "".join(part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    entry.fixture(spark, SF_DIR, "generations").write.parquet(str(folder / "g"))
    entry.fixture(spark, SF_DIR, "problems").write.parquet(str(folder / "p"))
    return spark.read.parquet(str(folder / "g")), spark.read.parquet(str(folder / "p"))


def test_samples_collapse_before_the_join(spark, tables):
    plan = plan_of(problem_verdicts_of(*tables))
    join, partial = plan.index("Join"), plan.index("partial_")
    assert join < partial  # the tree prints parents first
    assert plan.count("Exchange hashpartitioning") == 1


def test_split_filters_without_a_shuffle(tables):
    split = split_rows(seeded_order(tables[0], ["id", "sample_idx"]), 0.1)
    for rows in (split.train.plain, split.val.plain):
        assert "Exchange" not in plan_of(rows)


def test_filters_reach_the_scan(tables):
    assert "PushedFilters: [IsNotNull(is_correct), EqualTo(is_correct,true)]" in plan_of(tables[0].where("is_correct"))
    assert "Exchange" not in plan_of(within_length(tables[0], 100))


def test_expressions_stream_as_they_are(spark, tmp_path, tables):
    """Scalar expressions need no state: a stream gives what a batch gives."""
    write_jsonl(tables[0].repartition(3), str(tmp_path / "in"))
    answer = normalize_answer(answer_candidate(F.col("generated_solution"))).alias("answer")
    stream = stream_jsonl(spark, str(tmp_path / "in"), tables[0].schema, files_per_batch=1).select("id", "sample_idx", answer)
    run = stream.writeStream.format("memory").queryName("answers").trigger(availableNow=True).start()
    run.awaitTermination()
    want = tables[0].select("id", "sample_idx", answer).collect()
    assert sorted(map(repr, spark.table("answers").collect())) == sorted(map(repr, want))
