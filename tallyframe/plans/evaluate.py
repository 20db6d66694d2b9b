"""Score generations and report accuracy."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from tallyframe.operators.accuracy import accuracy_report, problem_verdicts
from tallyframe.operators.scoring import score_samples, solved_rows
from tallyframe.plans.report import report_lines, write_report
from tallyframe.session import written
from tallyframe.sources.jsonl import write_jsonl
from tallyframe.sources.sinks import run_name


@dataclass(frozen=True)
class Evaluation:
    results: DataFrame
    report: DataFrame
    results_path: str
    report_path: str
    correct_path: str | None


def evaluate_generations(
    outputs: DataFrame,
    examples: DataFrame,
    model: str,
    split: str,
    run_ts: datetime,
    output_dir: str,
    report_dir: str,
    subset: str = "all",
    source: str = "",
    save_correct: bool = False,
    symbolic: bool = False,
) -> Evaluation:
    """Write scored samples, the Markdown report and, if asked, all samples of solved problems.

    Scored samples are written first and read back, so answers are extracted and joined once
    whatever is computed from them, and a lost executor does not repeat that work. ``symbolic`` compares by parts and by
    algebra too.
    """
    spark = outputs.sparkSession
    if save_correct:  # read for the scores and again for the samples of solved problems
        outputs = written(outputs, "generations")
    tag = f"{output_dir.rstrip('/')}/{run_name(spark, model, run_ts, split)}"
    results_path = f"{tag}.results.parquet"
    score_samples(outputs, examples, symbolic=symbolic).write.parquet(results_path)
    results = spark.read.parquet(results_path)

    report = accuracy_report(problem_verdicts(results))
    report_path = f"{report_dir.rstrip('/')}/{run_name(spark, model, run_ts)}.md"
    write_report(report_lines(report, model, source, split, subset, run_ts), report_path)

    correct_path = None
    if save_correct:
        correct_path = f"{tag}.correct.jsonl"
        write_jsonl(solved_rows(outputs, results), correct_path)
    return Evaluation(results, report, results_path, report_path, correct_path)
