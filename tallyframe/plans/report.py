"""The accuracy report as Markdown lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import clock_time, fixed, iso_seconds, percent, ratio


def _table_head(title: str) -> Column:
    # The table layout of the report.
    lines = (f"## Accuracy by {title}", f"| {title} | Accuracy | Correct | Total |", "|---|---:|---:|---:|")
    return F.array(*[F.lit(line) for line in lines])


def report_lines(
    report: DataFrame, model: str, source: str, split: str, subset: str, run_ts: datetime
) -> DataFrame:
    """Ordered ``(line_no, line)`` rows of a report from ``accuracy_report``.

    Each report row turns into its own lines, so the report is read once; it has one row per level
    and type.
    """
    count = lambda name: F.col(name).cast("string")
    failed_share = ratio(F.col("parse_failures"), F.col("total_samples"))
    # The wording of the report.
    head = F.array(
        F.lit("# MATH Evaluation Report"),
        F.lit(f"- Model: `{model}`"),
        F.lit(f"- Dataset source: `{source}`"),
        F.lit(f"- Split: `{split}`"),
        F.lit(f"- Subset: `{subset}`"),
        F.concat(F.lit("- Generated at: `"), iso_seconds(clock_time(run_ts)), F.lit("`")),
        F.lit(""),
        F.lit("## Overall"),
        F.concat(F.lit("- Accuracy: **"), percent(F.col("accuracy")), F.lit("**")),
        F.concat(F.lit("- Correct: **"), count("correct"), F.lit(" / "), count("total"), F.lit("**")),
        F.concat(F.lit("- Avg output tokens: **"), fixed(F.col("avg_output_tokens"), 1), F.lit("**")),
        F.concat(F.lit("- Avg prompt tokens: **"), fixed(F.col("avg_prompt_tokens"), 1), F.lit("**")),
        F.concat(
            F.lit("- Parse Failures: **"), count("parse_failures"), F.lit("** ("), percent(failed_share), F.lit(")")
        ),
        F.lit(""),
    )
    entry = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ", F.coalesce("key", F.lit("None")), percent(F.col("accuracy")), count("correct"), count("total")
        ),
        F.lit(" |"),
    )
    place = Window.partitionBy("section").orderBy("key")
    is_first = F.row_number().over(place) == 1
    is_last = F.lead(F.lit(1)).over(place).isNull()
    nothing = F.array().cast("array<string>")
    section = F.col("section")
    lines = F.when(section == "overall", head).otherwise(
        F.concat(
            F.when(is_first & (section == "level"), _table_head("Level"))
            .when(is_first & (section == "type"), _table_head("Type"))
            .otherwise(nothing),
            F.array(entry),
            F.when(is_last & (section == "level"), F.array(F.lit(""))).otherwise(nothing),
        )
    )
    rank = F.when(section == "overall", 0).when(section == "level", 1).otherwise(2)
    blocks = report.select(rank.alias("rank"), "key", lines.alias("lines"))
    ordered = blocks.select("rank", "key", F.posexplode("lines").alias("pos", "line"))
    number = F.row_number().over(Window.orderBy("rank", "key", "pos"))
    return ordered.select(number.alias("line_no"), "line").orderBy("line_no")


def write_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text file; the report has a line per level and type, so one task writes it."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode(mode).text(path)
