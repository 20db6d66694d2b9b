"""Command line: ``spark-submit`` or ``python -m tallyframe <command> ...``."""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tallyframe import schemas
from tallyframe.operators.order import column_order, first_ordered, seeded_order, source_order
from tallyframe.operators.prepare import number_examples
from tallyframe.plans.curate import filter_generations, make_training_set
from tallyframe.plans.evaluate import evaluate_generations
from tallyframe.plans.sweep import sweep_checkpoint_dir, sweep_run_dirs
from tallyframe.session import written
from tallyframe.sources.jsonl import read_jsonl, write_jsonl
from tallyframe.sources.problems import ProblemSource, load_problems


PROBLEM = "problem"
KNOWN_COLUMNS = "read only the columns of a generations table; saves the pass that infers all columns"


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    sources = [ProblemSource(path, path, args.format) for path in args.source]
    problems, source = load_problems(spark, sources, args.split, args.subset)
    if args.shuffle:
        order = seeded_order(written(problems, "problems"), args.keys or [PROBLEM], args.seed)
    else:
        order = column_order(written(problems, "problems"), args.keys) if args.keys else source_order(problems)
    if args.max_samples is not None:
        order = replace(order, rows=first_ordered(order, args.max_samples))
    write_jsonl(number_examples(order), args.output)
    print(f"examples from {source}: {args.output}")


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    done = evaluate_generations(
        read_jsonl(spark, args.generations, schemas.GENERATIONS),
        read_jsonl(spark, args.examples, schemas.EXAMPLES),
        args.model,
        args.split,
        args.run_time,
        args.output_dir,
        args.eval_dir,
        subset=args.subset,
        source=args.examples,
        save_correct=args.save_correct_jsonl,
        symbolic=args.symbolic,
    )
    total = done.report.first()
    print(f"accuracy {total['accuracy']:.2%} ({total['correct']}/{total['total']})")
    print("\n".join(filter(None, [done.results_path, done.report_path, done.correct_path])))


def filter_by_length(spark: SparkSession, args: argparse.Namespace) -> None:
    print(filter_generations(spark, args.input, args.max_tokens, args.output))


def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    counts = make_training_set(
        spark,
        args.input,
        args.output_dir,
        args.keys,
        args.val_ratio,
        args.seed,
        not args.no_shuffle,
        args.prompt_key,
        args.response_key,
        schema=schemas.GENERATIONS if args.known_columns else None,
        files=args.files,
    )
    print(counts)


def _save(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}.parquet")


def show_all(table: DataFrame) -> None:
    """Print a table of one row per checkpoint or epoch, every row of it."""
    table.show(max(1, table.count()), truncate=False)


def sweep_lengths(spark: SparkSession, args: argparse.Namespace) -> None:
    examples = read_jsonl(spark, args.examples, schemas.EXAMPLES)
    sweep = sweep_checkpoint_dir(spark, args.checkpoint_dir, examples, files=args.files)
    _save(vars(sweep), args.output_dir)
    show_all(sweep.summary)


def sweep_accuracy(spark: SparkSession, args: argparse.Namespace) -> None:
    examples = read_jsonl(spark, args.examples, schemas.EXAMPLES)
    sweep = sweep_run_dirs(spark, args.base_dir, examples, args.num_gen, args.sft_epochs, files=args.files)
    _save(vars(sweep), args.output_dir)
    show_all(sweep.grid)


# Option names and their defaults.
def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyframe")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        sub.set_defaults(run=run)
        return sub

    sub = command("prepare", prepare, "numbered examples with prompts from a problem set")
    sub.add_argument("--source", nargs="+", required=True, help="problem sets, tried in order")
    sub.add_argument("--format", default="parquet")
    sub.add_argument("--split", default="test")
    sub.add_argument("--subset", default="all")
    sub.add_argument("--max-samples", type=int)
    sub.add_argument("--shuffle", action="store_true")
    sub.add_argument("--seed", type=int, default=42)
    sub.add_argument("--keys", nargs="+", help="columns that identify a row, or the order without --shuffle; else the problem, or the order of the source")
    sub.add_argument("--output", required=True)

    sub = command("evaluate", evaluate, "score generations and write the accuracy report")
    sub.add_argument("--generations", required=True)
    sub.add_argument("--examples", required=True)
    sub.add_argument("--model", required=True)
    sub.add_argument("--split", default="test")
    sub.add_argument("--subset", default="all")
    sub.add_argument("--output-dir", default="outputs")
    sub.add_argument("--eval-dir", default="eval_results")
    sub.add_argument("--save-correct-jsonl", action="store_true")
    sub.add_argument("--symbolic", action="store_true", help="compare answers by their parts and by algebra too")
    sub.add_argument("--run-time", type=datetime.fromisoformat, default=datetime.now())

    sub = command("filter", filter_by_length, "drop rows over a total token count")
    sub.add_argument("--input", required=True)
    sub.add_argument("--max-tokens", type=int, required=True)
    sub.add_argument("--output")

    sub = command("convert", convert, "split JSONL into train and validation parquet")
    sub.add_argument("--input", required=True)
    sub.add_argument("--output-dir", default="data/sft")
    sub.add_argument("--val-ratio", type=float, default=0.1)
    sub.add_argument("--seed", type=int, default=42)
    sub.add_argument("--no-shuffle", action="store_true")
    sub.add_argument("--prompt-key", default="prompt")
    sub.add_argument("--response-key", default="generated_solution")
    sub.add_argument("--keys", nargs="+", default=["id", "sample_idx"], help="columns that identify a row")
    sub.add_argument("--files", type=int, default=200, help="part files of the whole table")
    sub.add_argument("--known-columns", action="store_true", help=KNOWN_COLUMNS)

    sub = command("sweep-lengths", sweep_lengths, "length and accuracy per checkpoint folder")
    sub.add_argument("--checkpoint-dir", required=True)
    sub.add_argument("--examples", required=True)
    sub.add_argument("--files", help="name pattern of the generation files")
    sub.add_argument("--output-dir", required=True)

    sub = command("sweep-accuracy", sweep_accuracy, "pass@1 per run and step folder")
    sub.add_argument("--base-dir", required=True)
    sub.add_argument("--examples", required=True)
    sub.add_argument("--sft-epochs", type=int, nargs="+", default=[1, 3, 5, 10])
    sub.add_argument("--num-gen", type=int, default=8)
    sub.add_argument("--files", help="name pattern of the generation files")
    sub.add_argument("--output-dir", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tallyframe").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
