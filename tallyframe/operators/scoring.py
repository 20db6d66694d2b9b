"""Scoring samples against gold answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import functions as TF
from tallyframe.functions.answers import DIFFERENT, PARSE_FAILURE, SYMBOLIC
from tallyframe.operators.equivalence import equal_pairs
from tallyframe.operators.joins import BROADCAST_BYTES, keyed_join, measure
from tallyframe.operators.prepare import with_default
from tallyframe.operators.verifiers import VERDICT, Verifier, isolated
from tallyframe.session import written

SAMPLE_DEFAULTS = {"sample_idx": 0, "prompt_tokens": 0, "output_tokens": 0}
CATEGORIES = ("level", "type")
# How long a verifier may take for one pair.
PAIR_SECONDS = 10.0


def complete_samples(outputs: DataFrame) -> DataFrame:
    """Samples with the optional columns filled in where the table lacks them."""
    for name, value in SAMPLE_DEFAULTS.items():
        outputs = with_default(outputs, name, value)
    return outputs


def with_categories(examples: DataFrame) -> DataFrame:
    for name in CATEGORIES:
        examples = with_default(examples, name, "Unknown")
    return examples


def join_examples(outputs: DataFrame, examples: DataFrame, *carry: str, **sizes: int) -> DataFrame:
    """Each sample with its problem's level, type and ``carry`` columns; orphans drop out.

    The category columns are the problem's; those of the sample, if any, are not used. A repeated
    example id raises.
    """
    taken = ["id", *CATEGORIES, *carry]
    samples = complete_samples(outputs).drop(*taken[1:])
    problems = with_categories(examples).select(*taken)
    return keyed_join(samples, problems, "id", "inner", ["sample_idx"], unique=True, **sizes)


def _with_answer(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Replace a text column by its normalised answer, its numeric value and the answer to show.

    Each step is a projection of its own, so the box is searched for once.
    """
    box, whole, answer = F.col("_box"), F.col(text), f"{prefix}_answer"
    return (
        df.withColumn("_box", TF.closed_box(whole))
        .withColumn(answer, TF.normalize_answer(TF.answer_candidate(whole, box)))
        .withColumn(f"{prefix}_value", TF.numeric_answer(F.col(answer)))
        .withColumn(f"{prefix}_shown", TF.last_boxed(whole, box))
        .drop("_box", text)
    )


def match_answers(outputs: DataFrame, examples: DataFrame, run: Sequence[str] = (), **sizes: int) -> DataFrame:
    """Samples of known problems with ``pred_*`` and ``gold_*`` answer columns.

    Answers are extracted before the join, so texts take no part in it. ``run`` columns, such as a
    checkpoint number, are carried along.
    """
    samples = complete_samples(outputs).select(
        "id",
        *run,
        F.col("sample_idx").cast("int").alias("sample_idx"),
        "generated_solution",
        *[F.col(c).cast("bigint").alias(c) for c in ("output_tokens", "prompt_tokens")],
    )
    samples = _with_answer(samples, "generated_solution", "pred")
    problems = with_categories(examples).select("id", *CATEGORIES, "solution")
    gold = _with_answer(problems, "solution", "gold")
    # An answer is no longer than its solution: what is small before the answers are taken out need not be written.
    at_most = measure(problems.select("*", F.col("solution").alias("_shown")), ["id"], unique=True)
    if at_most <= sizes.get("broadcast_bytes", BROADCAST_BYTES):
        return samples.join(F.broadcast(gold), "id")
    # Written once: the join measures it first and then reads it.
    gold = written(gold, "gold-answers")
    carried = [c for c in gold.columns if c.startswith("gold_")]
    return join_examples(samples, gold, *carried, **sizes)


def _results(matched: DataFrame, run: Sequence[str]) -> DataFrame:
    return matched.select(
        "id",
        *run,
        "sample_idx",
        *CATEGORIES,
        "is_correct",
        "match_type",
        F.col("pred_shown").alias("generated_answer"),
        F.col("gold_shown").alias("ground_truth_answer"),
        "output_tokens",
        "prompt_tokens",
    )


def score_samples(
    outputs: DataFrame,
    examples: DataFrame,
    run: Sequence[str] = (),
    single_label: bool = False,
    symbolic: bool = False,
    **sizes: int,
) -> DataFrame:
    """Result rows: every sample of a known problem with its answers and the native verdict.

    ``single_label`` reports one match type for all compared pairs, right or wrong. With ``symbolic``, pairs that differ as
    text and as numbers are compared by their parts and by algebra too, each distinct pair once; judged samples are
    then written on the way.
    """
    matched = match_answers(outputs, examples, run, **sizes)
    label = TF.answer_label(*[F.col(f"{side}_{part}") for part in ("answer", "value") for side in ("pred", "gold")])
    judged = matched.withColumn("match_type", label).withColumn("is_correct", TF.is_match(F.col("match_type")))
    if symbolic:
        judged = _with_symbolic(written(judged, "judged"), **sizes)
    if single_label:
        judged = judged.withColumn("match_type", TF.single_label(F.col("match_type")))
    return _results(judged, run)


def _with_symbolic(judged: DataFrame, **sizes: int) -> DataFrame:
    """Verdicts of pairs that are equal only by their parts or by algebra."""
    open_pairs = judged.where(F.col("match_type") == DIFFERENT)
    equal = written(equal_pairs(open_pairs, "pred_answer", "gold_answer", **sizes), "equal-pairs").withColumn("_equal", F.lit(True))
    spread = ["id", "sample_idx"]
    joined = keyed_join(judged, equal, ["pred_answer", "gold_answer"], "left", spread, **sizes)
    found = F.coalesce("_equal", F.lit(False)) & (F.col("match_type") == DIFFERENT)
    return joined.withColumns(
        {"match_type": F.when(found, SYMBOLIC).otherwise(F.col("match_type")), "is_correct": F.col("is_correct") | found}
    ).drop("_equal")


def verify_pairs(
    df: DataFrame,
    verifier: Verifier,
    pred: str = "pred",
    gold: str = "gold",
    tasks: int | None = None,
    seconds: float = PAIR_SECONDS,
    **sizes: int,
) -> DataFrame:
    """Verdicts of a caller-supplied verifier, which sees each distinct answer pair once.

    ``verifier`` maps two string series to a frame of ``is_correct`` and ``match_type``. Pairs with
    a missing side are parse failures and do not reach it. A pair on which it raises, or is not done within
    ``seconds``, is wrong with the match type ``error``; if it fails on every pair, that is an error.

    Copies of a pair are one before any shuffle. Pairs are few bytes but may take long to judge: they are dealt to
    ``tasks`` tasks, by default as many as the session shuffles to, and not to fewer by their size.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    check = F.pandas_udf(isolated(verifier, seconds), VERDICT)
    pairs = df.select(pred, gold).dropna().distinct().repartition(tasks, pred, gold)
    verdicts = written(pairs.withColumn("verdict", check(pred, gold)), "verdicts")
    judged, failed, why = verdicts.agg(F.count("*"), F.count("verdict.error"), F.min("verdict.error")).first()
    if judged and failed == judged:
        raise ValueError(f"the verifier failed on every one of {judged} pairs: {why}")
    spread = [c for c in df.columns if c not in (pred, gold)]
    return (
        keyed_join(df, verdicts, [pred, gold], "left", spread, **sizes)
        .withColumn("is_correct", F.coalesce("verdict.is_correct", F.lit(False)))
        .withColumn("match_type", F.coalesce("verdict.match_type", F.lit(PARSE_FAILURE)))
        .drop("verdict")
    )


def score_samples_with(
    outputs: DataFrame,
    examples: DataFrame,
    verifier: Verifier,
    run: Sequence[str] = (),
    seconds: float = PAIR_SECONDS,
    **sizes: int,
) -> DataFrame:
    """``score_samples`` with a caller's verifier in place of the native comparison; see ``verify_pairs``.

    Matched answers are written once: the pairs and the result both read them.
    """
    matched = written(match_answers(outputs, examples, run, **sizes), "answers")
    return _results(verify_pairs(matched, verifier, "pred_answer", "gold_answer", seconds=seconds, **sizes), run)


def correct_ids(results: DataFrame) -> DataFrame:
    return results.where(F.col("is_correct")).select("id").distinct()


def solved_rows(outputs: DataFrame, results: DataFrame, **sizes: int) -> DataFrame:
    """All samples, right and wrong, of problems with at least one correct sample."""
    return keyed_join(outputs, correct_ids(results), "id", "left_semi", **sizes)


def correct_rows(outputs: DataFrame, results: DataFrame, **sizes: int) -> DataFrame:
    """Only the correct samples themselves, matched on ``(id, sample_idx)``."""
    right = results.where(F.col("is_correct")).select("id", "sample_idx").distinct()
    return keyed_join(outputs, right, ["id", "sample_idx"], "left_semi", **sizes)
