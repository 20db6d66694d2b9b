"""

Each query is registered next to its SQL. Fixtures come in as CTEs on the DuckDB side and as views
on the Spark side, from the same text.
"""

from __future__ import annotations

import importlib
import importlib.util
import sys
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pandas as pd  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fixtures import base, fixture, with_fixtures  # noqa: E402
from tallyframe import functions as TF  # noqa: E402
from tallyframe.operators import (  # noqa: E402
    accuracy,
    checkpoints,
    curate,
    lengths,
    order,
    prepare,
    rollouts,
    scoring,
)
from tallyframe.operators.joins import keyed_join, measure  # noqa: E402
from tallyframe.plans.report import report_lines  # noqa: E402
from tallyframe.plans.sweep import sweep_accuracy, sweep_lengths  # noqa: E402
from tallyframe.session import CHECKPOINT_DIR, file_system, shared_dir, use_folder  # noqa: E402
from tallyframe.plans.curate import filter_generations  # noqa: E402
from tallyframe.sources.checkpoint_dirs import checkpoint_dirs, read_checkpoints  # noqa: E402
from tallyframe.sources.jsonl import read_jsonl, write_jsonl  # noqa: E402
from tallyframe.sources.problems import ProblemSource, load_problems  # noqa: E402
from tallyframe.sources.sinks import write_if_absent, write_split, write_tagged  # noqa: E402
from tallyframe.streaming.length_filter import stream_jsonl, stream_length_filter  # noqa: E402
from tallyframe.streaming.scoring import stream_scores  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
SEED = 42
MAX_SAMPLES = 500
MAX_TOKENS = 500
NUM_GEN = 8
STREAM_BATCHES = 3
STREAM_FILE_BYTES = 64 * 1024 * 1024
STEPS = [20, 40, 60, 80, 100]
RUN_TS = datetime(2025, 1, 2, 3, 4, 5)

# Folder for written tables under a local master whose session names none.
_LOCAL_FOLDER = tempfile.mkdtemp(prefix="tallyframe-entry-")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str, *fixtures: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        _QUERIES[build.__name__] = build
        _ORACLES[build.__name__] = with_fixtures(fixtures, sql)
        return build

    return register


def entry(spark: SparkSession) -> DataFrame:
    """Accuracy overall, by level and by type, from one pass over the samples."""
    return report(spark, SMOKE_DIR)


def library_queries() -> dict[str, Query]:
    """The queries of the library itself; each has its SQL."""
    return dict(_QUERIES)


def queries() -> dict[str, Query]:
    return library_queries() | {name: build for part in _training_data() for name, build in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES) | {name: sql for part in _training_data() for name, sql in part.ORACLES.items()}


def _training_data() -> list:
    """Modules of the training-data operators and their pipeline, as far as they are installed."""
    there = [name for name in ("tallyframe.llm", "corpus_pipeline") if importlib.util.find_spec(name)]
    if "tallyframe.llm" not in there:
        return []
    return [importlib.import_module("tallyframe.llm.queries" if name == "tallyframe.llm" else name) for name in there]


def _r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _run_dir(spark: SparkSession, name: str) -> str:
    context = spark.sparkContext
    if context.master.startswith("local[") and not context.getConf().get(CHECKPOINT_DIR):
        use_folder(spark, _LOCAL_FOLDER)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# SQL pieces used by several oracles.

# Written out here and not taken from the library, so that the two can disagree.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_STRIP = f"trim({{0}}, '{_BLANKS}')"
_NORM_TYPE = f"replace(replace(lower({_STRIP.format('type')}), '&', 'and'), ' ', '_')"
_PROMPT = """concat('Solve the following math problem step by step. Show your reasoning and provide the final answer.

Problem: ', problem, '

Solution:')"""
_SEEDED_DOC = f"md5(concat('{SEED}:', doc_id)), doc_id"
_SEEDED_SAMPLE = f"md5(concat('{SEED}:', id, ':', sample_idx)), id, sample_idx"

_VERDICTS = """SELECT g.id, e.level, e.type, bool_or(g.is_correct) AS is_correct, count(*) AS samples,
       count(*) FILTER (WHERE g.match_type = 'parse_failure') AS failures,
       sum(g.output_tokens) AS out_tokens, sum(g.prompt_tokens) AS in_tokens
FROM {samples} g JOIN problems e ON g.id = e.id GROUP BY g.id, e.level, e.type"""
_GIVEN_VERDICTS = _VERDICTS.format(samples="generations")

_REPORT = """SELECT CASE WHEN grouping(level) = 1 AND grouping(type) = 1 THEN 'overall'
            WHEN grouping(level) = 0 THEN 'level' ELSE 'type' END AS section,
       coalesce(level, type) AS key,
       {round}(sum(is_correct::INT) / count(*){digits}) AS accuracy,
       sum(is_correct::INT)::BIGINT AS correct, count(*)::BIGINT AS total,
       sum(samples)::BIGINT AS total_samples, sum(failures)::BIGINT AS parse_failures,
       {round}(sum(out_tokens) / sum(samples){digits}) AS avg_output_tokens,
       {round}(sum(in_tokens) / sum(samples){digits}) AS avg_prompt_tokens
FROM ({verdicts}) v GROUP BY GROUPING SETS ((), (level), (type))"""


def _report_sql(verdicts: str, rounded: bool = True) -> str:
    return _REPORT.format(verdicts=verdicts, round="round" if rounded else "", digits=", 6" if rounded else "")


_BOX = r"""regexp_extract({0}, '(?s).*\\boxed[^{{}}]*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1)"""
_NUMBER = r"list_extract(regexp_extract_all({0}, '-?\d+(?:,\d{{3}})*(?:\.\d+)?(?:/\d+)?'), -1)"
_CANDIDATE = f"coalesce(nullif({_STRIP.format(_BOX)}, ''), {_NUMBER})"


def _normal_sql(text: str) -> str:
    steps = [
        (r"\$|\\left|\\right|\\[,;:! ]", ""),
        (r"\^\\circ|\^\{\\circ\}", ""),
        (r"\\text\{([^{}]*)\}", r"\1"),
        (r"\{,\}", ","),
        (r"\\[dt]frac", r"\\frac"),
        (r"\\frac\{(-?\d+)\}\{(\d+)\}", r"\1/\2"),
        (r"\s+", ""),
        (r"^(-?)\\frac(\d)(\d)$", r"\1\2/\3"),
        (r"^[A-Za-z]=", ""),
    ]
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"rtrim({text}, '.')"


def _value_sql(text: str) -> str:
    whole = r"regexp_full_match({0}, '-?(\d+\.?\d*|\.\d+)')"
    part = r"regexp_full_match({0}, '-?(\d+\.?\d*|\.\d+)/\d+')"
    return (
        f"CASE WHEN {whole.format(text)} THEN CAST({text} AS DOUBLE) WHEN {part.format(text)} THEN "
        f"CAST(split_part({text}, '/', 1) AS DOUBLE) / nullif(CAST(split_part({text}, '/', 2) AS DOUBLE), 0) END"
    )


def _ungrouped_sql(text: str) -> str:
    grouped = r"'-?\d+(,\d{3})+(\.\d+)?(/\d+)?'"
    return f"nullif(CASE WHEN regexp_full_match({text}, {grouped}) THEN replace({text}, ',', '') ELSE {text} END, '')"


_ANSWERS = f"""SELECT id, sample_idx, level, type, output_tokens, prompt_tokens, generated_solution, solution,
       {_ungrouped_sql('pred')} AS pred, {_ungrouped_sql('gold')} AS gold
FROM (SELECT g.id, g.sample_idx, e.level, e.type, g.output_tokens, g.prompt_tokens, generated_solution, solution,
             {_normal_sql(_CANDIDATE.format('generated_solution'))} AS pred,
             {_normal_sql(_CANDIDATE.format('solution'))} AS gold
      FROM generations g JOIN problems e ON g.id = e.id) t"""
_TOP = "CAST(split_part({0}, '/', 1) AS HUGEINT)"
_BELOW = "coalesce(CAST(nullif(split_part({0}, '/', 2), '') AS HUGEINT), 1)"
_RATIONAL = r"regexp_full_match({0}, '-?\d{{1,18}}(/\d{{1,18}})?')"
_SAME = f"""CASE WHEN {_RATIONAL.format('pred')} AND {_RATIONAL.format('gold')}
            THEN {_TOP.format('pred')} * {_BELOW.format('gold')} = {_TOP.format('gold')} * {_BELOW.format('pred')}
            ELSE (contains(pred, '.') OR contains(gold, '.')) AND abs(pv - gv) < 0.5
                 AND abs(pv - gv) <= 1e-9 * greatest(abs(pv), abs(gv)) END"""
_SCORED = f"""SELECT *, CASE WHEN pred IS NULL OR gold IS NULL THEN 'parse_failure' WHEN pred = gold THEN 'exact'
       WHEN {_SAME} THEN 'numeric_equiv' ELSE 'different' END AS match_type
FROM (SELECT *, {_value_sql('pred')} AS pv, {_value_sql('gold')} AS gv FROM ({_ANSWERS}) a) b"""
_LAST_BOXED = "CASE WHEN contains({0}, chr(92) || 'boxed') THEN {1} ELSE {2} END"


def _boxed_sql(text: str) -> str:
    return _LAST_BOXED.format(text, _STRIP.format(_BOX.format(text)), _STRIP.format(text))


# Joins and accuracy.


@query(
    """SELECT g.id, g.sample_idx, e.level, e.type, e.solution, g.is_correct, g.match_type, g.output_tokens,
              g.prompt_tokens, g.generated_solution
       FROM generations g JOIN problems e ON g.id = e.id""",
    "generations",
    "problems",
)
def score_join(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.join_examples(fixture(spark, sf, "generations"), fixture(spark, sf, "problems"), "solution")


@query(
    """SELECT count(*)::BIGINT AS total_samples,
              count(*) FILTER (WHERE match_type = 'parse_failure')::BIGINT AS parse_failures,
              round(count(*) FILTER (WHERE match_type = 'parse_failure') / count(*), 6) AS parse_failure_share
       FROM generations""",
    "generations",
)
def parse_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(accuracy.parse_failures(fixture(spark, sf, "generations")), "parse_failure_share")


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return accuracy.problem_verdicts_of(fixture(spark, sf, "generations"), fixture(spark, sf, "problems"))


@query(f"SELECT id, level, type, is_correct FROM ({_GIVEN_VERDICTS}) v", "generations", "problems")
def any_correct(spark: SparkSession, sf: str) -> DataFrame:
    return accuracy.any_correct(_verdicts(spark, sf))


@query(
    f"""SELECT round(sum(is_correct::INT) / count(*), 6) AS accuracy, sum(is_correct::INT)::BIGINT AS correct,
               count(*)::BIGINT AS total, sum(samples)::BIGINT AS total_samples,
               sum(failures)::BIGINT AS parse_failures,
               round(sum(out_tokens) / sum(samples), 6) AS avg_output_tokens,
               round(sum(in_tokens) / sum(samples), 6) AS avg_prompt_tokens
        FROM ({_GIVEN_VERDICTS}) v""",
    "generations",
    "problems",
)
def overall(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(accuracy.overall(_verdicts(spark, sf)), "accuracy", "avg_output_tokens", "avg_prompt_tokens")


def _by_sql(key: str) -> str:
    return f"""SELECT {key}, sum(is_correct::INT)::BIGINT AS correct, count(*)::BIGINT AS total,
                      round(sum(is_correct::INT) / count(*), 6) AS accuracy
               FROM ({_GIVEN_VERDICTS}) v GROUP BY {key}"""


@query(_by_sql("level"), "generations", "problems")
def by_level(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(accuracy.accuracy_by(_verdicts(spark, sf), "level"), "accuracy")


@query(_by_sql("type"), "generations", "problems")
def by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(accuracy.accuracy_by(_verdicts(spark, sf), "type"), "accuracy")


@query(_report_sql(_GIVEN_VERDICTS), "generations", "problems")
def report(spark: SparkSession, sf: str) -> DataFrame:
    result = accuracy.accuracy_report(_verdicts(spark, sf))
    return _r6(result, "accuracy", "avg_output_tokens", "avg_prompt_tokens")


# Preparing examples.


@query(f"SELECT id, problem, solution, level, type, {_PROMPT} AS prompt FROM problems", "problems")
def examples(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.to_examples(fixture(spark, sf, "problems"))


@query(
    f"""SELECT item_id AS id, text AS problem, text AS solution, 'Unknown' AS level, 'Unknown' AS type,
               {_PROMPT.replace('problem,', 'text,')} AS prompt
        FROM benchmark"""
)
def examples_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    raw = base(spark, sf, "benchmark").select("item_id", F.col("text").alias("problem"), F.col("text").alias("solution"))
    return prepare.to_examples(raw, "item_id")


@query(f"SELECT id, {_PROMPT} AS prompt FROM problems", "problems")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "problems").select("id", TF.math_prompt(F.col("problem")).alias("prompt"))


@query(f"SELECT id, {_NORM_TYPE} AS type_key FROM problems", "problems")
def type_keys(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "problems").select("id", TF.normalize_type(F.col("type")).alias("type_key"))


@query(f"SELECT * FROM problems WHERE {_NORM_TYPE} = 'counting_and_probability'", "problems")
def subset(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.require_subset(fixture(spark, sf, "problems"), "Counting & Probability")


@query(f"SELECT DISTINCT {_NORM_TYPE} AS type FROM problems ORDER BY type LIMIT 20", "problems")
def types(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.available_types(fixture(spark, sf, "problems"))


@query(
    """SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
              regexp_replace(lower(split_part(rtrim(url, '/'), '/', -1)), '[^a-z0-9_]', '_', 'g') AS file_slug
       FROM pages"""
)
def slug(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return base(spark, sf, "pages").select("page_id", TF.slug(url).alias("slug"), TF.file_slug(url).alias("file_slug"))


@query("SELECT problem AS prompt, solution AS response FROM problems", "problems")
def sft_columns(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.prompt_response(fixture(spark, sf, "problems"), "problem", "solution")


@query(
    """SELECT 'documents' AS config, doc_id AS row_id, text AS problem FROM documents
       UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
       UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations"""
)
def concat_configs(spark: SparkSession, sf: str) -> DataFrame:
    ids = {"documents": F.col("doc_id"), "benchmark": F.col("item_id"), "conversations": F.col("conv_id") * 1000 + F.col("turn")}
    return prepare.concat_configs(
        [
            base(spark, sf, name).select(F.lit(name).alias("config"), row_id.alias("row_id"), F.col("text").alias("problem"))
            for name, row_id in ids.items()
        ]
    )


@query(f"SELECT doc_id, text, row_number() OVER (ORDER BY {_SEEDED_DOC}) - 1 AS position FROM documents")
def shuffle(spark: SparkSession, sf: str) -> DataFrame:
    docs = base(spark, sf, "documents").select("doc_id", "text")
    return order.with_position(order.seeded_order(docs, "doc_id", SEED))


@query(f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {MAX_SAMPLES}")
def cap(spark: SparkSession, sf: str) -> DataFrame:
    docs = base(spark, sf, "documents").select("doc_id", "text")
    return order.first_rows(order.column_order(docs, "doc_id"), MAX_SAMPLES)


@query(f"SELECT doc_id, text FROM documents LIMIT {MAX_SAMPLES}")
def cap_in_source_order(spark: SparkSession, sf: str) -> DataFrame:
    return order.first_rows(order.source_order(base(spark, sf, "documents")), MAX_SAMPLES).select("doc_id", "text")


@query(
    """SELECT doc_id, text, i < v AS is_val
       FROM (SELECT doc_id, text, row_number() OVER () - 1 AS i, CAST(floor(count(*) OVER () * 0.1::DOUBLE) AS BIGINT) AS v FROM documents) t"""
)
def split_in_source_order(spark: SparkSession, sf: str) -> DataFrame:
    split = order.split_rows(order.source_order(base(spark, sf, "documents")), 0.1)
    parts = [part.plain.select("doc_id", "text", F.lit(is_val).alias("is_val")) for part, is_val in ((split.train, False), (split.val, True))]
    return parts[0].unionByName(parts[1])


@query(f"SELECT doc_id, text FROM documents ORDER BY {_SEEDED_DOC} LIMIT {MAX_SAMPLES}")
def sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = base(spark, sf, "documents").select("doc_id", "text")
    return order.first_rows(order.seeded_order(docs, "doc_id", SEED), MAX_SAMPLES)


@query(
    f"""SELECT position AS id, problem, solution, level, type, {_PROMPT} AS prompt
        FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('{SEED}:', id)), id) - 1 AS position FROM problems) t""",
    "problems",
)
def shuffled_examples(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.number_examples(order.seeded_order(fixture(spark, sf, "problems"), "id", SEED))


@query("SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def positional_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = base(spark, sf, "documents").select("doc_id", "source")
    return order.with_position(order.column_order(docs, "doc_id"))


@query(
    f"SELECT id, s.sample_idx::INT AS sample_idx, {_PROMPT} AS prompt FROM problems, range({NUM_GEN}) s(sample_idx)",
    "problems",
)
def replicate(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.replicate(prompts(spark, sf), NUM_GEN)


def _nested_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """One prompt per document, one output per line, a running number per word as token ids."""
    return base(spark, sf, "documents").selectExpr(
        "doc_id AS id",
        "sequence(1, size(split(text, ' '))) AS prompt_token_ids",
        "transform(split(text, '\\n'), x -> named_struct('text', x, 'token_ids',"
        " sequence(1, size(split(x, ' '))))) AS outputs",
    )


@query(
    """SELECT id, (idx - 1)::INT AS sample_idx, line AS generated_solution, prompt_tokens,
              len(string_split(line, ' '))::BIGINT AS output_tokens
       FROM (SELECT doc_id AS id, len(string_split(text, ' '))::BIGINT AS prompt_tokens,
                    unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS idx
             FROM documents) t"""
)
def flatten(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.flatten_outputs(_nested_outputs(spark, sf))


@query(
    r"""SELECT doc_id, len(string_split(text, ' '))::INT AS n_tokens,
               len(regexp_extract_all(text, '\S+'))::INT AS n_words
        FROM documents"""
)
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return base(spark, sf, "documents").select(
        "doc_id",
        TF.token_count(F.split(text, " ")).alias("n_tokens"),
        TF.word_count(text).alias("n_words"),
    )


@query(
    """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events"""
)
def run_stamps(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return base(spark, sf, "events").select("event_id", TF.run_stamp(ts).alias("stamp"), TF.iso_seconds(ts).alias("iso"))


# Curating training data.


@query("SELECT * FROM generations WHERE id IN (SELECT id FROM generations WHERE is_correct)", "generations")
def solved_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "generations")
    return scoring.solved_rows(rows, rows)


@query("SELECT * FROM generations WHERE is_correct", "generations")
def correct_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "generations")
    return scoring.correct_rows(rows, rows)


@query(f"SELECT * FROM generations WHERE prompt_tokens + output_tokens <= {MAX_TOKENS}", "generations")
def length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return curate.within_length(fixture(spark, sf, "generations"), MAX_TOKENS)


@query(
    f"""SELECT input, kept, input - kept AS dropped, round(100 * kept / input, 6) AS kept_pct,
               round(100 * (input - kept) / input, 6) AS dropped_pct
        FROM (SELECT count(*)::BIGINT AS input,
                     count(*) FILTER (WHERE prompt_tokens + output_tokens <= {MAX_TOKENS})::BIGINT AS kept
              FROM generations) t""",
    "generations",
)
def filter_report(spark: SparkSession, sf: str) -> DataFrame:
    result = curate.length_filter_report(fixture(spark, sf, "generations"), MAX_TOKENS)
    return _r6(result, "kept_pct", "dropped_pct")


_RANKED = f"""SELECT * EXCLUDE (pos, n_all) FROM (
    SELECT *, row_number() OVER (ORDER BY {_SEEDED_SAMPLE}) - 1 AS pos, count(*) OVER () AS n_all FROM generations) t
    WHERE pos {{0}} CAST(floor(n_all * 0.1::DOUBLE) AS BIGINT)"""


def _split(spark: SparkSession, sf: str) -> order.Split:
    rows = fixture(spark, sf, "generations")
    return order.split_rows(order.seeded_order(rows, ["id", "sample_idx"], SEED), 0.1)


@query(_RANKED.format(">="), "generations")
def split_train(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).train.plain


@query(_RANKED.format("<"), "generations")
def split_val(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).val.plain


@query(
    """SELECT n AS input_rows, n - v AS train_rows, v AS val_rows, TRUE AS conserved
       FROM (SELECT count(*)::BIGINT AS n, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) AS v FROM generations) t""",
    "generations",
)
def conservation(spark: SparkSession, sf: str) -> DataFrame:
    split = _split(spark, sf)
    return curate.row_conservation(fixture(spark, sf, "generations"), split.train.plain, split.val.plain)


@query(_RANKED.format(">="), "generations")
def train_file(spark: SparkSession, sf: str) -> DataFrame:
    """The split written as parquet files in shuffled order, and read back."""
    out = _run_dir(spark, "split")
    write_split(_split(spark, sf), out, files=8)
    return spark.read.parquet(f"{out}/train.parquet")


@query(
    """SELECT count(*)::BIGINT AS rows, greatest(1, CAST(ceil(count(*) / 512) AS BIGINT)) AS steps_per_epoch
       FROM generations""",
    "generations",
)
def steps_per_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return curate.steps_per_epoch(fixture(spark, sf, "generations"))


@query("SELECT * FROM generations", "generations")
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Generations written as JSONL and read back with their schema."""
    rows = fixture(spark, sf, "generations")
    path = f"{_run_dir(spark, 'generations')}.jsonl"
    write_jsonl(rows, path)
    return read_jsonl(spark, path, rows.schema)


@query(
    """SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE text IS NULL)::BIGINT AS null_text,
              count(*) FILTER (WHERE quality IS NULL)::BIGINT AS null_quality FROM samples""",
    "samples",
)
def input_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Required columns are there, and how many of their values are missing."""
    rows = curate.require_columns(fixture(spark, sf, "samples"), "text", "quality")
    return curate.missing_counts(rows, "text", "quality")


@query("SELECT doc_id, text AS problem, 'second' AS source_name FROM documents")
def source_failover(spark: SparkSession, sf: str) -> DataFrame:
    """Problems of the first source that is there; a split of a data set is a folder or file below it."""
    sources = [ProblemSource("first", f"{sf}/nowhere"), ProblemSource("second", sf)]
    rows, name = load_problems(spark, sources, "documents.parquet")
    return rows.select("doc_id", F.col("text").alias("problem"), F.lit(name).alias("source_name"))


@query("SELECT doc_id, lang FROM documents")
def skip_if_exists(spark: SparkSession, sf: str) -> DataFrame:
    """A second write to the same place leaves what the first has written."""
    docs, path = base(spark, sf, "documents").select("doc_id", "lang"), _run_dir(spark, "once")
    write_if_absent(docs, path)
    write_if_absent(docs.withColumn("lang", F.lit("other")), path)
    return spark.read.parquet(path)


@query(
    """SELECT doc_id, 'some_model_1_5b' AS model_slug, 'test' AS split, '20250102_030405' AS run_ts FROM documents
       UNION ALL SELECT item_id, 'some_model_1_5b', 'train', '20250102_030406' FROM benchmark"""
)
def run_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs in one table, told apart by model, split and time."""
    path, model = _run_dir(spark, "runs"), "Some/Model-1.5B"
    write_tagged(base(spark, sf, "documents").select("doc_id"), path, model, "test", RUN_TS)
    items = base(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    write_tagged(items, path, model, "train", RUN_TS.replace(second=6))
    return spark.read.schema("doc_id BIGINT, model_slug STRING, split STRING, run_ts STRING").parquet(path)


@query(f"SELECT id, output_tokens, prompt_tokens FROM generations WHERE output_tokens + prompt_tokens <= {MAX_TOKENS}", "generations")
def filtered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines within the length limit, copied as they stand and read back."""
    rows = fixture(spark, sf, "generations").select("id", "output_tokens", "prompt_tokens")
    path = f"{_run_dir(spark, 'lines')}.jsonl"
    write_jsonl(rows, path)
    kept = filter_generations(spark, path, MAX_TOKENS)
    return read_jsonl(spark, kept["output"], rows.schema)


# Checkpoints and runs.


@query(
    """SELECT doc_id, source, CAST(regexp_extract(replace(source, 'src', 'model_'), '^.+_([0-9]+)$', 1) AS BIGINT) AS checkpoint_num,
              CAST(regexp_extract(replace(source, 'src', 'global_step_'), '^global_step_([0-9]+)$', 1) AS BIGINT) AS rl_step
       FROM documents"""
)
def checkpoint_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "documents").select(
        "doc_id",
        "source",
        checkpoints.trailing_number(F.replace("source", F.lit("src"), F.lit("model_"))).alias("checkpoint_num"),
        checkpoints.step_number(F.replace("source", F.lit("src"), F.lit("global_step_"))).alias("rl_step"),
    )


@query(
    """SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS checkpoint_num, doc_id, text FROM documents"""
)
def checkpoint_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written to one folder per checkpoint, and read back as one table."""
    docs = base(spark, sf, "documents").select(
        "doc_id", "text", F.replace("source", F.lit("src"), F.lit("model_")).alias("folder")
    )
    parent = _run_dir(spark, "checkpoints")
    docs.write.partitionBy("folder").option("ignoreNullFields", "false").json(parent)
    return read_checkpoints(spark, parent, docs.drop("folder").schema)


@query(
    """SELECT checkpoint_num, count(*)::BIGINT AS n, 'OK' AS status
       FROM (SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS checkpoint_num FROM documents) t GROUP BY 1
       UNION ALL SELECT 1000, 0, 'FAILED' UNION ALL SELECT 1001, 0, 'FAILED'"""
)
def failed_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of checkpoints, of which one is empty and one holds an empty file only."""
    docs = base(spark, sf, "documents").select("doc_id", F.replace("source", F.lit("src"), F.lit("model_")).alias("folder"))
    parent = _run_dir(spark, "some checkpoints")
    docs.write.partitionBy("folder").json(parent)
    for name, file in (("model_1000", ""), ("model_1001", "/part-0.json")):
        fs, path = file_system(spark, f"{parent}/{name}{file}")
        fs.create(path).close() if file else fs.mkdirs(path)
    rows = read_checkpoints(spark, parent, docs.select("doc_id").schema)
    counts = rows.groupBy("checkpoint_num").agg(F.count("*").alias("n"))
    return checkpoints.with_failed(checkpoint_dirs(spark, parent).select("checkpoint_num"), counts)


@query(
    """SELECT lang, rl_step, row_number() OVER (PARTITION BY lang ORDER BY rl_step)::INT AS ordinal
       FROM (SELECT DISTINCT lang, 20 * CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS rl_step FROM documents) t"""
)
def step_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    name = F.replace("source", F.lit("src"), F.lit("global_step_"))
    manifest = base(spark, sf, "documents").select("lang", (checkpoints.step_number(name) * 20).alias("rl_step")).distinct()
    return checkpoints.step_ordinals(manifest, ["lang"], "rl_step")


_ROW_ACCURACY = """SELECT checkpoint_num, sum(is_correct::INT)::BIGINT AS correct, count(*)::BIGINT AS n,
       round(sum(is_correct::INT) / count(*), 6) AS accuracy FROM checkpoint_runs GROUP BY checkpoint_num"""


@query(_ROW_ACCURACY, "checkpoint_runs")
def row_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(accuracy.row_accuracy(fixture(spark, sf, "checkpoint_runs"), "checkpoint_num"), "accuracy")


_STATS = """count(*)::BIGINT AS n, round(avg(output_tokens), 6) AS mean,
       round(coalesce(stddev_samp(output_tokens), 0.0), 6) AS std, min(output_tokens) AS min,
       round(quantile_cont(output_tokens, 0.25), 6) AS p25, round(quantile_cont(output_tokens, 0.5), 6) AS median,
       round(quantile_cont(output_tokens, 0.75), 6) AS p75, round(quantile_cont(output_tokens, 0.95), 6) AS p95,
       max(output_tokens) AS max"""
_STAT_DOUBLES = ("mean", "std", "p25", "median", "p75", "p95")


@query(f"SELECT checkpoint_num, {_STATS} FROM checkpoint_runs GROUP BY checkpoint_num", "checkpoint_runs")
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    counts = lengths.length_frequencies(fixture(spark, sf, "checkpoint_runs"), ["checkpoint_num"])
    return _r6(lengths.length_stats(counts, ["checkpoint_num"]), *_STAT_DOUBLES)


@query(f"SELECT {_STATS} FROM generations", "generations")
def length_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    counts = lengths.length_frequencies(fixture(spark, sf, "generations"))
    return _r6(lengths.length_stats(counts), *_STAT_DOUBLES)


_HISTOGRAM = """WITH ranged AS (
  SELECT checkpoint_num, CASE WHEN lo = hi THEN lo - 0.5::DOUBLE ELSE lo::DOUBLE END AS start,
         CASE WHEN lo = hi THEN 1::DOUBLE ELSE (hi - lo)::DOUBLE END / 40 AS step
  FROM (SELECT checkpoint_num, min(output_tokens) AS lo, max(output_tokens) AS hi FROM checkpoint_runs GROUP BY 1) m)
SELECT r.checkpoint_num, b.bin::INT AS bin, round(start + step * b.bin, 6) AS bin_start,
       round(start + step * (b.bin + 1), 6) AS bin_end, coalesce(h.n, 0)::BIGINT AS n
FROM ranged r CROSS JOIN range(40) b(bin)
LEFT JOIN (SELECT checkpoint_num, bin, count(*) AS n
           FROM (SELECT checkpoint_num, (SELECT count(*) FROM range(1, 40) e(k) WHERE start + step * k <= output_tokens) AS bin
                 FROM checkpoint_runs JOIN ranged USING (checkpoint_num)) c GROUP BY 1, 2) h
ON h.checkpoint_num = r.checkpoint_num AND h.bin = b.bin"""


@query(f"SELECT * FROM ({_HISTOGRAM}) h", "checkpoint_runs")
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    counts = lengths.length_frequencies(fixture(spark, sf, "checkpoint_runs"), ["checkpoint_num"])
    return _r6(lengths.length_histogram(counts, ["checkpoint_num"]), "bin_start", "bin_end")


def _sweep(spark: SparkSession, sf: str):
    return sweep_lengths(fixture(spark, sf, "checkpoint_runs"), fixture(spark, sf, "checkpoints"))


@query(
    f"""SELECT m.checkpoint_num, coalesce(n, 0)::BIGINT AS n, mean, std, min::DOUBLE AS min, p25, median, p75, p95,
               max::DOUBLE AS max, accuracy,
               CASE WHEN n > 0 THEN 'OK' ELSE 'FAILED' END AS status
        FROM checkpoints m LEFT JOIN (
          SELECT checkpoint_num, {_STATS}, round(avg(is_correct::INT), 6) AS accuracy FROM checkpoint_runs GROUP BY 1) s
        ON m.checkpoint_num = s.checkpoint_num""",
    "checkpoints",
)
def checkpoint_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = _r6(_sweep(spark, sf).summary, *_STAT_DOUBLES, "accuracy")
    return summary.withColumns({c: F.col(c).cast("double") for c in ("min", "max")})


@query(
    "SELECT checkpoint_num, round(avg(output_tokens), 6) AS mean_length FROM checkpoint_runs GROUP BY 1",
    "checkpoint_runs",
)
def mean_length_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(_sweep(spark, sf).mean_length, "mean_length")


@query(
    "SELECT checkpoint_num, round(100 * avg(is_correct::INT), 6) AS accuracy_pct FROM checkpoint_runs GROUP BY 1",
    "checkpoint_runs",
)
def accuracy_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(_sweep(spark, sf).accuracy, "accuracy_pct")


def _pass_sql(divisor: str) -> str:
    return f"""SELECT sft_epoch, rl_step, count(*)::BIGINT AS problems, round(sum(share), 6) AS problems_solved,
                      round(avg(share), 6) AS accuracy
               FROM (SELECT sft_epoch, rl_step, problem_id, sum(is_correct::INT) / {divisor} AS share
                     FROM rl_runs GROUP BY 1, 2, 3) p GROUP BY 1, 2"""


@query(_pass_sql(str(NUM_GEN)), "rl_runs")
def pass_at_1(spark: SparkSession, sf: str) -> DataFrame:
    result = accuracy.pass_at_1(fixture(spark, sf, "rl_runs"), ["sft_epoch", "rl_step"], NUM_GEN)
    return _r6(result, "problems_solved", "accuracy")


@query(_pass_sql("count(*)"), "rl_runs")
def pass_at_1_actual(spark: SparkSession, sf: str) -> DataFrame:
    result = accuracy.pass_at_1(fixture(spark, sf, "rl_runs"), ["sft_epoch", "rl_step"])
    return _r6(result, "problems_solved", "accuracy")


def _rl_sweep(spark: SparkSession, sf: str):
    return sweep_accuracy(fixture(spark, sf, "rl_runs"), NUM_GEN, STEPS)


@query(
    f"SELECT sft_epoch, rl_step, round(100 * accuracy, 4) AS accuracy_pct FROM ({_pass_sql(str(NUM_GEN))}) a", "rl_runs"
)
def rl_series(spark: SparkSession, sf: str) -> DataFrame:
    return _rl_sweep(spark, sf).series.withColumn("accuracy_pct", F.round("accuracy_pct", 4))


def _grid_sql(cell: str) -> str:
    cells = ", ".join(cell.format(f"max(accuracy) FILTER (WHERE rl_step = {s})", s) for s in STEPS)
    return f"SELECT sft_epoch, {cells} FROM ({_pass_sql(str(NUM_GEN))}) a GROUP BY sft_epoch"


@query(_grid_sql("round(100 * {0}, 4) AS step_{1}"), "rl_runs")
def rl_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = _rl_sweep(spark, sf).grid
    return grid.withColumns({f"step_{s}": F.round(f"step_{s}", 4) for s in STEPS})


@query(_grid_sql("coalesce(printf('%.1f', 100 * {0}), 'n/a') AS step_{1}"), "rl_runs")
def rl_grid_text(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.grid_text(_rl_sweep(spark, sf).grid)


@query("SELECT DISTINCT rl_step::BIGINT AS rl_step FROM rl_runs", "rl_runs")
def rl_steps(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoints.distinct_steps(fixture(spark, sf, "rl_runs"))


@query(
    """SELECT t.doc_id, CAST(floor(t.pos / 4) AS BIGINT) AS problem_id, CAST(t.pos % 4 AS INT) AS sample_idx,
              t.text, e.solution
       FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) t
       JOIN problems e ON e.id = CAST(floor(t.pos / 4) AS BIGINT)""",
    "problems",
)
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = base(spark, sf, "documents").select("doc_id", "text")
    texts = prepare.from_position(order.with_position(order.column_order(docs, "doc_id")), 4).drop("position")
    solutions = fixture(spark, sf, "problems").select(F.col("id").alias("problem_id"), "solution")
    # At most four texts to a problem: no key can be hot.
    return keyed_join(texts, solutions, "problem_id", spread_by=["doc_id"], hot_rows=None)


# Answers.


@query(
    f"""SELECT id, sample_idx, {_boxed_sql('generated_solution')} AS answer FROM generations""",
    "generations",
)
def boxed_answer(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("generated_solution")
    return fixture(spark, sf, "generations").select("id", "sample_idx", TF.last_boxed(text).alias("answer"))


@query(
    f"""SELECT id, sample_idx, level, type, match_type IN ('exact', 'numeric_equiv') AS is_correct, match_type,
               {_boxed_sql('generated_solution')} AS generated_answer, {_boxed_sql('solution')} AS ground_truth_answer,
               output_tokens, prompt_tokens
        FROM ({_SCORED}) s""",
    "generations",
    "problems",
)
def answer_match(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_samples(fixture(spark, sf, "generations"), fixture(spark, sf, "problems"))


_SCORED_GENERATIONS = f"""SELECT id, match_type IN ('exact', 'numeric_equiv') AS is_correct, match_type, output_tokens,
    prompt_tokens FROM ({_SCORED}) s"""


@query(_report_sql(_VERDICTS.format(samples=f"({_SCORED_GENERATIONS})")), "generations", "problems")
def scored_report(spark: SparkSession, sf: str) -> DataFrame:
    """Extract, match, join and report in one go."""
    results = scoring.score_samples(fixture(spark, sf, "generations"), fixture(spark, sf, "problems"))
    result = accuracy.accuracy_report(accuracy.problem_verdicts(results))
    return _r6(result, "accuracy", "avg_output_tokens", "avg_prompt_tokens")


@query(
    f"""SELECT id, sample_idx, level, type,
               coalesce(TRY_CAST(pred AS DOUBLE) = TRY_CAST(gold AS DOUBLE), FALSE) AS is_correct,
               CASE WHEN TRY_CAST(pred AS DOUBLE) IS NULL OR TRY_CAST(gold AS DOUBLE) IS NULL
                    THEN 'parse_failure' ELSE 'numeric' END AS match_type,
               {_boxed_sql('generated_solution')} AS generated_answer, {_boxed_sql('solution')} AS ground_truth_answer,
               output_tokens, prompt_tokens
        FROM ({_ANSWERS}) a""",
    "generations",
    "problems",
)
def custom_verifier(spark: SparkSession, sf: str) -> DataFrame:
    """Answers judged by a caller's Python function, which sees each distinct pair once.

    The function is local so that it is shipped to the workers whole, wherever they run.
    """

    def numbers_equal(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
        left, right = pd.to_numeric(pred, errors="coerce"), pd.to_numeric(gold, errors="coerce")
        readable = left.notna() & right.notna()
        label = readable.map({True: "numeric", False: "parse_failure"})
        return pd.DataFrame({"is_correct": readable & (left == right), "match_type": label})

    rows, problems = fixture(spark, sf, "generations"), fixture(spark, sf, "problems")
    return scoring.score_samples_with(rows, problems, numbers_equal)


@query("SELECT id, same AS is_correct FROM notations", "notations")
def notation_match(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in other spellings - expressions, intervals, tuples, sets, matrices, units - against verdicts given by hand."""
    rows = fixture(spark, sf, "notations")
    problems, samples = rows.select("id", "solution"), rows.select("id", "generated_solution")
    return scoring.score_samples(samples, problems, symbolic=True).select("id", "is_correct")


# Streams.


@query(_report_sql(_VERDICTS.format(samples=f"({_SCORED_GENERATIONS})")), "generations", "problems")
def streamed_report(spark: SparkSession, sf: str) -> DataFrame:
    """Generations scored as a stream of several files in three batches, and the report on what has arrived.

    There are as many files as their size asks for, as a task writes each; not more batches, as each reads all problems.
    """
    rows, place = fixture(spark, sf, "generations").drop("is_correct", "match_type"), _run_dir(spark, "stream")
    files = max(STREAM_BATCHES, -(-measure(rows, ["id"]) // STREAM_FILE_BYTES))
    rows.repartition(files, "id", "sample_idx").write.json(f"{place}/in")
    files = len(read_jsonl(spark, f"{place}/in", rows.schema).inputFiles())
    stream = stream_jsonl(spark, f"{place}/in", rows.schema, files_per_batch=-(-files // STREAM_BATCHES))
    stream_scores(stream, fixture(spark, sf, "problems"), f"{place}/out", checkpoint=f"{place}/progress").awaitTermination()
    result = accuracy.accuracy_report(accuracy.problem_verdicts(spark.read.parquet(f"{place}/out")))
    return _r6(result, "accuracy", "avg_output_tokens", "avg_prompt_tokens")


@query(f"SELECT id, sample_idx, prompt_tokens, output_tokens FROM generations WHERE prompt_tokens + output_tokens <= {MAX_TOKENS}", "generations")
def streamed_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The length filter over files as they arrive, two runs to the same output."""
    rows, place = fixture(spark, sf, "generations").select("id", "sample_idx", "prompt_tokens", "output_tokens"), _run_dir(spark, "lengths")
    for part in (0, 1):
        write_jsonl(rows.where(F.col("id") % 2 == part), f"{place}/in/part={part}")
        stream = stream_jsonl(spark, f"{place}/in/part=*", rows.schema, files_per_batch=1)
        stream_length_filter(stream, f"{place}/out", MAX_TOKENS, checkpoint=f"{place}/progress").awaitTermination()
    return read_jsonl(spark, f"{place}/out", rows.schema)


# Rollouts.


@query("SELECT id, sample_idx, CASE WHEN is_correct THEN 1 ELSE 0 END AS reward FROM generations", "generations")
def reward(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "generations").select("id", "sample_idx", rollouts.binary_reward(F.col("is_correct")).alias("reward"))


@query(
    """SELECT id, sample_idx, output_tokens,
              round(CASE WHEN output_tokens <= 200 THEN 0 WHEN output_tokens >= 1000 THEN -0.5 ELSE -0.5 * (output_tokens - 200) / 800 END, 6)::DOUBLE AS penalty
       FROM generations""",
    "generations",
)
def overlong_penalty(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "generations")
    return rows.select("id", "sample_idx", "output_tokens", F.round(rollouts.overlong_penalty(F.col("output_tokens"), 1000, 800, 0.5), 6).alias("penalty"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), -50, -1), ' ') AS prompt FROM documents")
def left_truncate(spark: SparkSession, sf: str) -> DataFrame:
    tokens = rollouts.left_truncate(F.split("text", " "), 50)
    return base(spark, sf, "documents").select("doc_id", F.array_join(tokens, " ").alias("prompt"))


@query(
    """SELECT sft_epoch, rl_step, problem_id, is_correct,
              round(CASE WHEN n > 1 THEN (r - m) / (s + 1e-6) ELSE 0 END, 6) AS advantage
       FROM (SELECT *, count(*) OVER g AS n, avg(r) OVER g AS m, coalesce(stddev_samp(r) OVER g, 0) AS s
             FROM (SELECT *, is_correct::INT::DOUBLE AS r FROM rl_runs) a
             WINDOW g AS (PARTITION BY sft_epoch, rl_step, problem_id)) b""",
    "rl_runs",
)
def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "rl_runs").withColumn("reward", rollouts.binary_reward(F.col("is_correct")))
    found = rollouts.group_advantages(rows, ["sft_epoch", "rl_step", "problem_id"])
    return found.drop("reward").withColumn("advantage", F.round("advantage", 6))


# Report text.


def _lines_sql() -> str:
    pct = "printf('%.2f%%', 100 * {0})"
    head = [
        "'# MATH Evaluation Report'", "'- Model: `Some/Model-1.5B`'", "'- Dataset source: `documents`'",
        "'- Split: `test`'", "'- Subset: `all`'", f"'- Generated at: `{RUN_TS.isoformat()}`'", "''", "'## Overall'",
        f"concat('- Accuracy: **', {pct.format('accuracy')}, '**')",
        "concat('- Correct: **', correct, ' / ', total, '**')",
        "concat('- Avg output tokens: **', printf('%.1f', avg_output_tokens), '**')",
        "concat('- Avg prompt tokens: **', printf('%.1f', avg_prompt_tokens), '**')",
        f"concat('- Parse Failures: **', parse_failures, '** (', {pct.format('parse_failures / total_samples')}, ')')",
        "''",
    ]
    blocks = [
        f"SELECT 0 AS a, '' AS b, {i} AS c, {line} AS line FROM report WHERE section = 'overall'"
        for i, line in enumerate(head)
    ]
    for a, title in ((1, "Level"), (2, "Type")):
        table = [f"## Accuracy by {title}", f"| {title} | Accuracy | Correct | Total |", "|---|---:|---:|---:|"]
        blocks += [f"SELECT {a}, '', {i}, '{line}'" for i, line in enumerate(table)]
        row = f"concat('| ', key, ' | ', {pct.format('accuracy')}, ' | ', correct, ' | ', total, ' |')"
        blocks.append(f"SELECT {a}, key, 10, {row} FROM report WHERE section = '{title.lower()}'")
    blocks.append("SELECT 1, chr(1000), 0, ''")
    lines = "\nUNION ALL ".join(blocks)
    return f"""SELECT row_number() OVER (ORDER BY a, b, c)::INT AS line_no, line
               FROM ({lines}) x"""


def _lines_oracle() -> str:
    report_cte = _report_sql(_GIVEN_VERDICTS, rounded=False)
    return f"SELECT * FROM (WITH report AS ({report_cte}) {_lines_sql()}) y"


@query(_lines_oracle(), "generations", "problems")
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    result = accuracy.accuracy_report(_verdicts(spark, sf))
    return report_lines(result, "Some/Model-1.5B", "documents", "test", "all", RUN_TS)
