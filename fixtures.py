"""Tables of the library's input schemas, derived from the given parquet tables.

Each block is one SELECT that runs unchanged in Spark and in DuckDB. Every row of the base tables
is used; no block filters, caps or shortens anything. FIXTURES.md explains them.
"""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Pairs of spellings and whether they mean the same, decided by hand: #n, #m, #q, #p stand for n, 2n, n * n and n + 1,
# and ~ for a backslash.
NOTATIONS = (
    ("(x+#n)^2", "x^2+#mx+#q", True),
    ("(x+#n)^2", "x^2+#mx+#p", False),
    ("~sqrt{8}", "2~sqrt2", True),
    ("~sqrt{#q}", "#n", True),
    ("[0, ~frac{#m}{2})", "[0,#n)", True),
    ("[0,#n]", "[0,#n)", False),
    ("(#n, ~frac{1}{2})", "(#n,0.5)", True),
    ("(#n,#m)", "(#m,#n)", False),
    ("~{#m, #n~}", "~{#n, #m.0~}", True),
    ("#n, #p", "#p, #n", True),
    ("~begin{pmatrix}#n&1~~0&x+x~end{pmatrix}", "~begin{bmatrix} #n & 1 ~~ 0 & 2x ~end{bmatrix}", True),
    ("~begin{pmatrix}#n&1~~0&2~end{pmatrix}", "~begin{pmatrix}#n&0~~1&2~end{pmatrix}", False),
    ("(-~infty,0)~cup[#n,~infty)", "(-~infty, 0) ~cup [~frac{#m}{2}, ~infty)", True),
    ("(-~infty,0)~cup[#n,~infty)", "(-~infty,0)~cup(#n,~infty)", False),
    ("#n~text{ cm}", "#n", True),
    ("#n~%", "#n", True),
    ("#n~frac{1}{2}", "#n.5", True),
    ("~mathrm{east}", "~text{east}", True),
    ("~text{east}", "~text{seat}", False),
    ("~frac{x}{#n}+~frac{x}{#n}", "~frac{2x}{#n}", True),
    ("x^{-#n}", "~frac{1}{x^{#n}}", True),
    ("#n~pi r", "r ~cdot ~pi ~cdot #n", True),
    ("y=#nx", "x~times #n", True),
    ("x+#n", "x-#n", False),
    ("-~frac{-1}{#n}", "~frac{1}{#n}", True),
    ("#n{,}000", "#n000", True),
    ("~frac{~sqrt{3}}{3}", "~frac{1}{~sqrt{3}}", True),
    ("f(x)", "g(x)", False),
    ("#n00000001x", "#n00000000x", False),
)


def _notation_rows() -> str:
    return ", ".join(f"({i}, '{pred}', '{gold}', {str(same).upper()})" for i, (pred, gold, same) in enumerate(NOTATIONS))


def _spelled(template: str) -> str:
    n = "(2 + doc_id % 40)"
    for mark, value in (("#n", n), ("#m", f"2 * {n}"), ("#q", f"{n} * {n}"), ("#p", f"1 + {n}")):
        template = f"replace({template}, '{mark}', CAST({value} AS VARCHAR(20)))"
    return f"replace({template}, '~', chr(92))"


FIXTURES = {
    # One problem per document; `type` is unnormalised on purpose. Every third answer is above 10^10, so
    # that a wrong one differs by one part in 10^10.
    "problems": """
        SELECT doc_id AS id,
               text AS problem,
               concat('The answer is ', chr(92), 'boxed{', CAST(doc_id % 10 + CASE WHEN doc_id % 3 = 0 THEN 10000000000 ELSE 0 END AS VARCHAR(20)), '}.') AS solution,
               concat('Level ', CAST(1 + n_chars % 5 AS VARCHAR(20))) AS level,
               CASE lang WHEN 'en' THEN 'Algebra' WHEN 'fr' THEN 'Counting & Probability'
                         WHEN 'de' THEN ' Number Theory' ELSE 'Intermediate Algebra ' END AS type
        FROM documents""",
    # Each document is one sample. Ten documents in a row belong to four problems, with 4, 3, 2 and
    # 1 samples; the last of them is an orphan whose problem does not exist.
    "samples": """
        SELECT d.doc_id, d.text, d.n_chars, l.quality,
               d.doc_id - d.doc_id % 10 + CASE WHEN d.doc_id % 10 < 4 THEN 0 WHEN d.doc_id % 10 < 7 THEN 4
                    WHEN d.doc_id % 10 < 9 THEN 7 ELSE 1000000009 END AS id,
               CAST(d.doc_id % 10 - CASE WHEN d.doc_id % 10 < 4 THEN 0 WHEN d.doc_id % 10 < 7 THEN 4
                    WHEN d.doc_id % 10 < 9 THEN 7 ELSE 9 END AS INT) AS sample_idx
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # quality 1 writes the right answer, 0 a wrong one, no label no answer at all. The answer comes
    # in one of four forms: boxed, boxed fraction, second box with a decimal, plain.
    "generations": """
        SELECT id, sample_idx,
               concat(text, CASE
                 WHEN quality IS NULL THEN ''
                 WHEN sample_idx = 0 THEN concat(' so ', chr(92), 'boxed{', CAST(id % 10 + CASE WHEN id % 3 = 0 THEN 10000000000 ELSE 0 END + 1 - quality AS VARCHAR(20)), '}')
                 WHEN sample_idx = 1 THEN concat(' so ', chr(92), 'boxed{', chr(92), 'frac{', CAST(2 * (id % 10 + CASE WHEN id % 3 = 0 THEN 10000000000 ELSE 0 END + 1 - quality) AS VARCHAR(20)), '}{2}}')
                 WHEN sample_idx = 2 THEN concat(' try ', chr(92), 'boxed{99} no, ', chr(92), 'boxed{', CAST(id % 10 + CASE WHEN id % 3 = 0 THEN 10000000000 ELSE 0 END + 1 - quality AS VARCHAR(20)), '.0}')
                 ELSE concat(' so the answer is ', CAST(id % 10 + CASE WHEN id % 3 = 0 THEN 10000000000 ELSE 0 END + 1 - quality AS VARCHAR(20))) END) AS generated_solution,
               CAST(20 + n_chars % 97 AS BIGINT) AS prompt_tokens,
               CAST(floor(n_chars / 4) AS BIGINT) AS output_tokens,
               CASE WHEN quality = 1 THEN TRUE ELSE FALSE END AS is_correct,
               CASE WHEN quality IS NULL THEN 'parse_failure' ELSE 'sympy_equiv' END AS match_type
        FROM samples""",
    # One pair of spellings per document, with the verdict given by hand.
    "notations": f"""
        SELECT doc_id AS id,
               concat('so ', chr(92), 'boxed{{', {_spelled('v.pred')}, '}}') AS generated_solution,
               concat('It is ', chr(92), 'boxed{{', {_spelled('v.gold')}, '}}.') AS solution, v.same
        FROM documents d JOIN (VALUES {_notation_rows()}) AS v(place, pred, gold, same) ON d.doc_id % {len(NOTATIONS)} = v.place""",
    # Checkpoint = trailing number of the source.
    "checkpoint_runs": """
        SELECT CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INT) AS checkpoint_num,
               d.doc_id AS problem_id,
               CAST(floor(d.n_chars / 4) AS BIGINT) AS output_tokens,
               CASE WHEN l.quality = 1 THEN TRUE ELSE FALSE END AS is_correct
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # The manifest names one checkpoint more, which has no rows.
    "checkpoints": """
        SELECT DISTINCT checkpoint_num FROM checkpoint_runs
        UNION ALL SELECT 1 + max(checkpoint_num) AS checkpoint_num FROM checkpoint_runs""",
    # Four epochs by five steps. Source 7 counts for the cell of source 3, so cell (10, 40) is
    # empty. A problem has six or seven samples per cell.
    "rl_runs": """
        SELECT CASE cell % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 10 END AS sft_epoch,
               CAST(20 * (1 + floor(cell / 4)) AS INT) AS rl_step,
               CAST(floor(problem_id / 130) AS BIGINT) AS problem_id,
               is_correct
        FROM (SELECT CASE checkpoint_num WHEN 7 THEN 3 ELSE checkpoint_num END AS cell, problem_id, is_correct
              FROM checkpoint_runs) c""",
}

NEEDS = {
    "generations": ("samples",),
    "checkpoints": ("checkpoint_runs",),
    "rl_runs": ("checkpoint_runs",),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in [*_closure(NEEDS.get(name, ())), name] if n not in ordered]
    return ordered


def with_fixtures(names: tuple[str, ...], query: str) -> str:
    """The query with the named fixtures as CTEs, for DuckDB and Spark alike."""
    if not names:
        return query
    ctes = ",\n".join(f"{name} AS ({FIXTURES[name]})" for name in _closure(names))
    return f"WITH {ctes}\n{query}"


# Read schemas, so that no query starts with a job that looks for one.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=64)
def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture's plan; it is parsed once per session, its rows are not kept."""
    for table in ("documents", "labels"):
        base(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(with_fixtures((name,), f"SELECT * FROM {name}"))
