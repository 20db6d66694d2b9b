"""Queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import hnsw, html_extract, lang_id, lexical_search, quality, toxicity, url_filter, whitening
from tallyframe.llm.decontaminate import leaks
from tallyframe.llm.jaccard_join import near_duplicate_components
from tallyframe.llm.line_dedup import drop_repeated_lines
from tallyframe.llm.mixing import mix, token_count
from tallyframe.llm.sampling import fold
from tallyframe.llm.warc import archive_and_read

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated lines: counts and a digest of the text that is left."""
    deduped = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def labels_of(spark: SparkSession, sf_dir: str, column: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows whose id does not fall in fold ``held``."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), folds) != held)
    return labels.select("doc_id", F.col(column).alias("label"))


def _folded(spark: SparkSession, sf_dir: str, folds: int, held: int) -> DataFrame:
    """Documents with ``held_out``, true for the rows whose id falls in fold ``held``."""
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("held_out", fold(F.col("doc_id"), folds) == held)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _folded(spark, sf_dir, 4, 2)
    return lang_id.identify(docs, lang_id.fit(docs.where("NOT held_out")), ["doc_id", "held_out"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, archived and read back."""
    records = archive_and_read(table(spark, sf_dir, "pages"), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_texts(pages, html_extract.fit(pages))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _folded(spark, sf_dir, 3, 1)
    model = quality.fit(docs, labels_of(spark, sf_dir, "quality", 3, 1))
    return quality.score(docs, model, ["doc_id", "held_out"])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _folded(spark, sf_dir, 5, 0)
    model = toxicity.fit(docs, labels_of(spark, sf_dir, "toxic", 5, 0))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


NEAREST = 5


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    index = hnsw.build_index(vectors, NEAREST)
    return hnsw.search(index, vectors.where("vec_id % 50 = 0"), NEAREST)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicate_components(table(spark, sf_dir, "documents"))


# Sources by fives make a domain; target weights by level.
MIX_WEIGHTS = {
    "domain": {"d0": 2, "d1": 5, "d2": 2, "d3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src5": 3, "src10": 2},
}
MIX_SHARE = (3, 5)


def mix_levels() -> dict[str, Column]:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)")
    return {"domain": F.concat(F.lit("d"), F.floor(number / 5)), "lang": F.col("lang"), "source": F.col("source")}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs that a budget of three fifths of all tokens selects."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE)
    return mixed.select("doc_id", "lang", "source", "epoch", token_count(F.col("text")).alias("tokens"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings: every usable vector's place along up to 16 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of highest lexical score for each benchmark item, among all documents."""
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


# Rules for hosts and their subdomains, by the start of the path.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "labelled", "blocked")


_ALL = (
    op1_line_dedup,
    op2_language_id,
    op3_warc,
    op4_html_extraction,
    op5_quality,
    op6_mixing,
    op7_decontaminate,
    op8_toxicity,
    op9_nearest,
    op10_jaccard_join,
    op11_whitening,
    op12_lexical_search,
    op13_url_filter,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

# One word of a line left out: the words before it and the words after it.
_OP1_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
), worded AS (
    SELECT doc_id, line, raw, regexp_split_to_array(trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS words FROM lines
), firsts AS (
    SELECT words, len(words) AS n, min((doc_id, line)) AS first FROM worded WHERE len(words) >= 5 GROUP BY words
), variants AS (
    SELECT first, n - 1 AS len, pos, list_concat(words[1:pos - 1], words[pos + 1:]) AS rest
    FROM firsts, LATERAL (SELECT unnest(range(1, n + 1)) AS pos) WHERE n >= 10
    UNION ALL SELECT first, n, 0, words FROM firsts WHERE n >= 10
), near AS (
    SELECT a.first FROM variants a JOIN variants b ON a.len = b.len AND a.rest = b.rest AND (a.pos = b.pos OR a.pos = 0 OR b.pos = 0)
    WHERE b.first < a.first
), decided AS (
    SELECT doc_id, line, raw, coalesce((doc_id, line) != f.first OR f.first IN (SELECT first FROM near), false) AS gone
    FROM worded w LEFT JOIN firsts f ON w.words = f.words
)
SELECT d.doc_id, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(l.kept, '')) END AS text_md5
FROM documents d LEFT JOIN (
    SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (WHERE gone)::INT AS n_dropped,
           string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT gone) AS kept FROM decided GROUP BY doc_id
) l ON d.doc_id = l.doc_id
"""


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {w}" for name, w in MIX_WEIGHTS[level].items())
    return f"CASE {level} {cases} ELSE 1 END"


def _share_sql(level: str, above: list[str], parents: str) -> str:
    """Budgets of one level: each child gets its share of what the children that fill up before it leave."""
    by, keys = ", ".join(above), ", ".join([*above, level])
    part = f"PARTITION BY {by}" if above else ""
    return f"""{level}_nodes AS (
    SELECT {keys}, sum(tokens) * 3 AS cap, {_weight_sql(level)} AS w FROM leaves GROUP BY {keys}
), {level}_ranked AS (
    SELECT n.*, p.budget, row_number() OVER ({part} ORDER BY cap / w, {level}) AS r,
           sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
           p.budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_left
    FROM {level}_nodes n JOIN {parents} p {"USING (" + by + ")" if above else "ON true"}
), {level}_open AS (
    SELECT {by + "," if above else ""} min(r) AS r, arg_min(b_left, r) AS b_open, arg_min(w_left, r) AS w_open
    FROM {level}_ranked WHERE cap * w_left > w * b_left {"GROUP BY " + by if above else ""}
), {level}_budget AS (
    SELECT {", ".join("n." + k for k in [*above, level])},
           CASE WHEN o.r IS NULL OR n.r < o.r THEN cap ELSE (w * b_open) // w_open END AS budget
    FROM {level}_ranked n LEFT JOIN {level}_open o ON {" AND ".join(["true", *(f"n.{k} = o.{k}" for k in above)])}
)"""


_OP6_SQL = rf"""
WITH d AS (
    SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
           coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) // 5), 'none') AS domain,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens
    FROM documents
), leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), root AS (SELECT (sum(tokens) * {MIX_SHARE[0]}) // {MIX_SHARE[1]} AS budget FROM leaves
), {_share_sql("domain", [], "root")}, {_share_sql("lang", ["domain"], "domain_budget")},
{_share_sql("source", ["domain", "lang"], "lang_budget")},
cut AS (
    SELECT domain, lang, source, (budget // tokens)::INT AS whole, budget % tokens AS rest
    FROM leaves JOIN source_budget USING (domain, lang, source) WHERE budget > 0 AND tokens > 0
), ordered AS (
    SELECT d.*, whole, rest,
           sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('42:', whole + 1, ':', doc_id)), doc_id) AS upto
    FROM d JOIN cut USING (domain, lang, source)
)
SELECT doc_id, lang0 AS lang, source0 AS source, unnest(range(1, 1 + whole + (rest > 0 AND upto <= rest)::INT))::INT AS epoch, tokens::BIGINT AS tokens
FROM ordered
"""

_OP12_TERMS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
_OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_OP12_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL
), postings AS (SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, unnest(terms) AS term FROM docs) d GROUP BY ALL
), lengths AS (SELECT row, len(terms) AS n FROM docs WHERE len(terms) > 0
), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), norms AS (SELECT row, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM lengths, total
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term, n_docs
), asked AS (SELECT item_id, unnest({_OP12_TERMS.format("text")}) AS term FROM benchmark
), scored AS (
    SELECT a.item_id, p.row, p.doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM (SELECT item_id, term, count(*) AS c FROM asked GROUP BY ALL) a JOIN postings p USING (term) JOIN weights USING (term) JOIN norms n ON p.row = n.row
    GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

ORACLES: dict[str, str] = {"op1_line_dedup": _OP1_SQL, "op6_mixing": _OP6_SQL, "op12_lexical_search": _OP12_SQL, "op13_url_filter": url_filter.oracle_sql(URL_RULES)}
