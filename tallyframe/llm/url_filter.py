"""URL filter by rules and by a tree of path templates per host, learned from the URLs that rules decide.

Each host has a tree of path segments. Segments that vary become wildcards: by their form (runs of digits, hexadecimal
names), and at a node with many children all those that few paths have. Branches of a node that go on alike and
whose labelled paths are blocked at rates that do not differ significantly are merged. A template, the way from the root to a
leaf, is rejected if the share of blocked paths among its labelled ones, smoothed towards a quarter, reaches four fifths.

All of it is columns and joins. The tree is built level by level over distinct path forms with their counts, a fraction
of the URLs; copies of a URL count once, and a host with most of the URLs is counted in parts before any
shuffle. Joins back to forms and URLs broadcast what is measured to be small and split hot keys beyond.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import keyed_join
from tallyframe.session import written

ALLOW, BLOCK = "allow", "block"
# Levels of the tree; the segments below them share one wildcard.
LEVELS = 6
# A child of a node with more than MANY_KIDS children is variable if fewer than FEW_PATHS paths have it.
MANY_KIDS = 8
FEW_PATHS = 5
# Labelled paths that a branch needs to be merged, bands of the blocked share, and the square of the deviation allowed.
MERGE_LABELLED = 5
BANDS = 5
DEVIATION = 4.0
# Smoothing (blocked + 1) / (labelled + 4), and the smoothed share from which a template is rejected, in fifths.
PRIOR_BLOCKED, PRIOR_LABELLED = 1, 4
REJECT_FIFTHS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = ["host", "prefix"]


def _after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z as a-z; empty without it."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits, null without one; equal lengths go by the alphabet.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    found = F.lit(None).cast("string")
    for rule in sorted({r for _, r in rules}, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The verdict of a rule, null for none."""
    return reduce(lambda rest, r: F.when(rule == r[1], r[0]).otherwise(rest), rules, F.lit(None).cast("string"))


def _form(segment: Column) -> Column:
    hexadecimal = F.rlike(segment, F.lit(r"^[0-9a-fA-F-]{8,}\z")) & F.rlike(segment, F.lit("[0-9]")) & F.rlike(segment, F.lit("[a-fA-F]"))
    return F.when(hexadecimal, "{x}").otherwise(F.regexp_replace(segment, "[0-9]+", "{n}"))


def path_form(path: Column) -> Column:
    """The path's segments without empty ones, joined by ``/``, with variable forms as wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.array_join(F.transform(segments, _form), "/")


def _segment(level: int) -> Column:
    """Segment of a form at a level; empty beyond its end."""
    return F.coalesce(F.get(F.split("form", "/"), F.lit(level)), F.lit(""))


def _labels(forms: DataFrame, level: int) -> DataFrame:
    """(host, prefix, seg, label): what stands for each segment of a level in the templates."""
    deeper = forms.where(_segment(level) != "").select(*_NODE, _segment(level).alias("seg"), _segment(level + 1).alias("next"), "n", "labelled", "blocked")
    ways = deeper.groupBy(*_NODE, "seg", "next").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    kids = ways.groupBy(*_NODE, "seg").agg(
        *[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], F.max(F.struct("n", "next"))["next"].alias("next")
    )
    band = F.floor(BANDS * (F.col("blocked") + 1) / (F.col("labelled") + 2))
    kids = written(kids.withColumn("band", band), "url_branches")
    crowded = kids.groupBy(*_NODE).agg(F.count("*").alias("kids")).where(F.col("kids") > MANY_KIDS)
    kids = keyed_join(kids, crowded, _NODE, "left").withColumn("varies", F.col("kids").isNotNull() & (F.col("n") < FEW_PATHS))
    fit = kids.where(~F.col("varies") & (F.col("labelled") >= MERGE_LABELLED))
    alike = [*_NODE, "next", "band"]
    groups = fit.groupBy(*alike).agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.count("*").alias("members"))
    kids = keyed_join(kids, groups, alike, "left")
    b, n, all_b, all_n = (F.col(c).cast("double") for c in ("blocked", "labelled", "all_blocked", "all_labelled"))
    off = b * all_n - n * all_b
    similar = ~F.col("varies") & (F.col("labelled") >= MERGE_LABELLED) & (F.col("members") > 1) & (off * off <= DEVIATION * n * all_b * (all_n - all_b))
    label = F.when(F.col("varies"), "*").when(similar, F.concat(F.lit("~"), F.col("band"), F.lit("("), F.col("next"), F.lit(")"))).otherwise(F.col("seg"))
    return kids.select(*_NODE, "seg", label.alias("label"))


def templates(forms: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(host, form, template, n, labelled, blocked) of path forms (host, form, n, labelled, blocked), each pair once.

    The counts returned are those of the template. Segments from ``levels`` on stand as ``**``.
    """
    state = written(forms.withColumn("prefix", F.lit("")), "url_forms")
    depth = F.when(F.col("form") == "", 0).otherwise(F.size(F.split("form", "/")))
    deepest = state.agg(F.max(depth)).first()[0] or 0
    for level in range(min(levels, deepest)):
        # What ends above this level has the label of the empty segment, which is none.
        labelled = keyed_join(state.withColumn("seg", _segment(level)), _labels(state, level), [*_NODE, "seg"], "left")
        prefix = F.when(F.col("label").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "label"))
        state = written(labelled.select("host", "form", prefix.alias("prefix"), "n", "labelled", "blocked"), "url_forms")
    tail = F.when(depth > levels, F.concat("prefix", F.lit("/**"))).otherwise(F.col("prefix"))
    named = state.select("host", "form", tail.alias("template"), "n", "labelled", "blocked")
    counts = named.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    return keyed_join(named.select("host", "form", "template"), counts, ["host", "template"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", levels: int = LEVELS) -> DataFrame:
    """All columns of pages with host, path, rule, verdict, template, labelled and blocked.

    ``rules`` are pairs of a verdict and ``host/path``. Where a rule fits, the longest one decides. Else a URL is blocked if its
    template is rejected, and allowed if not; templates without labelled paths are never rejected. Columns
    of the input with the names of new ones are replaced.

    A null URL or one without ``://`` has an empty host and path. Rows that repeat a URL all get its verdict,
    and it counts once in the tree. URLs of any length are read whole; an empty table gives an empty result.
    """
    added = ["host", "path", "rule", "verdict", "template", "labelled", "blocked"]
    taken = [c for c in pages.columns if c not in added or c == url]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(taken)])
    place = F.col(f"in_{taken.index(url)}")
    rows = rows.withColumns({"host": host_of(place), "path": path_of(place)})
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "form": path_form(F.col("path"))})
    blocked = verdict_of(F.col("rule"), rules) == BLOCK
    paths = rows.groupBy("host", "path", "form", "rule").agg(F.lit(1).alias("one")).drop("one")
    forms = paths.groupBy("host", "form").agg(
        F.count("*").alias("n"), F.count("rule").alias("labelled"), F.count_if(blocked).alias("blocked")
    )
    known = templates(forms, levels).drop("n")
    rejected = (F.col("blocked") + PRIOR_BLOCKED) * 5 >= (F.col("labelled") + PRIOR_LABELLED) * REJECT_FIFTHS
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(rejected, BLOCK).otherwise(ALLOW))
    judged = keyed_join(rows, known, ["host", "form"], "left").withColumn("verdict", verdict)
    return judged.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(taken) if c not in added], *added)


def oracle_sql(rules: Sequence[tuple[str, str]], levels: int = LEVELS) -> str:
    """DuckDB SQL for ``judge`` over a table pages (page_id, url); a chain of tables for each level."""
    ordered = sorted({r for _, r in rules}, key=lambda r: (-len(r), r))
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
        for h, _, p in (r.partition("/") for r in ordered)
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in rules)
    steps = "".join(_level_sql(level) for level in range(levels))
    return rf"""
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages
), parsed AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rows AS (
    SELECT *, CASE {fits} END AS rule, array_to_string([
        CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{{8,}}\z') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-fA-F]') THEN '{{x}}'
             ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END FOR s IN string_split(path, '/') IF s != ''], '/') AS form
    FROM parsed
), s0 AS (
    SELECT host, form, '' AS prefix, string_split(form, '/') AS segs, count(*) AS n, count(rule) AS labelled,
           count(*) FILTER (WHERE CASE rule {verdicts} END = '{BLOCK}') AS blocked
    FROM (SELECT DISTINCT host, path, form, rule FROM rows) p GROUP BY ALL
), {steps}
named AS (
    SELECT host, form, labelled, blocked, prefix || CASE WHEN form != '' AND len(segs) > {levels} THEN '/**' ELSE '' END AS template FROM s{levels}
), counts AS (SELECT host, template, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM named GROUP BY ALL)
SELECT r.page_id, r.host, r.path, r.rule, n.template, c.labelled, c.blocked,
       coalesce(CASE r.rule {verdicts} END,
                CASE WHEN 5 * (c.blocked + {PRIOR_BLOCKED}) >= {REJECT_FIFTHS} * (c.labelled + {PRIOR_LABELLED}) THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict
FROM rows r JOIN named n USING (host, form) JOIN counts c USING (host, template)
"""


def _level_sql(i: int) -> str:
    counts = "sum(n)::BIGINT AS n, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked"
    return f"""ways{i} AS (
    SELECT host, prefix, segs[{i + 1}] AS seg, coalesce(segs[{i + 2}], '') AS next, {counts} FROM s{i} WHERE segs[{i + 1}] != '' GROUP BY ALL
), kids{i} AS (
    SELECT host, prefix, seg, {counts}, arg_max(next, (n, next)) AS next,
           floor({BANDS} * (sum(blocked) + 1) / (sum(labelled) + 2))::BIGINT AS band
    FROM ways{i} GROUP BY host, prefix, seg
), told{i} AS (
    SELECT *, count(*) OVER (PARTITION BY host, prefix) > {MANY_KIDS} AND n < {FEW_PATHS} AS varies FROM kids{i}
), groups{i} AS (
    SELECT host, prefix, next, band, sum(labelled)::DOUBLE AS all_n, sum(blocked)::DOUBLE AS all_b, count(*) AS members
    FROM told{i} WHERE NOT varies AND labelled >= {MERGE_LABELLED} GROUP BY ALL
), labels{i} AS (
    SELECT t.host, t.prefix, t.seg, CASE WHEN varies THEN '*'
        WHEN labelled >= {MERGE_LABELLED} AND members > 1 AND (blocked * all_n - labelled * all_b) ** 2 <= {DEVIATION} * labelled * all_b * (all_n - all_b)
        THEN '~' || t.band || '(' || t.next || ')' ELSE seg END AS label
    FROM told{i} t LEFT JOIN groups{i} g ON t.host = g.host AND t.prefix = g.prefix AND t.next = g.next AND t.band = g.band
), s{i + 1} AS (
    SELECT s.host, s.form, s.prefix || coalesce('/' || l.label, '') AS prefix, s.segs, s.n, s.labelled, s.blocked
    FROM s{i} s LEFT JOIN labels{i} l ON s.host = l.host AND s.prefix = l.prefix AND s.segs[{i + 1}] = l.seg
), """
