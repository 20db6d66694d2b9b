"""Column expressions on text, counts and timestamps. All are built-in, JVM-side expressions."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The prompt around a problem text.
PROMPT_HEAD = (
    "Solve the following math problem step by step. "
    "Show your reasoning and provide the final answer.\n\nProblem: "
)
PROMPT_TAIL = "\n\nSolution:"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends; ``trim`` alone removes only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def math_prompt(problem: Column) -> Column:
    """Prompt text for a problem; a null problem stays null."""
    return F.concat(F.lit(PROMPT_HEAD), problem, F.lit(PROMPT_TAIL))


def normalize_type(value: Column) -> Column:
    """Category key: ``' Counting & Probability'`` becomes ``counting_and_probability``."""
    lowered = F.lower(strip(value))
    return F.replace(F.replace(lowered, F.lit("&"), F.lit("and")), F.lit(" "), F.lit("_"))


def slug(value: Column) -> Column:
    """Lower-case name with each run of other characters as one inner ``_``."""
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), F.lit("_"))


def file_slug(path: Column) -> Column:
    """Slug of a path's last segment: one ``_`` per replaced character, outer ones kept."""
    base = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return F.regexp_replace(F.lower(base), "[^a-z0-9_]", "_")


def token_count(token_ids: Column) -> Column:
    return F.size(token_ids)


def word_count(text: Column) -> Column:
    """Whitespace-separated words, for tables that carry text but no token ids."""
    return F.regexp_count(text, F.lit(r"\S+"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0.0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text without thousands separators, ties to even."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def percent(share: Column, digits: int = 2) -> Column:
    """A share as percent text, such as ``12.50%``."""
    return F.concat(fixed(share * F.lit(100.0), digits), F.lit("%"))


def clock_time(moment: datetime) -> Column:
    """A Python time as a column that reads the same in every session time zone."""
    return F.lit(moment.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")


def _seconds(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; unlike ``date_format`` it does not move times without a zone."""
    return F.substring(ts.cast("string"), 1, 19)


def run_stamp(ts: Column) -> Column:
    """``yyyyMMdd_HHmmss``"""
    return F.translate(_seconds(ts), " -:", "_")


def iso_seconds(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``"""
    return F.translate(_seconds(ts), " ", "T")
