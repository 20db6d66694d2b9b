"""Answers made of several parts - lists, tuples, intervals, unions, sets, matrices - as native columns.

An answer is cut at the marks that give it its shape: commas outside all brackets, brackets that hold a comma with that
comma, set braces, the separators of a matrix, and unions. What lies between the marks are its leaves. Brackets without a
comma belong to an expression and stay in a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.answers import normalize_answer, numeric_answer

_MATRIX = r"\\(?:begin|end)\{[a-zA-Z]*matrix\}"
_MARK = _MATRIX + r"|\\\\|\\\{|\\\}|\\cup|∪|[()\[\]{},&]"
_PIECE = rf"((?:(?!{_MARK})[\s\S])*)({_MARK}|\z)"
_SPELLING = ((r"^\\(?:begin|end)\{[pb]?matrix\}$", "|"), (r"^\\cup$", "∪"))
_MARKS = "struct<stack:array<int>,marks:array<int>,ok:boolean>"
_CUT = "struct<cur:string,leaves:array<string>,shape:string>"


def _ints() -> Column:
    return F.array().cast("array<int>")


def _marked(delims: Column) -> Column:
    """(marks, ok): places of the marks that give the shape; not ok where brackets do not fit."""

    def step(s: Column, i: Column) -> Column:
        d = F.element_at(delims, i + 1)
        top = F.try_element_at(s["stack"], F.lit(-1))
        opens = d.isin("(", "[", "{", "\\{") | F.startswith(d, F.lit("\\begin"))
        closes = d.isin(")", "]", "}", "\\}") | F.startswith(d, F.lit("\\end"))
        outside = F.size(s["stack"]) == 0
        inside_argument = F.coalesce(F.element_at(delims, F.coalesce(top, F.lit(0)) + 1) == "{", F.lit(False)) & ~outside
        comma = (d == ",") & ~inside_argument
        always = d.isin("\\{", "\\\\", "&") | F.startswith(d, F.lit("\\begin"))
        mine = always | comma | (d.isin("\\cup", "∪") & outside) | (closes & F.coalesce(F.array_contains(s["marks"], top), F.lit(False)))
        added = F.concat(F.when(mine, F.array(i)).otherwise(_ints()), F.when(comma & ~outside, F.array(top)).otherwise(_ints()))
        stack = F.when(opens, F.concat(s["stack"], F.array(i))).when(closes, F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
        ok = s["ok"] & ~(closes & outside)
        return F.struct(stack.alias("stack"), F.array_union(s["marks"], added).alias("marks"), ok.alias("ok")).cast(_MARKS)

    start = F.struct(_ints().alias("stack"), _ints().alias("marks"), F.lit(True).alias("ok")).cast(_MARKS)
    places = F.sequence(F.lit(0), F.size(delims) - 1)
    return F.aggregate(places, start, step, lambda s: F.struct(s["marks"].alias("marks"), (s["ok"] & (F.size(s["stack"]) == 0)).alias("ok")))


def structure(answer: Column) -> Column:
    """(shape, leaves) of a normalised answer; one leaf and an empty shape where it has no parts or its brackets do not fit.

    Leaves of sets and of bare lists, whose order means nothing, are sorted by value and text.
    """
    bodies, delims = (F.regexp_extract_all(answer, F.lit(_PIECE), F.lit(i)) for i in (1, 2))

    def cut(marks: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            body, d = F.element_at(bodies, i + 1), F.element_at(delims, i + 1)
            mark = d
            for pattern, to in _SPELLING:
                mark = F.regexp_replace(mark, pattern, to)
            here = F.array_contains(marks["marks"], i) & marks["ok"]
            text = F.concat(s["cur"], body)
            parted = F.struct(F.lit("").alias("cur"), F.concat(s["leaves"], F.array(text)).alias("leaves"), F.concat(s["shape"], mark).alias("shape"))
            longer = F.struct(F.concat(text, d).alias("cur"), s["leaves"].alias("leaves"), s["shape"].alias("shape"))
            return F.when(here, parted.cast(_CUT)).otherwise(longer.cast(_CUT))

        start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("leaves"), F.lit("").alias("shape")).cast(_CUT)
        places = F.sequence(F.lit(0), F.size(delims) - 1)

        def end(s: Column) -> Column:
            leaves = F.transform(F.concat(s["leaves"], F.array(s["cur"])), lambda x: F.when(x == "", x).otherwise(F.coalesce(normalize_answer(x), x)))
            unordered = F.rlike(s["shape"], F.lit(r"^,+\z|^\\\{,*\\\}\z"))
            keyed = F.transform(leaves, lambda x: F.struct((x != "").alias("filled"), numeric_answer(x).isNull().alias("none"), numeric_answer(x).alias("value"), x.alias("text")))
            ordered = F.transform(F.array_sort(keyed), lambda x: x["text"])
            return F.struct(s["shape"].alias("shape"), F.when(unordered, ordered).otherwise(leaves).alias("leaves"))

        return F.aggregate(places, start, step, end)

    return F.element_at(F.transform(F.array(_marked(delims)), cut), 1)
