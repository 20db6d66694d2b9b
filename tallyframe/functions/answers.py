"""Final-answer extraction and matching as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import strip

# The box marker, and the two labels of a comparison without finer ones.
BOX_MARKER = "\\boxed"
PARSE_FAILURE = "parse_failure"
SINGLE_LABEL = "sympy_equiv"

EXACT = "exact"
NUMERIC = "numeric_equiv"
SYMBOLIC = "symbolic_equiv"
DIFFERENT = "different"

NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?(?:/\d+)?"
RELATIVE_TOLERANCE = 1e-9


def closed_box(text: Column) -> Column:
    """Content of the first brace group after the last box marker, null without a closed one.

    The tail is cut into pieces that each end in one brace, and a fold over the pieces tracks
    depth and character position, so the work is linear in the length of the tail.
    """
    tail = F.when(F.contains(text, F.lit(BOX_MARKER)), F.substring_index(text, BOX_MARKER, -1))
    pieces = F.regexp_extract_all(tail, F.lit(r"[^{}]*[{}]"), F.lit(0))
    nothing = F.lit(-1)
    start_state = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("pos"), nothing.alias("first"), nothing.alias("last")
    )

    def step(state: Column, piece: Column) -> Column:
        pos = state["pos"] + F.char_length(piece)
        opens = F.endswith(piece, F.lit("{"))
        depth = state["depth"] + F.when(opens, 1).otherwise(-1)
        running = state["last"] < 0
        begins = running & opens & (depth == 1)
        ends = running & ~opens & (depth == 0) & (state["first"] >= 0)
        return F.struct(
            depth.alias("depth"),
            pos.alias("pos"),
            F.when(begins, pos).otherwise(state["first"]).alias("first"),
            F.when(ends, pos - 1).otherwise(state["last"]).alias("last"),
        )

    def content(state: Column) -> Column:
        return F.when(
            state["last"] >= 0,
            strip(F.substring(tail, state["first"] + 1, state["last"] - state["first"])),
        )

    return F.aggregate(pieces, start_state, step, content)


def last_boxed(text: Column, box: Column | None = None) -> Column:
    """Last boxed answer; the whole stripped text where there is no closed box.

    ``box`` is the text's ``closed_box`` if a column holds it already.
    """
    return F.coalesce(closed_box(text) if box is None else box, strip(text))


def answer_candidate(text: Column, box: Column | None = None) -> Column:
    """Non-empty boxed answer, else the last number in the whole text, else null."""
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    last_number = F.try_element_at(numbers, F.lit(-1))
    box = closed_box(text) if box is None else box
    return F.coalesce(F.nullif(box, F.lit("")), last_number)


# Notation that carries no meaning for equality, and what stands for it; the order matters.
_REWRITES = (
    (r"\$|\\left|\\right|(?<!\\)\\[,;:! ]", ""),
    (r"\s+", ""),
    (r"\^\\circ|\^\{\\circ\}", ""),
    (r"(?<=[\d}])\\(?:text|mathrm|mbox)\{[A-Za-z][A-Za-z./]*\}(?:\^\{?-?\d\}?)?\.*$", ""),
    (r"\\(?:text|mathrm|mbox|textbf|mathbf)\{([^{}]*)\}", "$1"),
    (r"\{,\}", ","),
    (r"\\[dt]frac", r"\\frac"),
    (r"^(-?)(\d+)\\frac\{(\d+)\}\{(\d+)\}$", "$1$2+$3/$4"),
    (r"^(-?)(\d+)\\frac(\d)(\d)$", "$1$2+$3/$4"),
    (r"(?<![\d.^])\\frac\{(-?\d+)\}\{(-?\d+)\}", "$1/$2"),
    (r"^--", ""),
    (r"^(-?)\\frac(\d)(\d)$", "$1$2/$3"),
    (r"^-(\d+)/-(\d+)$", "$1/$2"),
    (r"^(\d+)/-(\d+)$", "-$1/$2"),
    (r"\\?%\.*$", ""),
    (r"\^\{(\w)\}", r"\^$1"),
    (r"^[A-Za-z]=", ""),
)
_SET = r"^\\\{([^{}\\]*)\\\}$"


# Most answers are plain numbers, whose spelling stays as it is.
_PLAIN = r"^-?\d+(?:\.\d+)?\z"


def normalize_answer(answer: Column) -> Column:
    """Canonical spelling of an answer; null where nothing is left of it."""
    return F.when(F.rlike(answer, F.lit(_PLAIN)), answer).otherwise(_rewritten(answer))


def _rewritten(answer: Column) -> Column:
    text = answer
    for pattern, replacement in _REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    text = F.rtrim(text, F.lit("."))
    members = F.array_sort(F.split(F.regexp_extract(text, _SET, 1), ","))
    text = F.when(F.rlike(text, F.lit(_SET)), F.concat(F.lit("\\{"), F.array_join(members, ","), F.lit("\\}"))).otherwise(text)
    grouped = F.rlike(text, F.lit(r"^-?\d+(,\d{3})+(\.\d+)?(/\d+)?$"))
    return F.nullif(F.when(grouped, F.replace(text, F.lit(","), F.lit(""))).otherwise(text), F.lit(""))


_NUMERIC = r"^(-?)(?:(\d+)\+)?(\d+\.?\d*|\.\d+)(?:/(\d+))?$"


def numeric_answer(answer: Column) -> Column:
    """Value of a normalised integer, decimal, fraction or mixed number, else null."""
    return F.when(F.rlike(answer, F.lit(_PLAIN)), answer.try_cast("double")).otherwise(_fraction_value(answer))


def _fraction_value(answer: Column) -> Column:
    sign, whole, main, below = (F.regexp_extract(answer, _NUMERIC, i) for i in range(1, 5))
    value = F.try_divide(main.try_cast("double"), F.when(below == "", F.lit(1.0)).otherwise(below.try_cast("double")))
    value = F.when(whole == "", value).otherwise(whole.try_cast("double") + value)
    return F.when(sign == "-", -value).otherwise(value)


def _whole_digits(answer: Column) -> Column:
    """One spelling for each integer: without leading zeros, and no sign for zero."""
    return F.regexp_replace(F.regexp_replace(answer, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")


# Integers and fractions whose products still fit 38 digits.
_RATIONAL = r"^-?(?:\d{1,8}\+\d{1,8}/\d{1,8}|\d{1,18}(?:/\d{1,18})?)$"


def _fraction(answer: Column) -> tuple[Column, Column]:
    """Numerator and denominator of a text that ``_RATIONAL`` matches."""
    sign, whole, main, below = (F.regexp_extract(answer, _NUMERIC, i) for i in range(1, 5))
    below = F.when(below == "", F.lit("1")).otherwise(below).try_cast("decimal(18,0)")
    top = F.when(whole == "", main.try_cast("decimal(18,0)")).otherwise(
        (whole.try_cast("decimal(9,0)") * below.cast("decimal(9,0)") + main.try_cast("decimal(9,0)")).cast("decimal(18,0)")
    )
    return F.when(sign == "-", -top).otherwise(top), below


def answer_label(pred: Column, gold: Column, pred_value: Column, gold_value: Column) -> Column:
    """How two normalised answers, with their ``numeric_answer`` values, compare.

    Integers and fractions are compared exactly. Where a decimal is involved, values agree within a
    relative tolerance that stays below half a unit.
    """

    def both(pattern: str) -> Column:
        return F.rlike(pred, F.lit(pattern)) & F.rlike(gold, F.lit(pattern))

    (top, below), (gold_top, gold_below) = _fraction(pred), _fraction(gold)
    off = F.abs(pred_value - gold_value)
    close = (off <= F.lit(RELATIVE_TOLERANCE) * F.greatest(F.abs(pred_value), F.abs(gold_value))) & (off < F.lit(0.5))
    decimal = F.contains(pred, F.lit(".")) | F.contains(gold, F.lit("."))
    same = (
        F.when(both(r"^-?\d+$"), _whole_digits(pred) == _whole_digits(gold))
        .when(both(_RATIONAL), (below != 0) & (gold_below != 0) & (top * gold_below == gold_top * below))
        .otherwise(decimal & close)
    )
    return (
        F.when(pred.isNull() | gold.isNull(), PARSE_FAILURE)
        .when(pred == gold, EXACT)
        .when(same, NUMERIC)
        .otherwise(DIFFERENT)
    )


def is_match(label: Column) -> Column:
    return label.isin(EXACT, NUMERIC, SYMBOLIC)


def single_label(label: Column) -> Column:
    """One label for every compared pair, right or wrong."""
    return F.when(label == PARSE_FAILURE, label).otherwise(SINGLE_LABEL)
