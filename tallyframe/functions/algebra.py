"""Equality of algebraic answers as native column expressions.

An answer is evaluated by a stack machine: a fold over its tokens, with numbers as fractions modulo a
prime. Two answers are equal if they agree at several points, each with a prime and values of the letters of its own.
Polynomials that differ agree at a random point with a chance of about their degree in two thousand million, so
this decides identities without expanding anything. Square roots are taken modulo the prime: of the two, the one
that is a square itself, as the positive root of a number made of small primes is for the primes used.

Letters and ``\\pi`` stand for numbers without relations, so ``i`` is not a root of -1. Where a root does
not exist modulo a prime, the point says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Primes of the form 8k + 7 below 2^31 for which 2 and all odd primes below 50 are squares; products fit a long.
PRIMES = (2147260631, 2146303871, 2143697111, 2143023671, 2142014111, 2139839231, 2138962271, 2136129551)
# Points that must say something for two answers to be equal.
LEAST_POINTS = 3

_COMMANDS = r"\\(?:frac|sqrt|pi|cdot|times|div)"
_TOKENS = _COMMANDS + r"|\d+(?:\.\d*)?|\.\d+|[A-Za-z]|\S"
# Spelling of arguments without braces, and of mixed numbers.
_REWRITES = (
    (r"\\[dt]frac", r"\\frac"),
    (r"\\frac(\d)(\d)", r"\\frac{$1}{$2}"),
    (r"\\frac(\d)\{", r"\\frac{$1}{"),
    (r"\\frac\{([^{}]*)\}(\d)", r"\\frac{$1}{$2}"),
    (r"\\sqrt(\d|[A-Za-z])", r"\\sqrt{$1}"),
    (r"(?<![\d.)}A-Za-z])(\d+)\\frac\{(\d+)\}\{(\d+)\}", "($1+$2/$3)"),
    (r"(?<![\d.)}A-Za-z])(\d+)\+(\d+/\d+)$", "($1+$2)"),
)
_VALUE = "struct<n:bigint,d:bigint,en:bigint,ed:bigint>"
_STATE = f"struct<vals:array<{_VALUE}>,ops:array<string>,after:boolean,ok:boolean>"
# Markers on the stack: a fraction that waits for its first or second argument, and a root.
_FIRST, _SECOND, _ROOT, _NEGATIVE = "frac1", "frac2", "root", "neg"


def is_algebraic(answer: Column) -> Column:
    """Whether an answer may be an expression: only marks that are known, and no word of three letters or more."""
    bare = F.regexp_replace(answer, _COMMANDS, " ")
    return (answer != "") & ~F.rlike(bare, F.lit(r"[A-Za-z]{3,}|[^-+*/^(){}\[\]\d.A-Za-z ]"))


def may_be_equal(a: Column, b: Column) -> Column:
    """Whether algebra can tell: both may be expressions, and one has a digit, operator or command, so that they are not both plain words."""
    telling = F.lit(r"[-+*/^\d\\]")
    return is_algebraic(a) & is_algebraic(b) & (F.rlike(a, telling) | F.rlike(b, telling))


def _times(a: Column, b: Column, p: Column) -> Column:
    return F.pmod(a * b, p)


def _power(base: Column, exponent: Column, p: Column) -> Column:
    """base^exponent modulo p, for an exponent below 2^31."""

    def step(state: Column, bit: Column) -> Column:
        odd = F.getbit(exponent, bit) == 1
        return F.struct(
            F.when(odd, _times(state["r"], state["b"], p)).otherwise(state["r"]).alias("r"), _times(state["b"], state["b"], p).alias("b")
        ).cast("struct<r:bigint,b:bigint>")

    start = F.struct(F.lit(1).cast("bigint").alias("r"), base.alias("b")).cast("struct<r:bigint,b:bigint>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, step, lambda s: s["r"])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _value(n: Column, d: Column, en: Column | None = None, ed: Column | None = None) -> Column:
    """A fraction modulo p, and as an exponent its exact numerator and denominator, null if it is none."""
    none = F.lit(None).cast("bigint")
    return F.struct(n.alias("n"), d.alias("d"), (none if en is None else en).alias("en"), (none if ed is None else ed).alias("ed")).cast(_VALUE)


def _root(v: Column, p: Column) -> Column:
    """Square root of a value; its numerator is null without one."""
    whole = _times(v["n"], v["d"], p)
    root = _let(_power(whole, F.floor((p + 1) / 4), p), lambda r: F.when(_times(r, r, p) == whole, r))
    return _value(root, v["d"])


def _raised(a: Column, b: Column, p: Column) -> Column:
    """a^b, for whole and half exponents."""

    def whole(base: Column) -> Column:
        e = F.abs(b["en"])
        known = (e < F.lit(1 << 31)) & b["ed"].isin(1, 2)
        top, below = (F.when(known, _power(base[part], e, p)) for part in ("n", "d"))
        negative = b["en"] < 0
        exact = F.when(b["en"].isNotNull() & (e <= 4) & (b["ed"] == 1) & (F.abs(base["en"]) < 1000), F.when(~negative & (base["ed"] == 1), F.pow(base["en"], e).cast("bigint")))
        return _value(F.when(negative, below).otherwise(top), F.when(negative, top).otherwise(below), exact, F.lit(1).cast("bigint"))

    return _let(F.when(b["ed"] == 2, _root(a, p)).otherwise(a), whole)


def _applied(op: Column, a: Column, b: Column, p: Column) -> Column:
    small = (F.abs(a["en"]) < 10**6) & (F.abs(b["en"]) < 10**6) & (a["ed"] < 10**3) & (b["ed"] < 10**3)

    def exact(value: Column) -> Column:
        return F.when(small, value)

    cross = _times(b["n"], a["d"], p)
    plus, minus = (F.pmod(_times(a["n"], b["d"], p) + sign * cross, p) for sign in (1, -1))
    below, one = _times(a["d"], b["d"], p), F.lit(1).cast("bigint")
    en, ed = a["en"] * b["ed"], a["ed"] * b["ed"]
    quotient = exact(F.when((a["ed"] == 1) & (b["ed"] == 1) & (b["en"] > 0), a["en"]))
    return (
        F.when(op == "+", _value(plus, below, exact(F.when(ed == 1, a["en"] + b["en"])), one))
        .when(op == "-", _value(minus, below, exact(F.when(ed == 1, a["en"] - b["en"])), one))
        .when(op == "*", _value(_times(a["n"], b["n"], p), below, exact(F.when(ed == 1, en * b["en"])), one))
        .when(op == "/", _value(_times(a["n"], b["d"], p), _times(a["d"], b["n"], p), quotient, b["en"]))
        .when(op == "^", _raised(a, b, p))
        .when(op == _NEGATIVE, _value(F.pmod(-b["n"], p), b["d"], -b["en"], b["ed"]))
        .when(op == _ROOT, _root(b, p))
    )


def _but_last(values: Column, n: int = 1) -> Column:
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - n, F.lit(0)))


def _last(values: Column, place: int = 1) -> Column:
    return F.try_element_at(values, F.lit(-place))


def _state(vals: Column, ops: Column, after: Column, ok: Column) -> Column:
    return F.struct(vals.alias("vals"), ops.alias("ops"), after.alias("after"), ok.alias("ok")).cast(_STATE)


def _rank(op: Column) -> Column:
    """How tightly an operator binds; nothing else on the stack is one."""
    return F.when(op.isin("+", "-"), 1).when(op.isin("*", "/"), 2).when(op == _NEGATIVE, 3).when(op == "^", 4).otherwise(-1)


def _reduced(s: Column, p: Column) -> Column:
    """The state after the operator on top has been applied."""
    op = _last(s["ops"])
    unary = op.isin(_NEGATIVE, _ROOT)
    enough = F.size(s["vals"]) >= F.when(unary, 1).otherwise(2)
    out = _applied(op, F.when(unary, _last(s["vals"])).otherwise(_last(s["vals"], 2)), _last(s["vals"]), p)
    kept = F.when(unary, _but_last(s["vals"])).otherwise(_but_last(s["vals"], 2))
    return _state(F.concat(kept, F.array(out)), _but_last(s["ops"]), s["after"], s["ok"] & enough)


def _operand(token: Column, point: Column) -> Column:
    """Value of a number, a letter or pi at a point."""
    p = point["p"]
    whole, part = F.substring_index(token, ".", 1), F.when(F.contains(token, F.lit(".")), F.substring_index(token, ".", -1)).otherwise("")
    top = F.pmod(F.concat(whole, part).try_cast("decimal(38,0)"), p.cast("decimal(38,0)")).cast("bigint")
    below = F.when(F.length(part) <= 18, F.pmod(F.pow(F.lit(10).cast("decimal(38,0)"), F.length(part)).cast("bigint"), p))
    exact = F.when(F.length(part) + F.when(F.length(whole) > 9, 1).otherwise(0) == 0, whole.try_cast("bigint"))
    number = _value(top, below, exact, F.lit(1).cast("bigint"))
    seed = F.pmod(F.xxhash64(token, p), p)
    letter = _let(_times(seed, seed, p), lambda square: _value(_times(square, square, p), F.lit(1).cast("bigint")))
    return F.when(F.rlike(token, F.lit("[0-9]")), number).otherwise(letter)


def _step(s: Column, token: Column, point: Column) -> Column:
    p = point["p"]
    op = F.when(token.isin("\\cdot", "\\times"), "*").when(token == "\\div", "/").otherwise(token)
    is_operand = F.rlike(token, F.lit(r"^(?:[0-9.]+|[A-Za-z]|\\pi)$")) & (token != ".")
    opens, closes = token.isin("(", "{", "["), token.isin(")", "}", "]")
    command = token.isin("\\frac", "\\sqrt")
    binary = op.isin("+", "-", "*", "/", "^")
    sign = op.isin("+", "-") & ~s["after"]
    starts = is_operand | opens | command
    implied = starts & s["after"]
    level = F.when(closes, 0).when(sign, 9).when(op.isin("+", "-"), 1).when(op.isin("*", "/") | implied, 2).otherwise(9)
    turns = F.sequence(F.lit(1), F.greatest(F.size(s["ops"]), F.lit(1)))
    reduced = F.aggregate(turns, s, lambda t, _: F.when(_rank(_last(t["ops"])) >= level, _reduced(t, p)).otherwise(t))

    def act(r: Column) -> Column:
        ops = F.when(implied, F.concat(r["ops"], F.array(F.lit("*")))).otherwise(r["ops"])
        pushed = F.when(sign & (op == "-"), F.lit(_NEGATIVE)).when(token == "\\frac", F.lit(_FIRST)).when(token == "\\sqrt", F.lit(_ROOT)).otherwise(op)
        push = _state(r["vals"], F.concat(ops, F.array(pushed)), F.lit(False), r["ok"] & (starts | sign | s["after"]))
        operand = _state(F.concat(r["vals"], F.array(_operand(token, point))), ops, F.lit(True), r["ok"])
        # A bracket closes the one that is open; an argument in braces completes what waits for it.
        fits = (_last(r["ops"]) == F.when(token == ")", "(").when(token == "}", "{").otherwise("[")) & s["after"]
        popped = _but_last(r["ops"])
        waits = F.when(token == "}", _last(popped))
        plain = _state(r["vals"], popped, F.lit(True), r["ok"] & F.coalesce(fits, F.lit(False)))

        def close(c: Column) -> Column:
            second = _state(c["vals"], F.concat(_but_last(c["ops"]), F.array(F.lit(_SECOND))), F.lit(False), c["ok"])
            divide = _reduced(_state(c["vals"], F.concat(_but_last(c["ops"]), F.array(F.lit("/"))), c["after"], c["ok"]), p)
            return F.when(waits == _FIRST, second).when(waits == _SECOND, divide).when(waits == _ROOT, _reduced(c, p)).otherwise(c)

        unknown = _state(r["vals"], r["ops"], r["after"], F.lit(False))
        plus = _state(r["vals"], r["ops"], F.lit(False), r["ok"])
        return (
            F.when(is_operand, operand).when(closes, _let(plain, close)).when(sign & (op == "+"), plus).when(opens | command | binary, push).otherwise(unknown)
        )

    return F.when(s["ok"], _let(reduced, act)).otherwise(s)


def values_at_points(answer: Column) -> Column:
    """An array of (n, d), one for each prime: the answer's value as a fraction, null where it has none."""
    text = answer
    for pattern, to in _REWRITES:
        text = F.regexp_replace(text, pattern, to)
    tokens = F.regexp_extract_all(F.concat(F.lit("("), text, F.lit(")")), F.lit(_TOKENS), F.lit(0))
    start = _state(F.array().cast(f"array<{_VALUE}>"), F.array().cast("array<string>"), F.lit(False), F.lit(True))

    def result(s: Column) -> Column:
        fine = s["ok"] & (F.size(s["vals"]) == 1) & (F.size(s["ops"]) == 0)
        v = _last(s["vals"])
        return F.when(fine & v["n"].isNotNull() & (v["d"] != 0), F.struct(v["n"].alias("n"), v["d"].alias("d")))

    points = F.array(*[F.struct(F.lit(p).cast("bigint").alias("p")) for p in PRIMES])
    return F.transform(points, lambda point: F.aggregate(tokens, start, lambda s, t: _step(s, t, point), result))


def same_at_points(a: Column, b: Column) -> Column:
    """Whether two results of ``values_at_points`` agree wherever both have a value, and have it at enough points."""
    primes = F.array(*[F.lit(p).cast("bigint") for p in PRIMES])
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), primes.alias("p")), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    equal = F.forall(pairs, lambda x: F.pmod(x["a"]["n"] * x["b"]["d"], x["p"]) == F.pmod(x["b"]["n"] * x["a"]["d"], x["p"]))
    return (F.size(pairs) >= LEAST_POINTS) & equal
