"""Answers equal by their parts or by algebra, against verdicts by hand and against Python's own arithmetic."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe import functions as TF
from tallyframe.functions.algebra import PRIMES, is_algebraic, may_be_equal, same_at_points, values_at_points
from tallyframe.functions.structure import structure
from tallyframe.operators import scoring
from tallyframe.operators.equivalence import equal_pairs
from tallyframe.operators.verifiers import isolated

EQUAL = [
    ("(x+1)^2", "x^2+2x+1"),
    (r"\sqrt{8}", r"2\sqrt2"),
    (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}"),
    (r"\sqrt{\frac{9}{4}}", "1.5"),
    ("x^{-1}", r"\frac{1}{x}"),
    ("x^{1/2}", r"\sqrt{x}"),
    ("x^{3/2}", r"x\sqrt{x}"),
    ("2^{10}", "1024"),
    ("2^{3^2}", "512"),
    ("8/4/2", "1"),
    ("1-(2-3)", "2"),
    ("--x", "x"),
    ("x", "2x/2"),
    (r"3\frac{1}{2}", "7/2"),
    (r"\frac{\frac{a}{b}}{c}", r"\frac{a}{bc}"),
    (r"\frac{(n+1)n}{2}", r"\frac{n^2}{2}+\frac{n}{2}"),
    ("0.5x", "x/2"),
    (r"2\pi r", r"r\cdot2\cdot\pi"),
    ("[0,1/2)", "[0,0.5)"),
    (r"\{1,x+x\}", r"\{2x,1.0\}"),
    ("3,2", "2,3"),
    ("(1,(2,3/6))", "(1,(2,0.5))"),
    (r"\begin{pmatrix}1&2\\x&4\end{pmatrix}", r"\begin{matrix}1&4/2\\x&2+2\end{matrix}"),
    (r"(-\infty,1)\cup(2,\infty)", r"(-\infty,2/2)\cup(2,\infty)"),
    ("1e300", "1e300"),
]
DIFFERENT = [
    ("x+1", "x+2"),
    ("-x^2", "(-x)^2"),
    ("ab", "ac"),
    ("east", "seat"),
    ("no", "on"),
    ("x+", "x"),
    ("(x", "x"),
    ("[0,1)", "(0,1)"),
    ("[0,1)", "[0,1]"),
    ("(1,2)", "(2,1)"),
    ("(1,2)", "1,2"),
    ("(1,2,3)", "(1,2)"),
    (r"\{1,2\}", r"\{1,3\}"),
    (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", r"\begin{pmatrix}1&2&3&4\end{pmatrix}"),
    ("x/0", "y/0"),
    (r"\sqrt[3]{8}", "2"),
    ("10000000001x", "10000000000x"),
    ("a^b", "b^a"),
    ("", "0"),
    ("{}", "()"),
    ("^", "+"),
    (None, "1"),
    (None, None),
]


def test_pairs_by_hand(spark):
    pairs = EQUAL + DIFFERENT
    df = spark.createDataFrame(pairs, "pred string, gold string")
    got = {(r["pred"], r["gold"]) for r in equal_pairs(df).collect()}
    assert got == set(EQUAL)


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": -1, "hot_rows": 3}])
def test_copies_and_joins(spark, sizes):
    df = spark.createDataFrame(EQUAL[:3] * 20 + DIFFERENT[:3] * 20 + [(b, a) for a, b in EQUAL[:3]], "p string, g string")
    got = sorted(tuple(r) for r in equal_pairs(df, "p", "g", **sizes).select("p", "g").collect())
    assert got == sorted(EQUAL[:3] + [(b, a) for a, b in EQUAL[:3]])
    assert equal_pairs(df.limit(0), "p", "g").collect() == []


def test_primes_follow_their_rule():
    small = [p for p in range(2, 50) if all(p % d for d in range(2, p))]
    for p in PRIMES:
        assert p < 2**31 and p % 8 == 7 and all(p % d for d in range(3, int(p**0.5) + 1, 2))
        assert all(pow(q, (p - 1) // 2, p) == 1 for q in small)


def random_tree(rng, depth):
    """(LaTeX, function of (values, prime)) of a random expression."""
    kind = rng.choice("nvv+-*/^g") if depth else rng.choice("nv")
    if kind == "n":
        n = rng.randrange(100)
        return str(n), lambda v, p: n
    if kind == "v":
        name = rng.choice("xyz")
        return name, lambda v, p: v[name]
    a, f = random_tree(rng, depth - 1)
    if kind == "^":
        k = rng.randrange(2, 6)
        return f"({a})^{{{k}}}", lambda v, p: pow(f(v, p), k, p)
    b, g = random_tree(rng, depth - 1)
    if kind == "g":
        return f"\\frac{{{a}}}{{{b}}}", lambda v, p: f(v, p) * pow(g(v, p), -1, p)
    texts = {"+": f"({a}+{b})", "-": f"({a}-({b}))", "*": rng.choice([f"({a})({b})", f"({a})*({b})", f"({a})\\cdot({b})"]), "/": f"({a})/({b})"}
    made = {
        "+": lambda v, p: f(v, p) + g(v, p),
        "-": lambda v, p: f(v, p) - g(v, p),
        "*": lambda v, p: f(v, p) * g(v, p),
        "/": lambda v, p: f(v, p) * pow(g(v, p), -1, p),
    }
    return texts[kind], made[kind]


def test_values_equal_python_arithmetic(spark):
    rng = random.Random(8)
    trees = [random_tree(rng, 4) for _ in range(150)]
    letters = {x["t"]: x["v"] for x in spark.createDataFrame([(t,) for t in "xyz"], "t string").select("t", values_at_points(F.col("t")).alias("v")).collect()}
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(trees)], "i int, t string")
    decided = 0
    for r in rows.select("i", values_at_points(F.col("t")).alias("v")).collect():
        for k, p in enumerate(PRIMES):
            values = {name: v[k]["n"] * pow(v[k]["d"], -1, p) % p for name, v in letters.items()}
            try:
                want = trees[r["i"]][1](values, p) % p
            except ValueError:  # a division by zero
                continue
            found = r["v"][k]
            assert found is not None and found["n"] * pow(found["d"], -1, p) % p == want, trees[r["i"]][0]
            decided += 1
    assert decided > 800


def test_polynomials_and_their_expansions(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        roots, spare = [rng.randrange(-9, 10) for _ in range(rng.randrange(1, 6))], rng.randrange(2)
        coefficients = [1]
        for r in roots:
            coefficients = [a - r * b for a, b in zip([*coefficients, 0], [0, *coefficients])]
        coefficients[rng.randrange(len(coefficients))] += spare
        degree = len(roots)
        terms = "".join(f"{c:+d}x^{{{degree - j}}}" for j, c in enumerate(coefficients))
        rows.append((i, "".join(f"(x-{r})" if r >= 0 else f"(x+{-r})" for r in roots), terms, spare == 0))
    df = spark.createDataFrame(rows, "i int, a string, b string, same boolean")
    got = df.select("same", same_at_points(values_at_points(F.col("a")), values_at_points(F.col("b"))).alias("found")).collect()
    assert all(r["same"] == r["found"] for r in got)


def test_what_is_algebraic(spark):
    texts = {"x+1": True, "xy": True, "2x": True, r"\pir": True, "sin2": False, r"\sin{x}": False, "x_1": False, "5!": False, "x=2": False, "": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["a"] for r in df.select("t", is_algebraic(F.col("t")).alias("a")).collect()} == texts
    pairs = {("no", "on"): False, ("xy", "2xy/2"): True, ("x", "sin2"): False, ("3", "x"): True, ("", "0"): False}
    df = spark.createDataFrame(list(pairs), "a string, b string")
    assert {(r["a"], r["b"]): r["m"] for r in df.select("a", "b", may_be_equal(F.col("a"), F.col("b")).alias("m")).collect()} == pairs


def test_shapes(spark):
    shapes = {
        "[0,1)": ("[,)", ["", "0", "1", ""]),
        "(x+1)(x-2),3": (",", ["3", "(x+1)(x-2)"]),
        r"\{3,1/2\}": (r"\{,\}", ["", "", "1/2", "3"]),
        "((1,2),3)": ("((,),)", ["", "", "1", "2", "", "3", ""]),
        r"\frac{a,b}{c}": ("", [r"\frac{a,b}{c}"]),
        "(1,2": ("", ["(1,2"]),
        "a)b(": ("", ["a)b("]),
        "": ("", [""]),
    }
    df = spark.createDataFrame([(t,) for t in shapes], "t string")
    for r in df.select("t", structure(F.col("t")).alias("s")).collect():
        assert (r["s"]["shape"], r["s"]["leaves"]) == shapes[r["t"]]


def test_units_and_signs(spark):
    texts = {r"5\text{ cm}": "5", r"5\mathrm{m}^2": "5", r"\text{east}": "east", r"-\frac{-1}{2}": "1/2", r"x^\frac{1}{2}": r"x^\frac{1}{2}", r"2\frac{1}{2}x": r"2\frac{1}{2}x"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["a"] for r in df.select("t", TF.normalize_answer(F.col("t")).alias("a")).collect()} == texts


def test_symbolic_scores(spark):
    examples = spark.createDataFrame([(1, r"\boxed{(x+1)^2}"), (2, r"\boxed{4}")], "id long, solution string")
    texts = [(1, r"\boxed{x^2+2x+1}"), (1, r"\boxed{x^2}"), (1, "none"), (2, r"\boxed{4.0}"), (2, r"\boxed{2^2}")]
    outputs = spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(texts)], "id long, sample_idx int, generated_solution string")
    plain = {r["sample_idx"]: r["match_type"] for r in scoring.score_samples(outputs, examples).collect()}
    assert plain == {0: "different", 1: "different", 2: "parse_failure", 3: "numeric_equiv", 4: "different"}
    rows = scoring.score_samples(outputs, examples, symbolic=True).collect()
    assert {r["sample_idx"]: r["match_type"] for r in rows} == plain | {0: "symbolic_equiv", 4: "symbolic_equiv"}
    assert {r["sample_idx"] for r in rows if r["is_correct"]} == {0, 3, 4}


def test_a_pair_that_fails_costs_only_itself(spark):
    def verifier(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
        for p in pred:
            if p == "17":
                raise RuntimeError("cannot read 17")
            while p == "4711":
                pass
        return pd.DataFrame({"is_correct": pred == gold, "match_type": "same"})

    df = spark.range(10_000).selectExpr("CAST(id AS STRING) AS pred", "CAST(id - id % 2 AS STRING) AS gold")
    begun = time.time()
    got = {r["pred"]: r for r in scoring.verify_pairs(df, verifier, tasks=4, seconds=0.5).collect()}
    assert len(got) == 10_000 and time.time() - begun < 60
    failed = {p: r for p, r in got.items() if r["match_type"] == "error"}
    assert set(failed) == {"17", "4711"} and not any(r["is_correct"] for r in failed.values())
    assert all(r["is_correct"] == (int(p) % 2 == 0) for p, r in got.items() if p not in failed)


def test_a_verifier_that_always_fails_is_an_error(spark):
    def verifier(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
        raise NameError("nothing")

    df = spark.createDataFrame([("1", "2"), ("2", "2")], "pred string, gold string")
    with pytest.raises(ValueError, match="every one of 2 pairs: NameError: nothing"):
        scoring.verify_pairs(df, verifier)


def test_isolation_keeps_order_and_checks_counts():
    pred, gold = (pd.Series([str(i) for i in range(n, n + 50)]) for n in (0, 1))
    lost = isolated(lambda p, g: pd.DataFrame({"is_correct": [True] * max(1, len(p) - (len(p) > 7)), "match_type": "x"}), 5.0)(pred, gold)
    assert len(lost) == 50 and lost["error"].isna().all()
    empty = isolated(lambda p, g: 1 / 0, 5.0)(pred[:0], gold[:0])
    assert list(empty.columns) == ["is_correct", "match_type", "error"] and not len(empty)


def test_common_pairs_are_counted_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("'1' AS pred", "'1' AS gold")
    pairs = df.select("pred", "gold").dropna().distinct().repartition(4, "pred", "gold")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition") < plan.index("Aggregate")
