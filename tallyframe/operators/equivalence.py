"""Answers that are equal by their parts or by algebra, decided once for each distinct pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.algebra import may_be_equal, same_at_points, values_at_points
from tallyframe.functions.answers import answer_label, is_match, numeric_answer
from tallyframe.functions.structure import structure
from tallyframe.operators.joins import keyed_join
from tallyframe.session import written

_WORTH = r"[-+*/^\d\\(\[,]"


def worth_deciding(answer: Column) -> Column:
    """Whether an answer has anything that can be spelled in another way: digits, operators, commands or parts."""
    return F.rlike(answer, F.lit(_WORTH))


def equal_pairs(pairs: DataFrame, pred: str = "pred", gold: str = "gold", tasks: int | None = None, **sizes: int) -> DataFrame:
    """The distinct pairs of normalised answers that are equal, among all rows of ``pairs``.

    Answers of the same shape (``functions.structure``) are compared leaf by leaf: as text, as numbers, and as
    expressions (``functions.algebra``). Every distinct expression is evaluated once, in ``tasks`` tasks, by default as
    many as the session shuffles to. Nulls equal nothing. Copies of a pair, however many, are one before any shuffle.
    """
    tasks = tasks or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = pairs.select(F.col(pred).alias("pred"), F.col(gold).alias("gold")).where("pred IS NOT NULL AND gold IS NOT NULL").distinct()
    worth = known.where((F.col("pred") == F.col("gold")) | worth_deciding(F.col("pred")) | worth_deciding(F.col("gold")))
    shaped = worth.select("pred", "gold", structure(F.col("pred")).alias("p"), structure(F.col("gold")).alias("g"))
    alike = shaped.where((F.col("p.shape") == F.col("g.shape")) & (F.size("p.leaves") == F.size("g.leaves")))
    zipped = F.arrays_zip(F.col("p.leaves").alias("a"), F.col("g.leaves").alias("b"))
    leaves = alike.select("pred", "gold", F.explode(zipped).alias("leaf")).select("pred", "gold", "leaf.a", "leaf.b")
    a, b = F.col("a"), F.col("b")
    equal = (a == b) | ((a != "") & (b != "") & is_match(answer_label(a, b, numeric_answer(a), numeric_answer(b))))
    leaves = leaves.withColumn("equal", equal).withColumn("open", ~F.col("equal") & may_be_equal(a, b))
    leaves = written(leaves, "answer-leaves")
    # A pair with a leaf that differs for good is not evaluated.
    lost = leaves.where("NOT equal AND NOT open").select("pred", "gold").distinct()
    leaves = leaves.join(lost, ["pred", "gold"], "left_anti")
    texts = leaves.where("open").select(F.explode(F.array("a", "b")).alias("text")).distinct().repartition(tasks, "text")
    values = written(texts.select("text", values_at_points(F.col("text")).alias("value")), "answer-values")
    sides = leaves.where("open")
    for side in ("a", "b"):
        named = values.select(F.col("text").alias(side), F.col("value").alias(f"{side}_value"))
        sides = keyed_join(sides, named, side, **sizes)
    decided = sides.select("pred", "gold", same_at_points(F.col("a_value"), F.col("b_value")).alias("equal"))
    both = decided.unionByName(leaves.where("NOT open").select("pred", "gold", "equal"))
    found = both.groupBy("pred", "gold").agg(F.bool_and("equal").alias("equal")).where("equal")
    return found.select(F.col("pred").alias(pred), F.col("gold").alias(gold))
