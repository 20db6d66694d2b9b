"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import written


def _stars(links: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour of a node is linked to the least of the node and its neighbours instead.

    With ``larger_only`` the neighbours above the node move, else those below it and the node itself.
    """
    around = links.select("u", "v") if not larger_only else links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if larger_only:
        pairs = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (u, v): the root is the least node that can be reached.

    The number of rounds grows with the logarithm of the longest chain. Every round is written to the shared
    folder, so a lost executor does not repeat the rounds before.
    """
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, last = written(links, "links"), None
    while True:
        state = written(_stars(_stars(state, True), False), "links")
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
