"""Mixing sources to target weights by hierarchical budgets.

Leaves are the combinations of the level columns, say domain, language and source; a node above a leaf stands
for the values of the first levels. The budget of tokens goes down the tree: the children of a node
share its budget by their weights, but none gets more than its capacity, the tokens of its leaves times the
largest number of epochs. What a child cannot take goes to its siblings by weight; as a node never gets
more than its children can take together, a shortage is made up among siblings first, and only what they
cannot take goes to the siblings of an ancestor. Shares are rounded down, so a few tokens may stay unused.

Each leaf is read in epochs; an epoch has the leaf's rows in the order of md5 of seed, epoch and id.
A leaf takes as many whole epochs as its budget holds, and of the next one the longest prefix that fits.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.joins import keyed_join
from tallyframe.session import written

SEED = 42
MAX_EPOCHS = 3
NO_VALUE = "none"
# An epoch is dealt to buckets by the first hexadecimal digits of its order; only the bucket in
# which the budget ends is sorted, once it has no more ids than this.
SORT_ROWS = 50_000
_ROOT = "__root"
# Up to so many leaves their table is broadcast to the rows, beyond that it is joined as any other.
BROADCAST_LEAVES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = weights.get(level, {})
    if not given:
        return F.lit(1).cast("long")
    pairs = F.create_map(*[F.lit(x) for name, w in given.items() for x in (name, int(w))])
    return F.coalesce(F.try_element_at(pairs, F.col(f"`{level}`")), F.lit(1)).cast("long")


def _share(nodes: DataFrame, parents: DataFrame, above: list[str], level: str, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """The nodes (above, level, capacity) with the budget that each gets of its parent's (above, budget).

    Children whose capacity is no more than their share by weight fill up; the others share what those leave. As that
    raises the shares, more may fill up, so sums over the filled ones are taken until they stay the same: a few rounds, as
    each is a step of Newton's method on the sum of what the children take. Only sums meet, so no node's children are
    ever sorted or gathered.
    """
    w = written(nodes.withColumn("w", _weight(level, weights)).where("w > 0"), "mixing_nodes")
    totals = parents.select(*above, F.col("budget").alias("b_left")).join(w.groupBy(*above).agg(F.sum("w").alias("w_left")), above)
    left, mark = written(totals, "mixing_left"), None
    while True:
        # Products of tokens and weights may exceed a long.
        b, s, cap, own = (F.col(c).cast("decimal(19,0)") for c in ("b_left", "w_left", "capacity", "w"))
        shared = keyed_join(w, left, above, spread_by=[level]).withColumn("filled", cap * s <= own * b)
        now = left.agg(F.count("*"), F.sum("b_left"), F.sum("w_left")).first()
        if now == mark:
            break
        mark = now
        full = shared.where("filled").groupBy(*above).agg(F.sum("capacity").alias("c"), F.sum("w").alias("f"))
        after = totals.join(full, above, "left")
        left = written(after.select(*above, *[(F.col(x) - F.coalesce(y, F.lit(0))).cast("long").alias(x) for x, y in (("b_left", "c"), ("w_left", "f"))]), "mixing_left")
    part = F.expr("CAST(greatest(CAST(w AS DECIMAL(19,0)) * b_left, 0) div greatest(w_left, 1) AS BIGINT)")
    return shared.select(*above, level, F.when(F.col("filled"), F.col("capacity")).otherwise(part).alias("budget"))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """Leaves (levels, tokens) with their budget. A node of weight 0 gets nothing, one without a weight has 1."""
    capacity = F.sum(F.col("tokens") * max_epochs).cast("long").alias("capacity")
    # One node above all others, so that every level has a parent.
    leaves = leaves.withColumn(_ROOT, F.lit(0))
    parents = leaves.select(_ROOT, budget.alias("budget")).limit(1)
    for depth, level in enumerate(levels):
        above = [_ROOT, *levels[:depth]]
        parents = _share(leaves.groupBy(*above, level).agg(capacity), parents, above, level, weights)
    return leaves.join(parents, [_ROOT, *levels]).drop(_ROOT)


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    share_of_tokens: tuple[int, int] = (1, 2),
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The selected rows of docs, one for each epoch that takes them, with ``epoch`` from 1.

    ``levels`` names the levels from the top and gives each an expression over docs; nulls read ``none``.
    ``weights`` has positive whole numbers up to 10,000 by level and value; without one it is 1, and 0 leaves a node
    out. The budget is ``share_of_tokens`` (a fraction) of all tokens. Takes any table with ``doc_id`` and
    ``text``; a null or empty text has no tokens. Rows that share an id within a leaf are taken or left
    together. Existing columns ``epoch`` are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("epoch")
    names = [f"__level{i}" for i in range(len(levels))]
    named = {n: weights.get(level, {}) for n, level in zip(names, levels)}
    labelled = docs.select("*", *[F.coalesce(c.cast("string"), F.lit(NO_VALUE)).alias(n) for n, c in zip(names, levels.values())])
    rows = written(labelled.select(*names, F.col("doc_id").alias("id"), token_count(F.col("text")).alias("tokens")), "token_counts")
    stats = written(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = stats.agg(F.sum("tokens")).first()[0] or 0
    budget = total * share_of_tokens[0] // share_of_tokens[1]
    budgets = leaf_budgets(stats, names, named, F.lit(budget).cast("long"), max_epochs)
    leaves = written(
        budgets.where("budget > 0 AND tokens > 0").select(
            *names, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")
        ),
        "leaf_budgets",
    )
    few = leaves.count() <= BROADCAST_LEAVES
    cuts = written(_cuts(rows, leaves, names, seed), "leaf_cuts")
    cut = [F.col(c).alias(f"__{c}") for c in ("whole", "rest", "bucket", "last", "last_id")]
    decided = leaves.join(cuts, names, "left").select(*names, *cut)
    joined = labelled.join(F.broadcast(decided) if few else decided, names)
    order = _order(seed, F.col("__whole"), F.col("doc_id"))
    inside = F.coalesce(F.struct(order, F.col("doc_id")) <= F.struct("__last", "__last_id"), F.lit(False))
    early = F.coalesce(order < F.col("__bucket"), F.lit(False))
    epochs = F.col("__whole") + F.when((inside | early) & (F.col("__rest") > 0), 1).otherwise(0)
    taken = joined.withColumn("__epochs", epochs).where("__epochs > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__epochs").cast("int")))).select(*docs.columns, "epoch")


def _order(seed: int, whole: Column, doc_id: Column) -> Column:
    """Place of a row in the epoch after ``whole`` ones."""
    return F.md5(F.concat(F.lit(f"{seed}:"), whole + 1, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _cuts(rows: DataFrame, leaves: DataFrame, names: list[str], seed: int, sort_rows: int = SORT_ROWS) -> DataFrame:
    """(leaf, bucket, last, last_id): where the prefix of the last epoch ends.

    Rows whose order is below ``bucket`` are taken whole; of those that begin with it, the ones up to (last, last_id), which
    are null where none fits. Buckets are hexadecimal digits of the order, two more in each round, until none in which a
    prefix ends has more than ``sort_rows`` different ids; only those are sorted.
    """
    ordered = rows.join(leaves.where("rest > 0"), names).withColumn("key", _order(seed, F.col("whole"), F.col("id")))
    # Rows that share an id in a leaf are one.
    ordered = ordered.groupBy(*names, "key", "id").agg(F.sum("tokens").alias("tokens"))
    ends = leaves.where("rest > 0").select(*names, "rest", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("before"))
    digits = 0
    while True:
        digits += 2
        inside = ordered.join(ends, names).where(F.startswith("key", "bucket"))
        finer = inside.groupBy(*names, "rest", "before", F.substring("key", 1, digits).alias("bucket")).agg(
            F.sum("tokens").alias("tokens"), F.count("*").alias("n")
        )
        running = Window.partitionBy(*names).orderBy("bucket")  # 256 buckets a leaf
        upto = finer.withColumn("upto", F.col("before") + F.sum("tokens").over(running)).where("upto > rest")
        first = F.min(F.struct("bucket", "rest", (F.col("upto") - F.col("tokens")).alias("before"), "n")).alias("e")
        ends = written(upto.groupBy(*names).agg(first).select(*names, "e.*"), "mixing_ends")
        most = ends.agg(F.max("n")).first()[0] or 0
        ends = ends.drop("n")
        if most <= sort_rows or digits >= 32:
            break
    last_bucket = ordered.join(ends, names).where(F.startswith("key", "bucket"))
    within = Window.partitionBy(*names).orderBy("key", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = last_bucket.withColumn("upto", F.col("before") + F.sum("tokens").over(within)).where("upto <= rest")
    last = fits.groupBy(*names).agg(F.max(F.struct("key", "id")).alias("m")).select(*names, F.col("m.key").alias("last"), F.col("m.id").alias("last_id"))
    return ends.select(*names, "bucket").join(last, names, "left")
