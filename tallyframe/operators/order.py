"""Row order, positions, exact-size samples and exact-count splits.

Spark rows have no order, so each operator here works on a ``RowOrder``: rows with sort columns
and with coarse buckets that follow the sort. Only per-bucket counts, whose number is bounded, pass
through one task. No operator sorts all rows in one partition, and the cut between the first n rows
and the rest is found on the sort columns alone, so whole rows are not shuffled to take a sample or
to split.

Sort columns should identify a row; nulls come first. Different rows that tie on them are ordered by
a hash of all their columns, so positions do not depend on partitions; a cut between such rows
raises. Copies of one row may repeat the sort columns, however often: they are counted before any
shuffle and spread over tasks when they are put back.

The coarse buckets look at the first bytes of the first column only. Buckets that are crowded nevertheless, such as
those of URLs or of problems that begin alike, are divided further by the whole sort key as bytes: past
what all keys of a bucket share, by quantiles of the bytes that follow, until no task sorts more keys than it shall.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.operators.joins import keyed_join
from tallyframe.session import written

HOT_ROWS = 1_000_000
# Numbers that pass through the driver in one round of dividing crowded buckets, and key bytes compared in it.
ROUND_BOUNDS = 262_144
SHARED_BYTES = 256
CHUNK_ROWS = 100_000
BUCKET_ROWS = 100_000
MAX_BOUNDS = 131_072
CUT_KEYS = 1_000_000

_SEEDED = "_seeded_key"
_FINE = "_bucket_fine"
_LEAD = "_lead_number"
_FILE, _BLOCK, _PLACE = "_source_file", "_source_block", "_source_place"
# Helper column of a source order: the row's place in its source.
POSITION = "_source_position"
_HELPERS = (_SEEDED, _FINE, POSITION)


@dataclass(frozen=True)
class RowOrder:
    """Rows with their sort columns and with bucket columns and their numbers of
    buckets. ``even`` says that no bucket is known to be crowded, so none is looked for.
    """

    rows: DataFrame
    sort_by: tuple[str, ...]
    levels: dict[str, int]
    even: bool = False

    @property
    def bucket(self) -> str:
        return list(self.levels)[-1]

    @property
    def n_buckets(self) -> int:
        return self.levels[self.bucket]

    @property
    def plain(self) -> DataFrame:
        """The rows without the helper columns."""
        return self.rows.drop(*_HELPERS)


def seeded_order(df: DataFrame, keys: str | Sequence[str], seed: int = 42) -> RowOrder:
    """Shuffled order that depends on the seed and the row keys only, not on partitioning.

    The sort key is ``md5(seed:key)``; its hex prefixes are evenly filled buckets.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    rows = df.withColumn(_SEEDED, F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)))
    rows = rows.withColumn(_FINE, F.conv(F.substring(_SEEDED, 1, 4), 16, 10).cast("int"))
    return RowOrder(rows, (_SEEDED, *keys), {_FINE: 16**4})


def _lead_number(df: DataFrame, key: str) -> Column:
    """A number that never falls where the column rises: the value, or the first six bytes of a text."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_micros(F.col(key).cast("timestamp")).cast("double")
    if isinstance(kind, T.BooleanType) or isinstance(kind, T.NumericType):
        return F.col(key).cast("double")
    raise ValueError(f"rows cannot be ordered by '{key}', a column of type {kind.simpleString()}")


def column_order(df: DataFrame, keys: str | Sequence[str], at_least: int = 64) -> RowOrder:
    """Order by columns: numbers, texts (by their bytes), dates and times.

    Bucket bounds are approximate quantiles of the first column, so buckets stay even however the values
    are spread. There is a bucket per ``BUCKET_ROWS`` rows, but at least ``at_least`` and at most
    ``MAX_BOUNDS`` of them; their bounds pass through the driver.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    lead = df.select(_lead_number(df, keys[0]).alias(_LEAD))
    rows, filled = lead.agg(F.count("*"), F.count(_LEAD)).first()
    buckets = min(MAX_BOUNDS, max(at_least, rows // BUCKET_ROWS))
    shares = [i / buckets for i in range(1, buckets)] if filled else []
    bounds = sorted(set(lead.approxQuantile(_LEAD, shares, 1 / (2 * buckets)))) if shares else []
    rows = df.withColumn(_LEAD, _lead_number(df, keys[0]))
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        sorter = Bucketizer(splits=splits, inputCol=_LEAD, outputCol=_FINE, handleInvalid="keep")
        rows = sorter.transform(rows).withColumn(_FINE, F.when(F.col(_LEAD).isNull(), 0).otherwise(F.col(_FINE).cast("int")))
    else:
        rows = rows.withColumn(_FINE, F.lit(0))
    return RowOrder(rows.drop(_LEAD), tuple(keys), {_FINE: len(bounds) + 2})


def source_order(df: DataFrame, at_least: int = 64) -> RowOrder:
    """Rows as they stand in their files: by file path, block and place in the block.

    Takes rows of a file source, filtered but not yet projected. They are written once with their
    position, so that every later read agrees on it. The rows of a block are numbered as one task reads them, so
    nothing is sorted, and a file that cannot be split, such as a gzip file, is one block like any other.
    """
    taken = df.columns
    try:
        placed = df.select(
            "*",
            F.col("_metadata.file_path").alias(_FILE),
            F.col("_metadata.file_block_start").alias(_BLOCK),
            F.monotonically_increasing_id().alias(_PLACE),
        )
    except AnalysisException as error:
        raise ValueError("rows have a source order only where they come straight from files") from error
    rows = written(placed, "source-rows")
    blocks = rows.groupBy(_FILE, _BLOCK).agg(F.count("*").alias("n_rows"), F.min(_PLACE).alias("first"))
    running = Window.orderBy(_FILE, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    before = F.coalesce(F.sum("n_rows").over(running), F.lit(0))
    offsets = written(blocks.select(_FILE, _BLOCK, (before - F.col("first")).alias("_offset")), "source-blocks")
    placed = keyed_join(rows, offsets, [_FILE, _BLOCK], spread_by=[_PLACE])
    numbered = written(placed.select(*taken, (F.col("_offset") + F.col(_PLACE)).alias(POSITION)), "numbered-rows")
    return column_order(numbered, POSITION, at_least)


def _bucket_offsets(rows: DataFrame, bucket: str) -> DataFrame:
    """One row per bucket: its row count, the rows before it and the rows in total."""
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n_rows"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        bucket,
        "n_rows",
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("n_before"),
        F.sum("n_rows").over(everything).alias("n_total"),
    )


def _hot_buckets(order: RowOrder, hot_rows: int) -> list[int]:
    """Buckets with more rows than a task shall hold; at most ``rows / hot_rows``."""
    if order.even:
        return []
    counts = order.rows.groupBy(order.bucket).agg(F.count("*").alias("n_rows"))
    return [r[0] for r in counts.where(F.col("n_rows") > hot_rows).select(order.bucket).collect()]


def _content(df: DataFrame) -> Column:
    """Hash of all columns of a row; columns that cannot be hashed go in as JSON."""

    def has_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(has_map(f.dataType) for f in kind.fields)
        return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and has_map(kind.elementType))

    plain = [f for f in df.schema.fields if f.name not in _HELPERS]
    parts = [F.to_json(F.struct(f.name)) if has_map(f.dataType) else F.col(f"`{f.name}`") for f in plain]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def _put_back(df: DataFrame, copies: str, *spread: str) -> DataFrame:
    """Each row ``copies`` times with its copy number ``_copy``, in chunks spread over tasks."""
    last = F.col(copies) - 1
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(CHUNK_ROWS).cast("bigint")))
    inside = F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + CHUNK_ROWS - 1, last))
    chunks = df.withColumn("_chunk", chunk).repartition("_chunk", *spread)
    return chunks.withColumn("_copy", F.explode(inside)).drop("_chunk", copies)


def _rank_rows(rows: DataFrame, order: RowOrder) -> DataFrame:
    inside = Window.partitionBy(order.bucket).orderBy(*order.sort_by, _content(rows))
    return rows.withColumn("_rank", F.row_number().over(inside).cast("bigint") - 1)


def _eight_bytes(number: Column) -> Column:
    """A long as eight bytes that sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """A value as bytes that sort as the values do, none of which is the start of another value's."""
    if isinstance(kind, T.StringType):
        # A zero byte ends the text; those inside it are followed by one byte more.
        plain = F.encode(value, "UTF-8")
        marked = F.unhex(F.regexp_replace(F.hex(plain), "\\G((?:..)*?)00", "$100FF"))
        return F.concat(F.when(F.contains(value, F.lit("\0")), marked).otherwise(plain), F.unhex(F.lit("0000")))
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return _eight_bytes(F.unix_micros(value.cast("timestamp")))
    if isinstance(kind, T.DecimalType):
        digits = F.lpad(F.translate(F.format_number(F.abs(value), kind.scale), ",", ""), 42, "0")
        falling = F.translate(digits, "0123456789", "9876543210")
        return F.encode(F.when(value < 0, F.concat(F.lit("-"), falling)).otherwise(F.concat(F.lit("0"), digits)), "UTF-8")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
        return _eight_bytes(F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))
    return _eight_bytes(value.cast("bigint"))


def _key_bytes(df: DataFrame, columns: Sequence[str], *more: Column) -> Column:
    """The columns, then the longs of ``more``, as bytes in the order of the rows; nulls come first."""
    parts = []
    for c in columns:
        value = F.col(f"`{c}`")
        parts.append(F.when(value.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), _value_bytes(value, df.schema[c].dataType))))
    return F.concat(*parts, *[_eight_bytes(m) for m in more])


def _shared(low: bytes, high: bytes) -> int:
    """Length of the common start."""
    return next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))


def divided(keys: DataFrame, bucket: str, limit: int) -> DataFrame:
    """Adds ``_leaf`` to rows (bucket, _key, ...) with distinct keys in a bucket: numbers that follow bucket and key, each of at most ``limit`` rows.

    Every round looks at the leaves that hold more: the start that all their keys share is passed over, and quantiles
    of the six bytes after it divide them. A value that fills several quantiles gets a leaf of its own, so
    every round makes progress. Only counts, starts and quantiles of crowded leaves pass through the driver, whose number
    follows from the rows over ``limit``.
    """
    spark = keys.sparkSession
    counts = {r[0]: r[1] for r in keys.groupBy(bucket).count().collect()}
    names = sorted(counts)
    first = spark.createDataFrame([(b, i) for i, b in enumerate(names)], f"{bucket} {keys.schema[bucket].dataType.simpleString()}, _leaf long")
    rows, sizes = keys.join(F.broadcast(first), bucket), [counts[b] for b in names]
    passed, span = [0] * len(sizes), SHARED_BYTES
    while crowded := [i for i, n in enumerate(sizes) if n > limit]:
        known = spark.createDataFrame([(i, passed[i]) for i in crowded], "_leaf long, _passed int")
        scope = rows.join(F.broadcast(known), "_leaf")
        piece = F.expr(f"substring(_key, _passed + 1, {span})")
        seen = scope.groupBy("_leaf").agg(F.min(piece).alias("low"), F.max(piece).alias("high")).collect()
        for r in seen:
            passed[r["_leaf"]] += _shared(bytes(r["low"]), bytes(r["high"]))
        same = {r["_leaf"] for r in seen if r["low"] == r["high"]}
        span = min(1 << 16, 16 * span) if same else SHARED_BYTES
        parting = [i for i in crowded if i not in same]
        if not parting:
            continue
        lead = F.conv(F.rpad(F.hex(F.expr("substring(_key, _passed + 1, 6)")), 12, "0"), 16, 10).cast("bigint")
        known = spark.createDataFrame([(i, passed[i]) for i in parting], "_leaf long, _passed int")
        parts = max(2, min(2 * max(sizes[i] for i in parting) // limit + 1, ROUND_BOUNDS // len(parting)))
        shares = [k / parts for k in range(1, parts)]
        leads = rows.join(F.broadcast(known), "_leaf").groupBy("_leaf")
        bounds: dict[int, list[int]] = {}
        for r in leads.agg(F.percentile_approx(lead, shares, 4 * parts).alias("at")).collect():
            often = {x for x, y in zip(r["at"], r["at"][1:]) if x == y} | ({r["at"][0]} if parts == 2 else set())
            bounds[r["_leaf"]] = sorted({*r["at"], *(x + 1 for x in often)})
        base, steps = 0, []
        for i in range(len(sizes)):
            steps.append((i, base, passed[i], bounds.get(i)))
            base += 1 + len(bounds.get(i, ()))
        step = spark.createDataFrame(steps, "_leaf long, _base long, _passed int, _bounds array<long>")
        inside = F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda x: x <= lead)))
        rows = rows.join(F.broadcast(step), "_leaf").withColumn("_leaf", F.col("_base") + inside).drop("_base", "_passed", "_bounds")
        rows = written(rows, "divided")
        found = {r[0]: r[1] for r in rows.groupBy("_leaf").count().collect()}
        passed = [p for i, _, p, b in steps for _ in range(1 + len(b or ()))]
        sizes = [found.get(i, 0) for i in range(base)]
    return rows


def _rank_copies(rows: DataFrame, order: RowOrder, hot_rows: int) -> DataFrame:
    """The same for crowded buckets: equal rows are one row with a count until they have a rank.

    Distinct rows are ranked in leaves of at most ``hot_rows``; one row a leaf meets in a task.
    """
    content = _content(rows)
    plain = rows.columns
    others = [F.first(F.col(f"`{c}`")).alias(c) for c in plain if c != order.bucket]
    keyed = rows.withColumn("_key", _key_bytes(rows, order.sort_by, content))
    counted = written(keyed.groupBy(order.bucket, "_key").agg(*others, F.count("*").alias("_copies")), "crowded-rows")
    leaves = divided(counted.select(order.bucket, "_key", "_copies"), order.bucket, hot_rows)
    totals = leaves.groupBy(order.bucket, "_leaf").agg(F.sum("_copies").alias("_in_leaf"))
    before = Window.partitionBy(order.bucket).orderBy("_leaf").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_start", F.coalesce(F.sum("_in_leaf").over(before), F.lit(0))).select("_leaf", "_start")
    inside = Window.partitionBy("_leaf").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    within = leaves.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    starts = keyed_join(within, written(offsets, "leaf-offsets"), "_leaf").select(order.bucket, "_key", (F.col("_start") + F.col("_inside")).alias("_rank"))
    back = _put_back(counted.join(starts, [order.bucket, "_key"]), "_copies", "_key")
    return back.withColumn("_rank", F.col("_rank") + F.col("_copy")).drop("_copy", "_key").select(*plain, "_rank")


def with_position(order: RowOrder, name: str = "position", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the 0-based position of each row in the order."""
    hot = _hot_buckets(order, hot_rows)
    if hot:
        is_hot = F.col(order.bucket).isin(hot)
        cold = _rank_rows(order.rows.where(~is_hot), order)
        ranked = cold.unionByName(_rank_copies(order.rows.where(is_hot), order, hot_rows))
    else:
        ranked = _rank_rows(order.rows, order)
    offsets = _bucket_offsets(order.rows, order.bucket).select(order.bucket, "n_before")
    return (
        ranked.join(F.broadcast(offsets), order.bucket)  # at most n_buckets rows
        .withColumn(name, F.col("n_before") + F.col("_rank"))
        .drop("n_before", "_rank", *_HELPERS)
    )


@dataclass(frozen=True)
class Cut:
    """Where the first ``wanted`` of ``total`` rows end.

    ``last`` holds the sort columns of the last of them. Of the ``tied`` rows with these values,
    ``taken`` are before the cut. ``even`` says that no bucket is crowded.
    """

    total: int
    wanted: int
    even: bool
    last: tuple | None = None
    taken: int = 0
    tied: int = 0


def _counts(rows: DataFrame, bucket: str) -> list[tuple[int, int]]:
    return sorted(tuple(r) for r in rows.groupBy(bucket).count().collect())


def _locate(counts: list[tuple[int, int]], rest: int) -> tuple[int, int, int]:
    """The bucket that holds the ``rest``-th row, the row's place inside, and the bucket's size."""
    for bucket, n in counts:
        if rest <= n:
            break
        rest -= n
    return bucket, rest, n


def find_cut(
    order: RowOrder, wanted: Callable[[int], int], hot_rows: int = HOT_ROWS, cut_keys: int | None = None
) -> Cut:
    """Reads the sort columns only: once to count the rows of each bucket, which pass through the
    driver, and once to find the cut in its bucket. Where that has more than ``cut_keys`` rows (a million), its distinct keys
    are counted and divided first.
    """
    cut_keys = CUT_KEYS if cut_keys is None else cut_keys
    scope = order.rows.select(*dict.fromkeys([*order.sort_by, *order.levels]))
    counts = _counts(scope, order.bucket)
    total = sum(n for _, n in counts)
    even = max((n for _, n in counts), default=0) <= hot_rows
    goal = rest = max(0, min(wanted(total), total))
    if goal == 0:
        return Cut(total, 0, even)
    bucket, rest, n = _locate(counts, rest)
    scope = scope.where(F.col(order.bucket) == bucket)
    keys = scope.groupBy(*order.sort_by).agg(F.count("*").alias("_tied"))
    if n > cut_keys:
        named = keys.withColumns({"_key": _key_bytes(keys, order.sort_by), _FINE: F.lit(0)})
        leaves = divided(written(named, "cut-keys"), _FINE, cut_keys)
        totals = leaves.groupBy("_leaf").agg(F.sum("_tied")).collect()  # as many as the keys over cut_keys ask for
        leaf, rest, _ = _locate(sorted(tuple(r) for r in totals), rest)
        keys = leaves.where(F.col("_leaf") == leaf).select(*order.sort_by, "_tied")
    up_to = Window.orderBy(*order.sort_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one leaf's keys
    reached = keys.withColumn("_reached", F.sum("_tied").over(up_to)).where(F.col("_reached") >= rest)
    end, tied, *last = reached.agg(F.min(F.struct("_reached", "_tied", *order.sort_by))).first()[0]
    return Cut(total, goal, even, tuple(last), rest - (end - tied), tied)


def _below(columns: Sequence[str], values: Sequence, inclusive: bool) -> Column:
    """``(columns) < (values)``, or ``<=``, with nulls first; spelled out per column so that it can
    be pushed down.
    """
    head, value = F.col(columns[0]), values[0]
    if len(columns) == 1 and inclusive:
        return head.isNull() if value is None else head.isNull() | (head <= F.lit(value))
    below = F.lit(False) if value is None else head.isNull() | (head < F.lit(value))
    if len(columns) == 1:
        return below
    return below | (head.eqNullSafe(F.lit(value)) & _below(columns[1:], values[1:], inclusive))


def _cut_rows(order: RowOrder, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Rows before and after the cut, with helper columns."""
    rows = order.rows
    if cut.last is None:
        return rows.where(F.lit(False)), rows
    upto = _below(order.sort_by, cut.last, inclusive=True)
    if cut.taken == cut.tied:
        return rows.where(upto), rows.where(~upto)
    under = _below(order.sort_by, cut.last, inclusive=False)
    tied = rows.where(upto & ~under)
    content = _content(rows)
    low, high = tied.agg(F.min(content), F.max(content)).first()
    if low != high:
        raise ValueError(f"{list(order.sort_by)} do not identify a row: {cut.last}")

    def copies(n: int) -> DataFrame:
        one = tied.limit(1).withColumn("_copies", F.lit(n).cast("bigint"))
        return _put_back(one, "_copies").drop("_copy")

    return (
        rows.where(under).unionByName(copies(cut.taken)),
        rows.where(~upto).unionByName(copies(cut.tied - cut.taken)),
    )


def first_ordered(order: RowOrder, n: int) -> DataFrame:
    """``first_rows`` that still carry the order's helper columns."""
    return _cut_rows(order, find_cut(order, lambda total: n))[0]


def first_rows(order: RowOrder, n: int) -> DataFrame:
    """Exactly the first n rows of the order: a cap, or a seeded sample without replacement."""
    return first_ordered(order, n).drop(*_HELPERS)


@dataclass(frozen=True)
class Split:
    """Train and validation rows, as orders that ``in_order`` can lay out, and the row counts."""

    train: RowOrder
    val: RowOrder
    n_rows: int
    n_val: int


def split_rows(order: RowOrder, val_ratio: float = 0.1, hot_rows: int = HOT_ROWS) -> Split:
    """Validation = the first ``int(n * val_ratio)`` rows of the order, train = the rest."""
    if not 0 <= val_ratio < 1:
        raise ValueError("val_ratio must be in [0, 1)")
    cut = find_cut(order, lambda total: int(total * val_ratio), hot_rows)
    val, train = (replace(order, rows=rows, even=cut.even) for rows in _cut_rows(order, cut))
    return Split(train, val, cut.total, cut.wanted)


def in_order(order: RowOrder, files: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows laid out for a write: ``files`` part files follow the order and are sorted inside.

    Buckets map to files directly, so there is no extra pass to sample range bounds. Where a bucket
    is crowded, or there are fewer buckets than files, positions map to files instead.
    """
    if order.n_buckets < files or _hot_buckets(order, hot_rows):
        total = order.rows.count()
        placed = with_position(order, "_place", hot_rows)
        file_no = F.floor(F.col("_place") * files / max(1, total)).cast("int")
        return placed.repartitionById(files, file_no).sortWithinPartitions("_place").drop("_place")
    file_no = F.floor(F.col(order.bucket).cast("bigint") * files / order.n_buckets).cast("int")
    return (
        order.rows.repartitionById(files, file_no)
        .sortWithinPartitions(*order.sort_by, _content(order.rows))
        .drop(*_HELPERS)
    )
