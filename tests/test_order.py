import hashlib

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.order import (
    column_order,
    find_cut,
    first_rows,
    in_order,
    seeded_order,
    source_order,
    split_rows,
    with_position,
)


def seeded(ids, seed=42):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1000).select((F.col("id") * 7 - 500).alias("id"), F.lit("x").alias("t")).cache()


IDS = [i * 7 - 500 for i in range(1000)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_order_does_not_depend_on_partitions(numbers, parts):
    rows = numbers.repartition(parts)
    got = with_position(seeded_order(rows, "id")).orderBy("position").collect()
    assert [r.id for r in got] == seeded(IDS)
    assert [r.position for r in got] == list(range(1000))
    assert sorted(r.id for r in first_rows(seeded_order(rows, "id"), 123).collect()) == sorted(seeded(IDS)[:123])
    got = with_position(column_order(rows, "id", 16)).orderBy("position").collect()
    assert [r.id for r in got] == IDS


def test_seed_changes_the_order(numbers):
    other = [r.id for r in with_position(seeded_order(numbers, "id", 7)).orderBy("position").collect()]
    assert other == seeded(IDS, 7) != seeded(IDS)


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 2000])
def test_exact_sizes(numbers, n):
    assert sorted(r.id for r in first_rows(seeded_order(numbers, "id"), n).collect()) == sorted(seeded(IDS)[:n])
    assert sorted(r.id for r in first_rows(column_order(numbers, "id"), n).collect()) == IDS[:n]


def test_uneven_values(spark):
    """Nearly all values crowd one end of the range; buckets follow quantiles, not the range."""
    ids = [*range(500), 10**15, 10**16, -(10**17)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    order = column_order(rows, "id", 16)
    assert [r.id for r in with_position(order).orderBy("position").collect()] == sorted(ids)
    assert order.rows.groupBy(order.bucket).count().agg(F.max("count")).first()[0] < 100
    assert sorted(r.id for r in first_rows(order, 3).collect()) == sorted(ids)[:3]


def test_a_large_bucket_is_split_further(spark, numbers, monkeypatch):
    from tallyframe.operators import order as module

    monkeypatch.setattr(module, "CUT_KEYS", 5)
    for rows, ids in ((numbers, IDS), (numbers.unionByName(numbers.where("id = 200")), sorted([*IDS, 200]))):
        order = column_order(rows, "id", 4)
        for n in (1, 99, 100, 101, 102, 500, 1000):
            assert sorted(r.id for r in first_rows(order, n).collect()) == ids[:n]


def test_null_keys_come_first(spark):
    ids = [None, *range(20)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    for order in (column_order(rows, "id", 8), seeded_order(rows, "id")):
        got = [r.id for r in with_position(order).orderBy("position").collect()]
        assert len(got) == 21
        for n in (1, 5, 20):
            assert set(r.id for r in first_rows(order, n).collect()) == set(got[:n])
        for ratio in (0.1, 0.5):
            split = split_rows(order, ratio)
            assert split.val.plain.count() == int(21 * ratio)
            assert split.train.plain.count() + split.val.plain.count() == 21


def test_column_order_of_texts_dates_and_several_columns(spark):
    rows = [(t, d, i) for i, (t, d) in enumerate([("b", "2020-01-02"), ("a", "2021-01-01"), ("é", None), (None, "2019-05-05"), ("b", "2018-01-01"), ("abcdefgh", "2018-01-01"), ("abcdefga", "2018-01-01")])]
    df = spark.createDataFrame(rows, "t string, d string, id long").withColumn("d", F.to_date("d"))

    def ids(keys):
        return [r["id"] for r in with_position(column_order(df, keys, at_least=4)).orderBy("position").collect()]

    assert ids(["t", "d"]) == [3, 1, 6, 5, 4, 0, 2]
    assert ids(["d", "t"]) == [2, 6, 5, 4, 3, 0, 1]
    with pytest.raises(ValueError, match="cannot be ordered by 'x'"):
        column_order(df.withColumn("x", F.array("id")), "x")


@pytest.mark.parametrize("values", [1, 2, 6])
def test_few_frequent_values_spread_over_tasks(spark, values):
    df = spark.range(20_000, numPartitions=4).select((F.col("id") % values).alias("k"), F.lit("copy").alias("t"))
    order = column_order(df, "k", at_least=4)
    laid = in_order(order, 16, hot_rows=100).withColumn("task", F.spark_partition_id())
    assert laid.groupBy("task").count().agg(F.max("count")).first()[0] <= 20_000 / 16 * 1.5
    placed = with_position(order, hot_rows=100).collect()
    assert [r["k"] for r in sorted(placed, key=lambda r: r["position"])] == sorted(r["k"] for r in placed)
    assert sorted(r["position"] for r in placed) == list(range(20_000))


def test_positions_of_tied_rows_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id"), F.create_map(F.lit("m"), F.col("id")).alias("m"))

    def placed(parts, hot_rows):
        rows = with_position(column_order(df.repartition(parts), "k"), hot_rows=hot_rows).collect()
        return {r["id"]: r["position"] for r in rows}

    assert placed(3, 10**6) == placed(7, 10**6)
    assert placed(3, 10) == placed(5, 10) and sorted(placed(2, 10).values()) == list(range(1000))


@pytest.mark.parametrize("make", [lambda df: seeded_order(df, "id"), lambda df: column_order(df, "id", at_least=2)])
def test_cut_in_a_large_bucket_is_refined(spark, make):
    order = make(spark.range(5000))
    plain, refined = (find_cut(order, lambda total: 1234, cut_keys=n) for n in (10**6, 10))
    assert plain == refined and order.plain.count() == 5000


def test_source_order(spark, tmp_path):
    import json

    for name, start in (("b", 100), ("a", 0)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"x": start + i, "t": None}) for i in range(50)))
    df = spark.read.schema("x long, t string").json(str(tmp_path))
    whole = list(range(50)) + list(range(100, 150))
    assert [r["x"] for r in with_position(source_order(df)).orderBy("position").collect()] == whole
    odd = with_position(source_order(df.where("x % 2 = 1")))
    assert odd.columns == ["x", "t", "position"]
    assert [r["x"] for r in odd.orderBy("position").collect()] == [x for x in whole if x % 2]
    assert sorted(r["x"] for r in first_rows(source_order(df), 60).collect()) == whole[:60]
    df.write.parquet(str(tmp_path / "p.parquet"))
    back = spark.read.parquet(str(tmp_path / "p.parquet"))
    assert with_position(source_order(back)).count() == 100
    with pytest.raises(ValueError, match="straight from files"):
        source_order(spark.range(3))


def test_empty_input(numbers):
    none = numbers.where("id > 10000000")
    for order in (seeded_order(none, "id"), column_order(none, "id")):
        assert with_position(order).count() == 0
        assert first_rows(order, 5).count() == 0
        split = split_rows(order, 0.5)
        assert (split.n_rows, split.train.plain.count(), split.val.plain.count()) == (0, 0, 0)


@pytest.mark.parametrize(("ratio", "n_val"), [(0.0, 0), (0.1, 100), (0.29, 290), (0.333, 333), (0.999, 999)])
def test_split(numbers, ratio, n_val):
    split = split_rows(seeded_order(numbers, "id"), ratio)
    val = [r.id for r in split.val.plain.collect()]
    train = [r.id for r in split.train.plain.collect()]
    assert split.train.plain.columns == ["id", "t"]
    assert (len(val), split.n_val, split.n_rows) == (n_val, n_val, 1000)
    assert sorted(val) == sorted(seeded(IDS)[:n_val])
    assert sorted(train + val) == IDS


def test_split_product_is_a_double(numbers):
    hundred = numbers.where("id < 200")
    assert hundred.count() == 100
    assert split_rows(seeded_order(hundred, "id"), 0.29).val.plain.count() == 28


@pytest.mark.parametrize("ratio", [-0.1, 1, 1.5])
def test_split_ratio_range(numbers, ratio):
    with pytest.raises(ValueError):
        split_rows(seeded_order(numbers, "id"), ratio)


def test_written_order(numbers):
    split = split_rows(seeded_order(numbers, "id"), 0.3)
    assert [r.id for r in in_order(split.val, 5).collect()] == seeded(IDS)[:300]
    assert [r.id for r in in_order(split.train, 5).collect()] == seeded(IDS)[300:]
    assert [r.id for r in in_order(column_order(numbers, "id"), 5).collect()] == IDS


def test_several_keys(spark):
    rows = spark.range(40).selectExpr("id div 4 AS a", "CAST(id % 4 AS INT) AS b")
    got = [(r.a, r.b) for r in with_position(seeded_order(rows, ["a", "b"])).orderBy("position").collect()]
    pairs = [(a, b) for a in range(10) for b in range(4)]
    assert got == sorted(pairs, key=lambda p: hashlib.md5(f"42:{p[0]}:{p[1]}".encode()).hexdigest())


def test_different_rows_that_tie_at_the_cut_raise(numbers):
    rows = numbers.union(numbers.withColumn("t", F.lit("y")))
    with pytest.raises(ValueError, match="do not identify"):
        first_rows(seeded_order(rows, "id"), 7)
    assert first_rows(seeded_order(rows, "id"), 8).count() == 8


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of the rows are copies of one row, and a few rows have one copy."""
    rows = spark.range(2000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 6 WHEN id > 1990 THEN id - 5 ELSE id END AS id"
    )
    return rows.withColumn("t", F.concat(F.lit("t"), F.col("id").cast("string"))).cache()


CROWDED = [6 if i % 3 == 0 else i - 5 if i > 1990 else i for i in range(2000)]


@pytest.mark.parametrize("order", [lambda df: seeded_order(df, "id"), lambda df: column_order(df, "id", 16)])
def test_copies(crowded, order):
    order = order(crowded)
    place = {i: k for k, i in enumerate(seeded(set(CROWDED)))} if len(order.sort_by) > 1 else {i: i for i in CROWDED}
    want = sorted(CROWDED, key=place.get)
    for hot_rows in (100, 10**6):
        rows = with_position(order, hot_rows=hot_rows).orderBy("position").collect()
        assert [r.position for r in rows] == list(range(2000))
        assert [r.id for r in rows] == want and all(r.t == f"t{r.id}" for r in rows)
    first = want.index(6)
    for n in (first, first + 1, first + 300, first + CROWDED.count(6), first + CROWDED.count(6) + 1):
        assert sorted(r.id for r in first_rows(order, n).collect()) == sorted(want[:n])
    for ratio in (0.1, 0.3, 0.5, 0.8):
        n = int(2000 * ratio)
        for hot_rows in (100, 10**6):
            split = split_rows(order, ratio, hot_rows)
            assert split.train.even == (hot_rows > 2000)
            assert [r.id for r in in_order(split.val, 4, hot_rows).collect()] == want[:n]
            assert [r.id for r in in_order(split.train, 4, hot_rows).collect()] == want[n:]


def test_copies_are_spread_over_tasks(spark, crowded, monkeypatch):
    from tallyframe.operators import order as module

    monkeypatch.setattr(module, "CHUNK_ROWS", 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = with_position(seeded_order(crowded, "id"), hot_rows=100)
        tasks = ranked.where("id = 6").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 2 and sum(r["count"] for r in tasks) == CROWDED.count(6)
        files = in_order(seeded_order(crowded, "id"), 10, hot_rows=100).groupBy(F.spark_partition_id()).count().collect()
        assert sorted(r["count"] for r in files) == [200] * 10
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_only_keys_are_read_for_the_cut(spark, tmp_path, numbers):
    """The cut is a literal, so a column order reaches the parquet scan as a filter."""
    numbers.write.parquet(str(tmp_path / "t"))
    rows = first_rows(column_order(spark.read.parquet(str(tmp_path / "t")), "id"), 10)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,-437)" in plan and "Exchange" not in plan


def long_keys(n):
    """Texts that agree in a long start, then in another; some short, empty, null or with odd bytes."""
    heads = ["https://example.org/" + "a/" * 200, "https://example.org/" + "a/" * 200 + "b" * 700, "é\0", "é\0\0", "x"]
    return [None, "", *[heads[i % len(heads)] + str(i * 7919 % n) for i in range(n)]]


def by_bytes(keys):
    return sorted(keys, key=lambda k: b"" if k is None else b"\1" + k.encode())


def test_keys_that_begin_alike_are_divided(spark):
    from tallyframe.operators.order import _key_bytes, divided

    keys = long_keys(6000)
    df = spark.createDataFrame([(0, k) for k in keys], "b int, k string")
    leaves = divided(df.withColumn("_key", _key_bytes(df, ["k"])), "b", 150)
    assert leaves.groupBy("_leaf").count().agg(F.max("count")).first()[0] <= 150
    rows = sorted(leaves.collect(), key=lambda r: (r["_leaf"], bytes(r["_key"])))
    assert [r["k"] for r in rows] == by_bytes(keys)


def test_positions_cut_and_split_of_keys_that_begin_alike(spark, monkeypatch):
    from tallyframe.operators import order as module

    keys = long_keys(2500)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long").repartition(5)
    rows = rows.unionByName(rows.where("i % 9 = 0")).unionByName(rows.where("i = 17").join(spark.range(300).drop("id")))
    want = by_bytes([k for i, k in enumerate(keys) for _ in range(1 + (i % 9 == 0) + 300 * (i == 17))])
    order = column_order(rows, "k", at_least=4)
    placed = sorted(with_position(order, hot_rows=100).collect(), key=lambda r: r["position"])
    assert [r["k"] for r in placed] == want and [r["position"] for r in placed] == list(range(len(want)))
    monkeypatch.setattr(module, "CUT_KEYS", 60)
    for n in (1, 2, 700, len(want) - 1):
        cut = find_cut(order, lambda total, n=n: n, cut_keys=60)
        assert cut.last == (want[n - 1],) and cut.total == len(want)
        assert sum(1 for k in want if k == want[n - 1]) == cut.tied
    split = split_rows(order, 0.25)
    assert by_bytes(r["k"] for r in split.val.plain.collect()) == want[: len(want) // 4]
    laid = in_order(order, 8, hot_rows=100).withColumn("task", F.spark_partition_id())
    assert laid.groupBy("task").count().agg(F.max("count")).first()[0] <= len(want) / 8 * 1.5


def test_all_kinds_of_keys_sort_as_their_bytes(spark):
    import itertools
    import random

    rng = random.Random(3)
    numbers = [None, 0, -1, 1, 2**62, 2**62 + 1, -(2**62), 5, 5]
    doubles = [None, 0.0, -0.0, 1.5, -1.5, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), 5e-324]
    texts = [None, "", "\0", "a", "a\0", "a\0b", "ab", "é"]
    rows = [(*r, rng.choice(numbers)) for r in itertools.product(numbers[:5], doubles, texts)]
    df = spark.createDataFrame(rows, "n long, x double, t string, m long")
    df = df.withColumns({"d": (F.col("m") / 10**17).cast("decimal(10,4)"), "w": F.timestamp_seconds(F.col("m") % 1000), "y": F.col("m") > 0})
    from tallyframe.operators.order import _key_bytes

    for columns in (["n", "x", "t"], ["x", "t", "n"], ["t", "n", "x"], ["d", "w", "y", "m", "t", "n", "x"]):
        keyed = df.withColumn("_key", _key_bytes(df, columns)).orderBy(*columns)
        keys = [bytes(r["_key"]) for r in keyed.collect()]
        assert keys == sorted(keys), columns
        assert len(set(keys)) == df.select(*columns).distinct().count()


def test_a_file_that_cannot_be_split_has_a_source_order(spark, tmp_path):
    import gzip

    lines = [f"line {i * 7 % 1000}" for i in range(1000)]
    for part in range(3):
        with gzip.open(f"{tmp_path}/{part}.txt.gz", "wt") as f:
            f.write("\n".join(lines[part * 300 : part * 300 + (300 if part < 2 else 400)]))
    rows = spark.read.text(str(tmp_path)).where("value NOT LIKE '%5'")
    placed = sorted(with_position(source_order(rows)).collect(), key=lambda r: r["position"])
    assert [r["value"] for r in placed] == [x for x in lines if not x.endswith("5")]
