"""Rewards, penalties and group advantages against Python's statistics."""

import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import rollouts

SCHEMA = "prompt long, k int, reward double"


def advantages(groups):
    out = {}
    for prompt, rewards in groups.items():
        known = [r for r in rewards if r is not None]
        for k, r in enumerate(rewards):
            if r is None:
                out[prompt, k] = None
            elif len(known) == 1:
                out[prompt, k] = 0.0
            else:
                out[prompt, k] = (r - statistics.fmean(known)) / (statistics.stdev(known) + 1e-6)
    return out


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": -1, "hot_rows": 7}])
def test_group_advantages(spark, sizes):
    groups = {1: [1.0, 0.0, 1.0, 1.0], 2: [0.3] * 9, 3: [0.5], 4: [None, 1.0, -0.25, 0.125], 5: [None], 6: [i / 7 for i in range(40)]}
    rows = [(p, k, r) for p, rewards in groups.items() for k, r in enumerate(rewards)] + [(None, 0, 1.0)]
    found = rollouts.group_advantages(spark.createDataFrame(rows, SCHEMA).repartition(5), "prompt", **sizes)
    assert found.columns[-1] == "advantage" and set(found.columns) == {"prompt", "k", "reward", "advantage"}
    got = {(r["prompt"], r["k"]): r["advantage"] for r in found.collect()}
    want = advantages(groups)
    assert set(got) == {*want, (None, 0)}
    assert all(got[key] == (None if w is None else pytest.approx(w, abs=1e-4)) for key, w in want.items())
    assert {got[2, k] for k in range(9)} == {0.0}


def test_moments_do_not_depend_on_partitions(spark):
    df = spark.range(5000).selectExpr("id % 3 AS prompt", "0 AS k", "1000 + cos(id) / 3 AS reward")
    found = [sorted(map(tuple, rollouts.group_moments(df.repartition(n), ["prompt"]).collect())) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2]
    values = [1000 + r for r in (x["c"] for x in spark.range(5000).selectExpr("id", "cos(id) / 3 AS c").where("id % 3 = 1").collect())]
    assert found[0][1][3] == pytest.approx(statistics.stdev(values), rel=1e-5)


def test_hot_prompts_are_split(spark):
    """All rows of one prompt, and the moments too large to broadcast: the join is dealt over tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(4000, numPartitions=8).selectExpr("0L AS prompt", "CAST(id AS INT) AS k", "CAST(id % 2 AS DOUBLE) AS reward")
        found = rollouts.group_advantages(df, "prompt", broadcast_bytes=-1, hot_rows=200)
        per_task = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) == 4 and max(r["count"] for r in per_task) < 2400
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rewards_and_penalties(spark):
    df = spark.createDataFrame([(0, True), (100, False), (600, None), (1000, True), (1500, True), (None, True)], "n long, ok boolean")
    got = df.select(rollouts.binary_reward(F.col("ok")), rollouts.overlong_penalty(F.col("n"), 1000, 800, 2.0)).collect()
    assert [tuple(r) for r in got] == [(1, 0.0), (0, 0.0), (0, -1.0), (1, -2.0), (1, -2.0), (1, 0.0)]
    assert rollouts.MAX_RESPONSE - rollouts.OVERLONG_BUFFER == 12288
    for bad in ({"buffer": 0}, {"buffer": 10, "max_length": 5}):
        with pytest.raises(ValueError, match="buffer"):
            rollouts.overlong_penalty(F.col("n"), **bad)


def test_left_truncation(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1],), ([],), (None,)], "t array<int>")
    assert [r[0] for r in df.select(rollouts.left_truncate(F.col("t"), 2)).collect()] == [[3, 4], [1], [], None]
    assert [r[0] for r in df.select(rollouts.left_truncate(F.col("t"), 0)).collect()] == [[], [], [], None]
    with pytest.raises(ValueError, match="negative"):
        rollouts.left_truncate(F.col("t"), -1)
