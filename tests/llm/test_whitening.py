"""Whitening against eigenvectors of the covariance, exact sums against whole numbers of any size."""

import math

import numpy as np
import pytest
from helpers import SF_DIR

from tallyframe.llm.whitening import Centre, bidiagonalise, whiten

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, rows):
    as_floats = lambda v: None if v is None else [None if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, as_floats(v), 0) for i, v in rows], SCHEMA)


def brute_force(rows, components=16):
    """Rows (id, n, deviation), components, eigenvalues and shares, by Python's whole numbers and numpy's eigh."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in kept]
    distinct = sorted({x for _, x in grid})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in distinct])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    found = {i: (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.array([(n * c - s) / n for c, s in zip(x, sums)])) for i, x in grid}
    return found, vectors, values, values / np.trace(cov)


def check(spark, rows, known):
    got = {}
    for r in whiten(table(spark, rows)).collect():
        got.setdefault(r["vec_id"], []).append(r)
    found, vectors, values, shares = brute_force(rows)
    rank = int((values > 1e-13 * values[0]).sum())
    assert set(got) == set(found)
    signs = {}
    for vec_id, records in got.items():
        n, deviation, centred = found[vec_id]
        records = sorted(records, key=lambda r: r["component"])
        assert [r["component"] for r in records] == list(range(1, rank + 1))
        for r in records:
            k = r["component"] - 1
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] <= 1e-9
            assert r["explained"] == pytest.approx(shares[k], rel=1e-10)
            if known:
                want = centred @ vectors[k] / values[k] ** 0.5
                if abs(want) > 1e-6:
                    signs.setdefault(k, set()).add(np.sign(want * r["whitened"]))
                assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-9)
    assert all(len(s) == 1 for s in signs.values())


def spread_rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(i, (row * 0.9 ** np.arange(dims)).tolist()) for i, row in enumerate(rng.standard_normal((n, dims)))]


def test_components_equal_eigenvectors(spark):
    rows = spread_rows(300, 24, 1)
    check(spark, rows, known=True)


def test_copies_ties_and_unusable_rows(spark):
    rows = spread_rows(60, 6, 2)
    copies = [(1000 + i, rows[3][1]) for i in range(500)] + [rows[3]]
    bad = [(5000, None), (5001, [1.0, None, 0, 0, 0, 0]), (5002, [float("nan")] * 6), (5003, [float("inf"), 0, 0, 0, 0, 0]), (5004, []), (5005, [1.0])]
    found, *_ = brute_force(rows)
    plain = {r["vec_id"]: r for r in whiten(table(spark, rows)).where("component = 1").collect()}
    mixed = whiten(table(spark, rows + copies + bad)).where("component = 1").collect()
    assert len(mixed) == len(rows) + len(copies)
    for r in mixed:
        twin = plain[3 if r["vec_id"] >= 1000 else r["vec_id"]]
        assert (r["n"], r["deviation"], r["whitened"]) == (len(found), twin["deviation"], pytest.approx(twin["whitened"], abs=1e-9))


def test_equal_deviations_and_low_rank(spark):
    axes = [(i, [4.0 * s * (i // 2 == d) for d in range(8)]) for i, s in enumerate([1, -1] * 8)]
    got = whiten(table(spark, axes)).collect()
    assert len(got) == 16 * 8 and all(r["explained"] == pytest.approx(1 / 8) and r["identity_error"] < 1e-9 for r in got)
    flat = [(i, [float(i), 2.0 * i, -float(i), 5.0]) for i in range(20)]
    check(spark, flat, known=True)


def test_tables_without_a_component(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten(table(spark, rows)).collect() == []


def test_wide_and_huge_entries(spark):
    wide = [(i, v) for i, v in spread_rows(40, 1500, 4)]
    got = whiten(table(spark, wide)).where("component = 1").collect()
    assert len(got) == 40 and all(r["identity_error"] < 1e-6 for r in got)
    huge = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])]
    assert all(r["deviation"] is None for r in whiten(table(spark, huge)).collect() if r["vec_id"] != 2)


def test_clashing_columns_are_not_read(spark):
    from pyspark.sql import functions as F

    rows = spread_rows(30, 4, 5)
    frame = table(spark, rows).withColumns({c: F.lit("extra") for c in ("x", "id", "n", "component", "part", "dims")})
    assert whiten(frame).count() == 30 * 4


def test_exact_deviations_beyond_a_long():
    centre = Centre(3 * 10**9, (5, 10**10))
    assert centre.deviations(np.array([[1, 4], [0, 3]])) == [None, (3 * 10**9 * 0 - 5) ** 2 + (3 * 10**9 * 3 - 10**10) ** 2]


def test_steps_are_repeated_from_fresh_directions():
    """Two groups of equal deviations: a single start finds one of each."""
    rng = np.random.default_rng(3)
    left, right = (np.linalg.qr(rng.standard_normal((m, 40)))[0] for m in (200, 40))
    values = np.array([9.0] * 3 + [5.0] * 3 + [2.0] * 34)
    x = left @ np.diag(values) @ right.T
    vectors, got = bidiagonalise(lambda p: (float((x @ p) @ (x @ p)), x.T @ (x @ p)), 40, 6, float(np.linalg.norm(x)))
    assert got == pytest.approx(values[:6], rel=1e-12)
    assert np.abs(vectors @ vectors.T - np.eye(6)).max() < 1e-12


def test_given_table(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    check(spark, [(r["vec_id"], r["embedding"]) for r in vectors.collect()], known=True)
