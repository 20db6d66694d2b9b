import random
import statistics

import numpy as np
import pytest

from tallyframe.operators.lengths import length_frequencies, length_histogram, length_stats


def groups(seed):
    rng = random.Random(seed)
    made = {}
    for g in range(40):
        low = rng.randrange(2000)
        high = low + rng.choice([0, 1, 3, 39, 40, 41, 80, 200, 16000])
        made[g] = [rng.randint(low, high) for _ in range(rng.choice([1, 2, 5, 50, 400]))]
    return made


@pytest.fixture(scope="module")
def made():
    return groups(3)


@pytest.fixture(scope="module")
def counts(spark, made):
    rows = [(g, v) for g, vs in made.items() for v in vs]
    samples = spark.createDataFrame(rows, "g int, output_tokens long").repartition(7)
    return length_frequencies(samples, ["g"]).cache()


def test_stats_match_the_statistics_module(counts, made):
    got = {r.g: r for r in length_stats(counts, ["g"]).collect()}
    assert got.keys() == made.keys()
    for g, values in made.items():
        row = got[g]
        assert (row.n, row.min, row.max) == (len(values), min(values), max(values))
        assert row.mean == pytest.approx(statistics.mean(values), rel=1e-12)
        assert row.std == pytest.approx(statistics.stdev(values) if len(values) > 1 else 0.0, rel=1e-12)
        want = np.percentile(values, [25, 50, 75, 95])
        assert [row.p25, row.median, row.p75, row.p95] == pytest.approx(list(want), rel=1e-12)


def test_histogram_matches_numpy(counts, made):
    got = {}
    for r in length_histogram(counts, ["g"]).collect():
        got.setdefault(r.g, []).append(r)
    for g, values in made.items():
        rows = sorted(got[g], key=lambda r: r.bin)
        want, edges = np.histogram(values, bins=40)
        assert [r.bin for r in rows] == list(range(40))
        assert [r.n for r in rows] == list(want)
        assert [r.bin_start for r in rows] == pytest.approx(list(edges[:-1]))
        assert [r.bin_end for r in rows] == pytest.approx(list(edges[1:]))


def test_lengths_on_rounded_edges(spark):
    """Ranges where double-precision edges put a length into another bin than exact ones."""
    made = {}
    for low in (0, 1, 100, 1234):
        for width in [*range(1, 1500, 13), 1448, 16384]:
            made[low * 100000 + width] = range(low, low + width + 1)
    rows = spark.createDataFrame([(g, v[0], v[-1]) for g, v in made.items()], "g int, lo long, hi long")
    counts = rows.selectExpr("g", "explode(sequence(lo, hi)) AS length", "1L AS n_rows")
    got = {}
    for r in length_histogram(counts, ["g"]).orderBy("g", "bin").collect():
        got.setdefault(r.g, []).append(r.n)
    exact = 0
    for g, values in made.items():
        want = list(np.histogram(np.array(values), bins=40)[0])
        assert got[g] == want
        low, width = values[0], values[-1] - values[0]
        exact += list(np.bincount([min(39, (v - low) * 40 // width) for v in values], minlength=40)) == want
    assert exact < len(made)


def test_equal_lengths_fall_into_the_middle(spark):
    samples = spark.createDataFrame([(5,)] * 3, "output_tokens long")
    rows = length_histogram(length_frequencies(samples)).where("n > 0").collect()
    assert [(r.bin, r.n) for r in rows] == [(20, 3)]
    assert (rows[0].bin_start, rows[0].bin_end) == pytest.approx((5.0, 5.025))


def test_no_rows(spark):
    none = length_frequencies(spark.createDataFrame([], "output_tokens long"))
    row = length_stats(none).first()
    assert row.n == 0 and row.mean is None and row.std is None and row.max is None
    assert length_histogram(none).count() == 0


def test_deviation_is_exact_for_large_counts(spark):
    """Sums far beyond 2**53, where floating-point moments lose digits."""
    counts = spark.sql(
        "SELECT 10000000000 AS n_rows, 16384L AS length UNION ALL SELECT 10000000000, 16383L"
    )
    assert length_stats(counts).first()["std"] == pytest.approx(0.5, rel=1e-9)


def test_missing_length_counts_as_zero(spark):
    samples = spark.createDataFrame([(None,), (4,)], "output_tokens long")
    assert length_stats(length_frequencies(samples)).first()["mean"] == 2.0
