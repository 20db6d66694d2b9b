"""Graph search against brute force, on random vectors, copies and unusable rows."""

import math

import numpy as np
import pytest

from tallyframe.llm.hnsw import Graph, build_index, cosines, search, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, queries, k):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = []
    for q, u in queries:
        u = np.array(u, np.float32).astype(float)
        found = [(-float(cosines(u, v[None])[0]), i) for i, v in fine if i != q and len(v) == len(u)]
        out += [(q, rank, i) for rank, (_, i) in enumerate(sorted(found)[:k], 1)]
    return out


def random_rows(n, dims, seed):
    return [(i, row.tolist()) for i, row in enumerate(np.random.default_rng(seed).standard_normal((n, dims)))]


def run(spark, rows, queries, k=5, **index):
    frame = lambda x: spark.createDataFrame([(i, v, 0) for i, v in x], SCHEMA)
    found = search(build_index(frame(rows), k, **index), frame(queries), k, block=7)
    return sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect())


def test_graph_recall_and_round_trip():
    v = unit(np.random.default_rng(1).standard_normal((800, 32)))
    graph = Graph.build(v)
    loaded = Graph.load(v, graph.flat(), graph.entry)
    hits = 0
    for q in v[::10]:
        got = graph.search(q)[:10]
        assert loaded.search(q)[:10] == got
        hits += len(set(got) & set(np.argsort(-(v @ q), kind="stable")[:10].tolist()))
    assert hits / 800 > 0.95


def test_recall_over_shards(spark):
    rows = random_rows(600, 16, 2)
    queries = rows[::50]
    got, want = run(spark, rows, queries, shard_rows=200), brute_force(rows, queries, 5)
    assert len(got) == len(want) and len({(q, i) for q, _, i in got} & {(q, i) for q, _, i in want}) >= 0.95 * len(want)


def test_copies_ties_and_small_tables(spark):
    base = random_rows(12, 8, 3)
    rows = base + [(100 + i, base[3][1]) for i in range(300)] + [(3, base[3][1])]
    queries = [base[0], base[3], (150, base[3][1]), (100, base[3][1])]
    assert run(spark, rows, queries) == sorted(brute_force([*base, *rows[12:-1]], queries, 5))
    few = base[:3]
    assert run(spark, few, few[:1]) == brute_force(few, few[:1], 5)
    assert run(spark, few[:1], few[:1]) == []


def test_unusable_vectors_take_no_part(spark):
    rows = random_rows(20, 4, 4)
    bad = [(50, None), (51, [0.0] * 4), (52, [1.0, None, 0.0, 0.0]), (53, [float("nan"), 1.0, 0.0, 0.0]), (54, [float("inf"), 1.0, 0.0, 0.0]), (None, rows[0][1]), (55, [])]
    other = [(60, [1.0, 2.0])]
    queries = [rows[0], *bad[:5]]
    assert run(spark, rows + bad + other, queries) == brute_force(rows, rows[:1], 5)


@pytest.mark.parametrize("rows", [[], [(0, None)]])
def test_nothing_to_search(spark, rows):
    assert run(spark, rows, rows) == []


def test_vectors_of_any_size_have_scores(spark):
    """Squares of these would overflow or vanish; a cosine does not depend on length."""
    frame = spark.createDataFrame([(i, [s * math.cos(i * (k + 1)) for k in range(8)], 0) for i, s in enumerate([1e200, 1e-200, 1.0, -1e300, 3e-310])], "vec_id long, embedding array<double>, label int")
    got = search(build_index(frame, 4), frame, 4).collect()
    assert len(got) == 5 * 4 and all(-1.0000001 <= r["score"] <= 1.0000001 for r in got)
    plain = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    u, v = (np.array([math.cos(i * (k + 1)) for k in range(8)]) for i in (0, 2))
    assert plain[0, 2] == pytest.approx(float(u @ v / math.sqrt((u @ u) * (v @ v))), rel=1e-12)


def test_recall_on_a_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    queries = [r for r in rows if r[0] % 50 == 0]
    got = search(build_index(vectors, 5, shard_rows=600), vectors.where("vec_id % 50 = 0"), 5, block=17)
    want = {(q, i) for q, _, i in brute_force(rows, queries, 5)}
    found = {(r["query_id"], r["vec_id"]) for r in got.collect()}
    assert len(found) == len(want) and len(found & want) >= 0.95 * len(want)


def test_each_shard_has_a_task_of_its_own(spark):
    rows = random_rows(900, 4, 8)
    index = build_index(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), 3, shard_rows=70)
    assert index.count == 13 == index.shards.count()
    assert index.shards.select("ids").count() == index.shards.inputFiles().__len__()


def test_wide_vectors_ties_and_extra_columns(spark):
    from helpers import with_clashes

    wide = [(i, v) for i, v in random_rows(30, 3000, 9)] + [(100 + i, [1.0] * 5) for i in range(4)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in wide], SCHEMA)
    clashing = with_clashes(frame, "h1", "h2", "v", "shard", "dims", "block", "r", "score", "rank", "query_id")
    got = search(build_index(clashing, 3), clashing.where("vec_id IN (0, 101)"), 3).collect()
    ranked = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got)
    assert ranked == sorted(brute_force(wide, [wide[0], wide[31]], 3))
    assert [i for q, _, i in ranked if q == 101] == [100, 102, 103]
