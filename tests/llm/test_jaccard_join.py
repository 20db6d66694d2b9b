"""Near-duplicate components against all pairs of shingle sets."""

import random

import numpy as np
import pytest
from helpers import AWKWARD, docs_of, rows_of, text, with_clashes, words

from tallyframe.llm import jaccard_join
from tallyframe.llm.components import components
from tallyframe.llm.jaccard_join import near_duplicate_components, one_of_each
from tallyframe.llm.shingles import shingle_set, word_hashes


def sets_of(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_force(texts):
    sets, root = sets_of(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [(i, len(sets[i]), root[i]) for i in range(len(texts))]


def family(size, n, edits, seed):
    rng, base = random.Random(seed), words(n, seed)
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("pairs_up_to, block, hot_sets, shingles", [(32, 2048, 10**6, 10**7), (2, 8, 10**6, 10**7), (2, 2048, 10, 10**7), (2, 2048, 3, 500)])
def test_equals_all_pairs(spark, monkeypatch, pairs_up_to, block, hot_sets, shingles):
    monkeypatch.setattr(jaccard_join, "PAIRS_UP_TO", pairs_up_to)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT_SETS", hot_sets)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles)
    texts = [*family(40, 60, 4, 1), *family(25, 120, 7, 2), *family(6, 12, 1, 3), *(text(n, n) for n in range(1, 40))]
    texts += ["one two three four", "one two three four five", "one two three four", "A b\tC d e", "a b c  d E"]
    random.Random(4).shuffle(texts)
    got = near_duplicate_components(docs_of(spark, texts))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute_force(texts), key=repr)


def test_awkward_texts_and_repeated_rows(spark):
    extra = [(50, AWKWARD[6], "en", "s", 1), (50, AWKWARD[6], "en", "s", 1), (None, AWKWARD[6], "en", "s", 1)]
    docs = with_clashes(docs_of(spark, AWKWARD, extra), "sig", "n", "token", "th", "part")
    got = rows_of(near_duplicate_components(docs), "doc_id", "n_shingles", "component_id")
    long = len(sets_of([AWKWARD[6]])[0])
    expected = [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, long, 6), (7, 1, 7)]
    expected += [(50, long, 6)] * 2 + [(None, long, 6)]
    assert got == sorted(expected, key=repr)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(i,) for i in range(8)]


def test_rows_that_share_an_id(spark):
    a, b = text(30, 1), text(30, 2)
    docs = docs_of(spark, [], [(5, a, "", "", 0), (5, b, "", "", 0), (9, a, "", "", 0), (None, b, "", "", 0), (None, text(9, 3), "", "", 0)])
    assert rows_of(one_of_each(docs), "doc_id", "text") == sorted([(5, a), (5, b), (None, text(9, 3))], key=repr)


def test_empty_table(spark):
    assert near_duplicate_components(docs_of(spark, [])).count() == 0
    assert one_of_each(docs_of(spark, [])).count() == 0


def test_words_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    raw = (text(3000, 5) + "\t" + "x" * 500 + " end").encode()
    whole = word_hashes(raw)
    monkeypatch.setattr("tallyframe.llm.shingles._CHUNK", 64)
    assert np.array_equal(whole, word_hashes(raw)) and len(whole) == 3002
    assert len(shingle_set(b"")) == 0 and len(shingle_set(None)) == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
