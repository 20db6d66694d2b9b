"""Lexical search against scores of every document, on random texts, the given table and awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, SF_DIR, docs_of, rows_of, with_clashes

from tallyframe.llm import lexical_search
from tallyframe.llm.lexical_search import Postings, accumulated, best, build_index, count_terms, norms, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=20):
    """(item_id, rank, doc_id, score) by the score of every document (doc_id, text)."""
    held = [(i, Counter(t)) for i, t in ((i, terms_of(t)) for i, t in docs) if t]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, counts in held:
            m = 100 - 25 + (25 * sum(counts.values()) * n_docs) // n_terms
            score = 0
            for t in terms_of(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id))
        out += [(item_id, rank, doc_id, -s) for rank, (s, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, k=20, **sizes):
    found = search(build_index(docs), spark.createDataFrame(items, ITEMS), k, **sizes)
    return rows_of(found, "item_id", "rank", "doc_id", "score")


def random_texts(n, seed, vocabulary=300):
    """Texts whose words are common and rare: word i about as often as 1 / (i + 1)."""
    rng = random.Random(seed)
    names = [f"W{i}" if i % 7 else f"ü{i}é" for i in range(vocabulary)]
    shares = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rng.choices(names, shares, k=rng.randrange(1, 60))) for _ in range(n)]


def test_equals_brute_force_with_short_and_long_lists(spark):
    texts = random_texts(1500, 1)
    items = [(i, t) for i, t in enumerate(random_texts(40, 2))] + [(99, "nothing of it"), (98, texts[7])]
    assert run(spark, docs_of(spark, texts), items) == sorted(brute_force(enumerate(texts), items), key=repr)


def test_small_shards_and_blocks_give_the_same(spark, monkeypatch):
    texts = random_texts(400, 3)
    items = list(enumerate(random_texts(20, 4)))
    want = sorted(brute_force(enumerate(texts), items, 5), key=repr)
    docs = docs_of(spark, texts).repartition(7)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 11)
    assert run(spark, docs, items, 5, block_terms=60) == want
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 100)
    assert run(spark, docs, items, 5) == want


def test_ties_copies_and_awkward_rows(spark):
    texts = [*AWKWARD, "same words here", "same words here", "Same, WORDS! here_"]
    extra = [(None, "same words here", None, None, None), (9, "same words here", None, None, None)]
    items = [(1, "words"), (1, "words"), (1, "here"), (2, None), (3, ""), (4, "!?"), (None, "é中\U0001f600"), (5, "b b b l")]
    docs = with_clashes(docs_of(spark, texts, extra), "item", "term", "df", "shard", "score", "rank")
    got = search(build_index(docs), with_clashes(spark.createDataFrame(items, ITEMS), "item", "c", "doc_id")).collect()
    of = lambda i: [(r["rank"], r["doc_id"]) for r in sorted((r for r in got if r["item_id"] == i), key=lambda r: r["rank"])]
    assert len(of(1)) == 2 * 5
    scores = {r["score"] for r in got if r["item_id"] == 1}
    assert [d for _, d in of(1)][::2] == [8, 9, 9, 10, None] and len(scores) == 1
    assert of(None) == [(1, 5)] and of(5) == [(1, 6)]
    assert not {2, 3, 4} & {r["item_id"] for r in got}


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert run(spark, none, [(1, "a")]) == [] == run(spark, docs_of(spark, ["", None, "?"]), [(1, "a")])
    assert rows_of(search(build_index(docs_of(spark, ["a"])), spark.createDataFrame([], ITEMS)), "item_id") == []


def test_terms():
    text = "Ab-c_1\x7f\x00É’x [Z]" + " q" * 600_000 + "y" * 1_100_000 + " end"
    assert count_terms(text.encode()) == Counter(t.encode() for t in terms_of(text))
    assert count_terms(None) == count_terms(b"") == Counter()


def test_windows_that_cannot_win_are_skipped():
    rng = np.random.default_rng(5)
    windows, n = 40, 40 * lexical_search.WINDOW
    lists = []
    for weight in (3, 5, 8):
        docs = np.flatnonzero(rng.random(n) < 0.3)
        lists.append((Postings(docs, np.where(docs < 300, 900, rng.integers(1, 50, len(docs))), windows), weight))
    short = [(np.sort(rng.choice(n, 50, replace=False)), rng.integers(1, 40, 50)) for _ in range(4)]
    gathered = accumulated(short, windows)
    dense = np.zeros(n, np.int64)
    for p, weight in lists:
        dense[p.docs] += weight * p.impacts
    for docs, impacts in short:
        np.add.at(dense, docs, impacts)
    want = np.lexsort((np.arange(n), -dense))[:10]
    for p, _ in lists:
        # Were a later window read, its places would be out of range.
        p.docs = np.where(p.docs < 5 * lexical_search.WINDOW, p.docs, 10**9)
    docs, scores = best(lists, gathered, 10)
    assert docs.tolist() == want.tolist() and scores.tolist() == dense[want].tolist()


def test_norms_beyond_a_long():
    lengths = np.array([10**9, 7])
    assert norms(lengths, 10**12, 10**15).tolist() == [75 + 25 * 10**21 // 10**15, 75 + 25 * 7 * 10**12 // 10**15]


@pytest.mark.parametrize("k", [1, 20])
def test_given_tables(spark, k):
    docs, items = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "benchmark"))
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
    assert rows_of(search(build_index(docs), items, k), "item_id", "rank", "doc_id", "score") == sorted(want, key=repr)
