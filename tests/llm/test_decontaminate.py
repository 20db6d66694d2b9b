"""Leaks against a full edit-distance search."""

import random

import numpy as np
import pytest
from helpers import AWKWARD, docs_of, rows_of, text, with_clashes

from tallyframe.llm.decontaminate import ItemIndex, leaks, normalised, without_leaks

ITEMS = "item_id long, text string"


def best_part(item, whole):
    """Least edits that turn a part of the text into the item."""
    row = np.zeros(len(whole) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(whole, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return row.min()


def spoiled(t, edits, rng):
    chars = list(t)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = "#"
        elif kind == 1:
            del chars[i]
        else:
            chars.insert(i, "#")
    return "".join(chars)


@pytest.mark.parametrize("seed", range(4))
def test_equals_full_search(seed):
    rng = random.Random(seed)
    items = [(i, text(rng.randint(10, 25), 50 + i)) for i in range(4)]
    index = ItemIndex(items)
    for case in range(12):
        item = rng.choice(items)[1]
        edits = rng.choice([0, 1, len(item) // 12, len(item) // 10, len(item) // 10 + 1, len(item) // 8])
        whole = normalised(f"{text(rng.randint(0, 8), case)} {spoiled(item, edits, rng)} {text(rng.randint(0, 8), case + 9)}")
        want = {(i, best_part(normalised(t), whole)) for i, t in items}
        want = {(i, e) for i, e in want if e <= int(len(normalised(dict(items)[i])) * 0.1)}
        assert {(i, e) for i, _, _, e in index.leaks(whole)} == want


def test_pieces_of_a_long_text_give_the_same(monkeypatch):
    items = [(i, text(12, 80 + i)) for i in range(6)]
    whole = " ".join(f"{text(40, i)} {spoiled(items[i % 6][1], i % 4, random.Random(i))}" for i in range(12))
    index = ItemIndex(items)
    at_once = index.leaks(whole)
    for size in (100, 173, 1000):
        monkeypatch.setattr("tallyframe.llm.decontaminate.PIECE_CHARS", size)
        assert index.leaks(whole) == at_once and len(at_once) == 6


def test_region_and_case(spark):
    item = text(20, 1)
    docs = docs_of(spark, [f"Before it. {item.upper()}\n after", text(60, 2)])
    found = leaks(docs, spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["edits"]) for r in found] == [(0, 7, 11, 0)]
    assert found[0]["end"] - found[0]["start"] == len(item)


def test_blocks_give_the_same(spark):
    items = spark.createDataFrame([(i, text(20, i)) for i in range(6)], ITEMS)
    docs = docs_of(spark, [f"{text(9, 70 + i)} {text(20, i)}" for i in range(6)])
    assert rows_of(leaks(docs, items, block_chars=10), "doc_id", "item_id") == [(i, i) for i in range(6)] == rows_of(leaks(docs, items), "doc_id", "item_id")


def test_awkward_cases(spark):
    item = text(20, 1)
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, text(20, 5)), (4, "short")], ITEMS)
    extra = [(50, item, "", "", 0), (50, item, "", "", 0), (None, item, "", "", 0)]
    docs = with_clashes(docs_of(spark, AWKWARD, extra), "item_id", "start", "edits")
    assert rows_of(leaks(docs, items), "doc_id", "item_id") == sorted([(50, 1), (50, 1), (None, 1)], key=repr)
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == [(i,) for i in range(len(AWKWARD))]
    nothing = spark.createDataFrame([], ITEMS)
    assert leaks(docs, nothing).count() == 0 and without_leaks(docs, nothing).count() == docs.count()
    assert leaks(docs_of(spark, []), items).count() == 0


def test_short_items_are_searched_as_they_are(spark, monkeypatch):
    items = ["What is 2+2?", "Who wrote it", "a", "x" * 39, "北京在哪里", "hat", "one two three four five six seven"]
    texts = [
        '"WHAT is\n2+2?" he said',
        "who wrote item 4? who wrote it?",
        "that is a hat",
        "y" + "x" * 39,
        "请问北京在哪里呢",
        "one two three four five six  seven",
        "one two three four five six seventy, somewhat",
    ]
    want = [(0, 0), (1, 1), (2, 2), (2, 5), (4, 4), (5, 6)]
    benchmark = spark.createDataFrame(list(enumerate([*items, text(20, 1)])), ITEMS)
    found = leaks(docs_of(spark, texts), benchmark)
    assert rows_of(found, "doc_id", "item_id") == want
    for r in found.collect():
        assert normalised(texts[r["doc_id"]])[r["start"] : r["end"]] == normalised(items[r["item_id"]]) and r["edits"] == 0
    assert rows_of(without_leaks(docs_of(spark, texts), benchmark), "doc_id") == [(3,), (6,)]
    index = ItemIndex(list(enumerate(items)))
    whole = " ".join(texts)
    at_once = index.leaks(whole)
    for size in (1, 7, 50):
        monkeypatch.setattr("tallyframe.llm.decontaminate.PIECE_CHARS", size)
        assert index.leaks(whole) == at_once
