"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts are compared in small letters with every run of blanks as one. An item of m characters leaks into a
text if some part of the text is at most ``k = floor(m * error_rate)`` insertions, deletions or
replacements away. By the q-gram lemma that part shares at least ``m + 1 - q * (k + 1)`` q-grams with the
item, on diagonals at most k apart. So shared q-grams are counted in overlapping bands of diagonals, and
only regions that reach the bound are aligned, within their band. To spare most texts the count, it starts with
q-grams of the item that do not overlap: k edits spoil at most k of them, so enough others must lie on
near diagonals.

Items under ``MIN_CHARS`` characters are too short for edits: they leak where the text has them as they are,
between word boundaries. Their first and last q-grams, which cover them, are looked up together.

Items go to the tasks in blocks of bounded size; texts are read where they are and never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shingles import powers

ERROR_RATE = 0.1
# Items with fewer characters are too short to tell a leak with edits from chance.
MIN_CHARS = 40
# Characters of items that are sent to the tasks at a time.
BLOCK_CHARS = 4_000_000
# Characters of a text that are searched at a time.
PIECE_CHARS = 1 << 19
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
# Thai, Lao, Myanmar, Khmer, kana, ideographs: scripts that put no blanks between words.
_UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def qgrams(chars: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on, from sums of powers over the whole text."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers(len(chars))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((chars + _FACTOR) * power[: len(chars)], dtype=np.uint64)))
    return (sums[q:] - sums[:-q]) * inverse[:n] * _FACTOR


def word_turns() -> np.ndarray:
    """Code points at which parts of words begin and end in turn: letters, marks, digits and underscores, but for scripts without blanks."""
    table = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)])
    table[ord("_")] = True
    for first, last in _UNSPACED:
        table[first : last + 1] = False
    return np.flatnonzero(np.diff(table, prepend=False)).astype(np.uint32)


class ShortItems:
    """Items that are searched as they are, by length; q is the largest power of two within the length."""

    def __init__(self, texts: list[np.ndarray]):
        of_length: dict[int, list[int]] = defaultdict(list)
        for o, chars in enumerate(texts):
            of_length[len(chars)].append(o)
        self.texts = texts
        # Made where the index is made and sent with it: a few thousand numbers.
        self.turns = word_turns() if texts else np.empty(0, np.uint32)
        self.known: dict[int, np.ndarray] = {}  # by q, slots of the first q-grams
        self.lengths: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = defaultdict(list)
        for m, owners in sorted(of_length.items()):
            q = 1 << (m.bit_length() - 1)
            grams = np.array([qgrams(texts[o], q)[[0, m - q]] for o in owners])
            self.known.setdefault(q, np.zeros(1 << _TABLE_BITS, bool))[_slot(grams[:, 0])] = True
            both = _both(grams[:, 0], grams[:, 1])
            order = np.argsort(both, kind="stable")
            self.lengths[q].append((m, both[order], np.array(owners)[order]))

    def first_places(self, chars: np.ndarray, begin: int, end: int) -> dict[int, int]:
        """First place of each item in chars[begin:end], by the item's place; boundaries are those of all ``chars``."""
        found: dict[int, int] = {}
        for q, lengths in self.lengths.items():
            grams = qgrams(chars[begin:end], q)
            at = np.flatnonzero(self.known[q][_slot(grams)])
            at = at[self._boundary(chars, begin + at)]
            for m, both, owners in lengths:
                start = at[at + m <= end - begin]
                start = start[self._boundary(chars, begin + start + m)]
                key = _both(grams[start], grams[start + m - q])
                first = np.searchsorted(both, key, "left")
                which, entry = _expanded(first, np.searchsorted(both, key, "right") - first)
                owner, place = owners[entry], begin + start[which]
                for o, i in zip(owner.tolist(), place.tolist()):
                    if o not in found and np.array_equal(chars[i : i + m], self.texts[o]):
                        found[o] = i
        return found

    def _in_word(self, chars: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.turns, chars, "right") % 2 == 1

    def _boundary(self, chars: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether no word goes on from before each place to it."""
        inner = (places > 0) & (places < len(chars))
        at = np.where(inner, places, 0)
        return ~(inner & self._in_word(chars[at - 1]) & self._in_word(chars[at]))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _both(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first ^ (first >> np.uint64(29))) * _FACTOR + last


@dataclass
class Item:
    item_id: int
    chars: np.ndarray
    edits: int
    least: int  # shared q-grams that a leak has at least
    least_side_by_side: int  # the same of q-grams that do not overlap
    hashes: np.ndarray  # q-grams in order of their hash, and their places
    places: np.ndarray


class ItemIndex:
    """Items by their q-grams; q is the longest for which the lemma asks for several shared q-grams of every item."""

    def __init__(self, rows: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
        texts = [(i, codes(normalised(t))) for i, t in rows]
        short = [(i, c) for i, c in texts if 0 < len(c) < min_chars]
        self.short_ids, self.short = [i for i, _ in short], ShortItems([c for _, c in short])
        texts = [(i, c, int(len(c) * error_rate)) for i, c in texts if len(c) >= min_chars]
        self.q = q = max(3, min([12, *((len(c) + 1 - 4) // (k + 1) for _, c, k in texts)]))
        self.items, sides = [], []
        for item_id, chars, k in texts:
            grams = qgrams(chars, q)
            order = np.argsort(grams, kind="stable")
            side_by_side = grams[::q]
            self.items.append(Item(item_id, chars, k, max(1, len(grams) - q * k), max(1, len(side_by_side) - k), grams[order], order))
            sides.append(side_by_side)
        hashes = np.concatenate(sides) if sides else np.empty(0, np.uint64)
        owners = np.repeat(np.arange(len(sides)), [len(g) for g in sides])
        offsets = np.concatenate([q * np.arange(len(g)) for g in sides]) if sides else owners
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.offsets = hashes[order], owners[order], offsets[order]
        self.edits = np.array([item.edits for item in self.items], np.int64)
        self.needed = np.array([item.least_side_by_side for item in self.items], np.int64)
        self.known = np.zeros(1 << _TABLE_BITS, bool)
        self.known[_slot(hashes)] = True

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of the best region of each item in the normalised text.

        Long texts are searched in pieces that overlap by more than a leak's length.
        """
        chars = codes(normalised(text))
        overlap = max([0, *(len(item.chars) + item.edits for item in self.items), *map(len, self.short.texts)])
        if not overlap:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        short: dict[int, int] = {}
        for begin in range(0, max(1, len(chars) - overlap), PIECE_CHARS):
            end_of_piece = min(len(chars), begin + PIECE_CHARS + overlap)
            for o, (start, end, edits) in self._search(chars[begin:end_of_piece]).items():
                if o not in best or edits < best[o][2]:
                    best[o] = (begin + start, begin + end, edits)
            short = self.short.first_places(chars, begin, end_of_piece) | short
        found = [(self.items[o].item_id, *best[o]) for o in sorted(best)]
        return found + [(self.short_ids[o], i, i + len(self.short.texts[o]), 0) for o, i in sorted(short.items())]

    def _search(self, chars: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """(start, end, edits) of the best region of each item, by the item's place."""
        grams = qgrams(chars, self.q)
        best: dict[int, tuple[int, int, int]] = {}
        if not len(grams):
            return best
        for o, low, high in self._regions(grams):
            item = self.items[o]
            if o in best and best[o][2] == 0:
                continue
            start = max(0, low)
            part = grams[start : max(start, high + len(item.chars))]
            first = np.searchsorted(item.hashes, part, "left")
            at, entry = _expanded(first, np.searchsorted(item.hashes, part, "right") - first)
            diagonals = start + at - item.places[entry]
            inside = np.flatnonzero((diagonals >= low) & (diagonals <= high))
            inside = inside[np.argsort(diagonals[inside], kind="stable")]
            hit = self._best(chars, item, diagonals[inside], item.places[entry[inside]])
            if hit and (o not in best or hit[2] < best[o][2]):
                best[o] = hit
        return best

    def _regions(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) where enough q-grams that do not overlap lie near each other."""
        at = np.flatnonzero(self.known[_slot(grams)])
        first = np.searchsorted(self.hashes, grams[at], "left")
        which, entry = _expanded(first, np.searchsorted(self.hashes, grams[at], "right") - first)
        owner, diagonal = self.owners[entry], at[which] - self.offsets[entry]
        order = np.lexsort((diagonal, owner))
        owner, diagonal = owner[order], diagonal[order]
        last = np.arange(len(owner)) + self.needed[owner] - 1
        begin = np.flatnonzero(last < len(owner))
        end = last[begin]
        near = (owner[end] == owner[begin]) & (diagonal[end] - diagonal[begin] <= self.edits[owner[begin]])
        regions: list[tuple[int, int, int]] = []
        for b, e in zip(begin[near].tolist(), end[near].tolist()):
            o = int(owner[b])
            low, high = int(diagonal[b] - self.edits[o]), int(diagonal[e] + self.edits[o])
            if regions and regions[-1][0] == o and low <= regions[-1][2]:
                regions[-1] = (o, regions[-1][1], high)
            else:
                regions.append((o, low, high))
        return regions

    def _best(self, chars: np.ndarray, item: Item, diagonals: np.ndarray, places: np.ndarray) -> tuple[int, int, int] | None:
        """(start, end, edits). Bands of 2k + 1 diagonals that overlap by half hold every leak's q-grams, which spread over k + 1 at most.

        A q-gram of the item counts once in a band, however often the text has it there.
        """
        if not len(diagonals):
            return None
        values, counts = np.unique(diagonals, return_counts=True)
        top = int(values[counts.argmax()])
        if top >= 0 and np.array_equal(chars[top : top + len(item.chars)], item.chars):
            return top, top + len(item.chars), 0
        width, step, best = 2 * item.edits + 1, item.edits + 1, None
        starts = np.unique(np.concatenate((diagonals // step, diagonals // step - 1))) * step
        first, last = np.searchsorted(diagonals, starts, "left"), np.searchsorted(diagonals, starts + width, "left")
        for start, a, b in zip(starts.tolist(), first.tolist(), last.tolist()):
            if b - a < item.least or len(np.unique(places[a:b])) < item.least:
                continue
            hit = banded_alignment(chars, item.chars, start, start + width - 1, item.edits)
            if hit and (best is None or hit[2] < best[2]):
                best = hit
        return best


def _expanded(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each range of ``many`` entries from ``first`` on, and the entries, one after the other."""
    at = np.flatnonzero(many)
    first, many = first[at], many[at]
    entry = np.repeat(first - np.concatenate(([0], np.cumsum(many)))[:-1], many) + np.arange(many.sum())
    return np.repeat(at, many), entry


def banded_alignment(text: np.ndarray, item: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best part of the text for the whole item on diagonals low to high.

    A cell's diagonal is its place in the text minus its place in the item. None where more than
    ``edits`` are needed. Among equals the first end wins.
    """
    low, high = low - edits, high + edits
    width, far = high - low + 1, edits + 1
    offsets = np.arange(width)
    # After i characters of the item, cell d is the text up to place i + low + d.
    cost = np.where((offsets + low >= 0) & (offsets + low <= len(text)), 0, far)
    begin = offsets + low
    for i, c in enumerate(item.tolist(), 1):
        place = offsets + low + i
        inside = (place >= 1) & (place <= len(text))
        same = np.zeros(width, bool)
        same[inside] = text[place[inside] - 1] == c
        replace = cost + ~same
        replace[~inside] = far
        leave = np.append(cost[1:], far) + 1  # a character of the item that the text lacks
        leave[(place < 0) | (place > len(text))] = far
        from_above = leave < replace
        step = np.where(from_above, leave, replace)
        started = np.where(from_above, np.append(begin[1:], 0), begin)
        # Characters that only the text has: along a row each costs one.
        reach = np.minimum.accumulate(step - offsets)
        source = np.maximum.accumulate(np.where(step - offsets == reach, offsets, 0))
        cost = np.minimum(reach + offsets, far)
        begin = started[source]
        if cost.min() > edits:
            return None
    at = int(cost.argmin())
    return int(begin[at]), at + low + len(item), int(cost[at])


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct rows in blocks of bounded size; a longer item is a block of its own."""
    block, size = [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def leaks(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): items that leak into a document, with their best region.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; start and end count characters of
    the normalised text. Null and empty texts hold no leak; items without an id or without characters
    are not searched, those under ``min_chars`` characters only as they are, between word boundaries. Repeated rows give repeated results; of an item id with several
    texts each is searched. Without items the result is empty.
    """
    schema = "doc_id long, item_id long, start int, end int, edits int"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    found = None
    for block in _blocks(benchmark, block_chars):
        part = texts.mapInArrow(_search(ItemIndex(block, error_rate, min_chars)), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _search(index: ItemIndex):
    names = ["doc_id", "item_id", "start", "end", "edits"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(i.as_py(), *hit) for i, text in zip(batch.column("doc_id"), batch.column("text")) for hit in index.leaks(text.as_py())]
            columns = [pa.array([hit[k] for hit in hits], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return search


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents into which no item leaks; takes and keeps the same rows and columns otherwise.

    Decided from each row's own text, so nothing is joined and rows without an id are decided as well.
    """
    for block in _blocks(benchmark, BLOCK_CHARS):
        docs = docs.where(_is_clean(ItemIndex(block, error_rate, min_chars))("text"))
    return docs


def _is_clean(index: ItemIndex):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not index.leaks(t.as_py()) for t in texts], pa.bool_())

    return clean
