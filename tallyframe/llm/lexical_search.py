"""Ranked lexical search over an inverted index in shards, term at a time and then document at a time.

The index has shards of bounded size, each with the documents that one task has read in a row. A shard holds,
for each of its terms, the places of the documents that have it and how often. A query reads its terms'
lists of each shard: the short lists are summed term at a time into accumulators, and these, sorted by place, then stand beside
the long lists as one more list with bounds. Documents are taken in order from all of them, window by window; a window is
skipped where the bounds of its lists together cannot reach the scores already found.

Scores are whole numbers, so they do not depend on shards or on the order of sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.joins import keyed_join
from tallyframe.session import written

TOP = 20
# A shard ends at so many documents, or at the document that brings it to so many postings.
SHARD_DOCS = 16_384
SHARD_POSTINGS = 4_000_000
# Terms of queries that are searched at a time.
BLOCK_TERMS = 200_000
# Documents of a window, and the part of a shard's documents up to which a list is short.
WINDOW = 256
SHORT_PART = 64
_CHUNK = 1 << 20

# Letters and digits stay, A-Z as a-z; all bytes from 0x80 on are parts of letters beyond ASCII.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def count_terms(raw: bytes | None) -> Counter:
    """How often each term occurs in a text; long texts are read in pieces that end between terms."""
    counts: Counter = Counter()
    raw, begin = raw or b"", 0
    while begin < len(raw):
        end = min(len(raw), begin + _CHUNK)
        while end < len(raw) and _TERM_BYTES[raw[end]] != 0x20:
            end += 1
        counts.update(raw[begin:end].translate(_TERM_BYTES).split())
        begin = end
    return counts


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    most = int(numbers.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return numbers.astype(kind).tobytes()


def _unpacked(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // count}").astype(np.int64)


_INDEX = "shard long, term binary, df int, docs binary, tfs binary, ids array<long>, lengths array<long>"


class _ShardBuilder:
    """Postings of documents in the order read, by numbers of terms."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.terms: list[int] = []
        self.tfs: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.postings = 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        numbers = self.numbers
        self.terms.append(np.array([numbers.setdefault(t, len(numbers)) for t in counts], np.int32))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.sizes.append(len(counts))
        self.ids.append(doc_id)
        self.lengths.append(int(self.tfs[-1].sum()))
        self.postings += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's documents by id, then the lists of its terms."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, lengths = [self.ids[i] for i in order], [self.lengths[i] for i in order]
        yield _index_batch([shard], [None], [None], [None], [None], [ids], [lengths])
        terms, tfs, docs = np.concatenate(self.terms), np.concatenate(self.tfs), np.repeat(place, self.sizes)
        by_term = np.lexsort((docs, terms))
        terms, tfs, docs = terms[by_term], tfs[by_term], docs[by_term]
        bounds = np.searchsorted(terms, np.arange(len(self.numbers) + 1))
        names = list(self.numbers)
        for first in range(0, len(names), 20_000):
            some = range(first, min(first + 20_000, len(names)))
            cuts = [slice(bounds[i], bounds[i + 1]) for i in some]
            none = [None] * len(some)
            gaps = [_packed(np.diff(docs[c], prepend=0)) for c in cuts]
            yield _index_batch([shard] * len(some), [names[i] for i in some], [c.stop - c.start for c in cuts], gaps, [_packed(tfs[c]) for c in cuts], none, none)


def _index_batch(*columns: list) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), longs, longs]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _INDEX.split(", ")])


@dataclass(frozen=True)
class Index:
    """The written lists, the number of documents with a term, and the number of all their terms."""

    lists: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame) -> Index:
    """Index of all rows of docs (doc_id, text). Texts are read where they lie and are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId(), 0, _ShardBuilder()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = count_terms(raw.as_py())
                if counts:
                    shard.add(doc_id, counts)
                if shard.full():
                    yield from shard.batches((part << 32) + made)
                    made, shard = made + 1, _ShardBuilder()
        if shard.ids:
            yield from shard.batches((part << 32) + made)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    lists = written(texts.mapInArrow(run, _INDEX), "lexical_index")
    heads = lists.where("term IS NULL").select(F.size("lengths").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"))
    n_docs, n_terms = heads.agg(F.sum("n"), F.sum("terms")).first()
    return Index(lists, n_docs or 0, n_terms or 0)


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``75 + 25 * n * N div L`` of each document, exact for any size."""
    if 25 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        return 75 + 25 * lengths * n_docs // n_terms
    return np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


class Postings:
    """A list of places with impacts, its windows' bounds, and where each window begins in it."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, windows: int):
        self.docs, self.impacts = docs, impacts
        self.starts = np.searchsorted(docs, np.arange(windows + 1) * WINDOW)
        self.most = np.zeros(windows, np.int64)
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            self.most[filled] = np.maximum.reduceat(impacts, self.starts[filled])


def accumulated(short: list[tuple[np.ndarray, np.ndarray]], windows: int) -> Postings | None:
    """Term at a time: the short lists (docs, impacts) as one list of summed impacts."""
    if not short:
        return None
    docs = np.concatenate([d for d, _ in short])
    impacts = np.concatenate([i for _, i in short])
    order = np.argsort(docs, kind="stable")
    docs, impacts = docs[order], impacts[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return Postings(docs[first], np.add.reduceat(impacts, first), windows)


def best(lists: list[tuple[Postings, int]], gathered: Postings | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k highest scores above 0, equal ones by place, and how they were found:

    document at a time over the long lists, with their weights, and the accumulators. Windows are taken in
    order while their bounds can still change the result.
    """
    if gathered is not None:
        lists = [*lists, (gathered, 1)]
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    if not lists:
        return docs, scores
    bounds = sum(weight * p.most for p, weight in lists)
    # Sums alone are reached by some document, maybe a later one, so an equal bound may still matter.
    floor = 1
    if gathered is not None and len(gathered.docs) >= k:
        floor = max(1, int(np.partition(gathered.impacts, -k)[-k]))
    for w in np.flatnonzero(bounds >= floor).tolist():
        # Documents found are before this window, so an equal score no longer counts.
        if len(scores) == k and bounds[w] <= scores[-1]:
            continue
        found = np.zeros(WINDOW, np.int64)
        for p, weight in lists:
            begin, end = p.starts[w], p.starts[w + 1]
            if begin < end:
                found[p.docs[begin:end] - w * WINDOW] += weight * p.impacts[begin:end]
        least = scores[-1] + 1 if len(scores) == k else 1
        new = np.flatnonzero(found >= max(floor, least))
        if len(new):
            docs, scores = np.concatenate((docs, new + w * WINDOW)), np.concatenate((scores, found[new]))
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
    return docs, scores


def search_shard(rows: pd.DataFrame, n_docs: int, n_terms: int, k: int) -> pd.DataFrame:
    """The best documents of one shard for each item; rows are the shard's lists with the items that use them."""
    head = rows[rows["ids"].notna()].iloc[0]
    ids, m = np.array(head["ids"], object), norms(np.array(head["lengths"], np.int64), n_docs, n_terms)
    windows = -(-len(ids) // WINDOW)
    long, short = {}, {}
    lists: list[Postings | tuple[np.ndarray, np.ndarray]] = []
    rows = rows[rows["ids"].isna()]
    for df, gaps, tfs, items, weights in zip(rows["df"], rows["docs"], rows["tfs"], rows["items"], rows["weights"]):
        docs, tf = np.cumsum(_unpacked(gaps, int(df))), _unpacked(tfs, int(df))
        impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[docs])
        is_short = df * SHORT_PART <= len(ids)
        lists.append((docs, impacts) if is_short else Postings(docs, impacts, windows))
        for item, weight in zip(items.tolist(), weights.tolist()):
            (short if is_short else long).setdefault(item, []).append((len(lists) - 1, weight))
    out = []
    for item in long.keys() | short.keys():
        gathered = accumulated([(lists[i][0], weight * lists[i][1]) for i, weight in short.get(item, ())], windows)
        docs, scores = best([(lists[i], weight) for i, weight in long.get(item, ())], gathered, k)
        out += zip([item] * len(docs), ids[docs], scores.tolist())
    return pd.DataFrame(out, columns=["item", "doc_id", "score"]).astype({"item": "int64", "doc_id": "Int64", "score": "int64"})


def _query_terms(queries: DataFrame) -> DataFrame:
    """(item, term, c) of the distinct rows (item_id, text); ``item`` is a hash of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = count_terms(raw.as_py())
                columns = [pa.array([item] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "term", "c"])

    texts = queries.select("item", F.col("text").cast("binary").alias("raw")).where("raw IS NOT NULL")
    return written(texts.mapInArrow(run, "item long, term binary, c long"), "query_terms")


def search(index: Index, queries: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each row of queries (item_id, text).

    Equal scores go by ascending doc_id, rows without an id last; repeated documents each take a rank. Rows that agree in
    item_id and text are one item, rows that share an id only are items of their own. Null texts and texts without a
    term, on either side, take no part; empty tables give an empty result. Other columns are not read.

    Items are searched in blocks of about ``block_terms`` terms, each against all shards.
    """
    spark = queries.sparkSession
    items = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    terms = _query_terms(items)
    blocks = -(-terms.count() // block_terms)
    lists = index.lists.where("term IS NOT NULL")
    heads = index.lists.where("term IS NULL").select("shard", "ids", "lengths")
    n_docs, n_terms = index.n_docs, index.n_terms
    parts = []
    for b in range(blocks if n_docs else 0):
        mine = terms.where(F.pmod("item", F.lit(blocks)) == b) if blocks > 1 else terms
        asked = keyed_join(lists.select("term", "df"), mine.select("term").distinct(), "term")
        df = asked.groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
        weighted = mine.join(df, "term").select("term", "item", (F.col("c") * weight).alias("weight")).where("weight > 0")
        pairs = weighted.groupBy("term").agg(F.collect_list(F.struct("item", "weight")).alias("uses"))
        uses = written(pairs.select("term", F.col("uses.item").alias("items"), F.col("uses.weight").alias("weights")), "query_weights")
        used = keyed_join(lists.drop("ids", "lengths"), uses, "term").drop("term")
        rows = used.unionByName(heads, allowMissingColumns=True)
        found = rows.groupBy("shard").applyInPandas(
            lambda shard: search_shard(shard, n_docs, n_terms, k), "item long, doc_id long, score long"
        )
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        parts.append(written(ranked, "search_results"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
