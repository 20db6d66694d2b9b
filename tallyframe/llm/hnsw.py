"""Approximate nearest neighbours by cosine: one navigable small-world graph per shard.

Equal vectors are indexed once, with as many of their smallest ids as a result can hold. Distinct vectors
are dealt to shards of about ``shard_rows`` by their hash; each shard's graph is built in a task of its own and
written as a row of flat neighbour arrays. A query visits the graph of every shard, and the best of all
shards are merged. Queries are a table too: packed in blocks of bounded size, which are joined to the shards one after the
other. Scores are computed from the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import written

SHARD_ROWS = 4096
DEGREE = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
# Distinct query vectors that are sent to the shards at a time.
QUERY_BLOCK = 8192


class Graph:
    """Hierarchical graph over unit vectors: ``levels[l]`` has the nodes' neighbours as rows, padded with -1."""

    def __init__(self, vectors: np.ndarray, levels: list[list[list[int]]], entry: int):
        self.vectors, self.levels, self.entry = vectors, levels, entry

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH) -> Graph:
        n = len(vectors)
        heights = np.floor(-np.log(1 - np.random.default_rng(11).random(n)) / math.log(degree)).astype(int)
        graph = cls(vectors, [], 0)
        for node in range(n):
            height, start = int(heights[node]), graph.entry
            top = len(graph.levels) - 1
            while len(graph.levels) <= height:
                graph.levels.append([[] for _ in range(n)])
            if node == 0:
                continue
            q = vectors[node]
            for level in range(top, height, -1):
                start = graph._walk(q, [start], 1, level)[0][1]
            starts = [start]
            for level in range(min(top, height), -1, -1):
                found = graph._walk(q, starts, width, level)
                starts = [x for _, x in found]
                graph._link(node, starts, level, degree)
            if height > top:
                graph.entry = node
        return graph

    def _link(self, node: int, near: list[int], level: int, degree: int) -> None:
        links, room = self.levels[level], degree * 2 if level == 0 else degree
        links[node] = self._spread(node, near, degree)
        for other in links[node]:
            links[other].append(node)
            if len(links[other]) > room:
                links[other] = self._spread(other, links[other], room)

    def _spread(self, node: int, near: list[int], most: int) -> list[int]:
        """Nearest first, leaving out what is nearer to a chosen one than to the node; then the rest, up to ``most``."""
        v = self.vectors[near]
        to_node = v @ self.vectors[node]
        order = np.argsort(-to_node, kind="stable").tolist()
        among = v @ v.T
        chosen: list[int] = []
        for i in order:
            if len(chosen) == most:
                break
            if not chosen or among[i, chosen].max() < to_node[i]:
                chosen.append(i)
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [i for i in order if i not in taken][: most - len(chosen)]
        return [near[i] for i in chosen]

    def _walk(self, q: np.ndarray, starts: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """(similarity, node) of the best found, nearest first."""
        vectors, links, seen = self.vectors, self.levels[level], bytearray(len(self.vectors))
        best: list[tuple[float, int]] = []
        todo: list[tuple[float, int]] = []
        for x, s in zip(starts, (vectors[starts] @ q).tolist()):
            seen[x] = 1
            heappush(todo, (-s, x))
            heappush(best, (s, x))
        while len(best) > width:
            heappop(best)
        while todo:
            s, x = heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            fresh = [y for y in links[x] if y >= 0 and not seen[y]]
            if not fresh:
                continue
            for y, t in zip(fresh, (vectors[fresh] @ q).tolist()):
                seen[y] = 1
                if len(best) < width:
                    heappush(best, (t, y))
                    heappush(todo, (-t, y))
                elif t > best[0][0]:
                    heapreplace(best, (t, y))
                    heappush(todo, (-t, y))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, width: int = SEARCH_WIDTH) -> list[int]:
        start = self.entry
        for level in range(len(self.levels) - 1, 0, -1):
            start = self._walk(q, [start], 1, level)[0][1]
        return [x for _, x in self._walk(q, [start], width, 0)]

    def flat(self) -> list[bytes]:
        """Each level as an array of nodes x room, without the nodes that are not on it."""
        out = []
        for links in self.levels:
            room = max([1, *map(len, links)])
            used = [i for i, row in enumerate(links) if row] if out else range(len(links))
            rows = np.full((len(used), room + 1), -1, np.int32)
            for place, i in enumerate(used):
                rows[place, 0] = i
                rows[place, 1 : 1 + len(links[i])] = links[i]
            out.append(np.int32(room + 1).tobytes() + rows.tobytes())
        return out

    @classmethod
    def load(cls, vectors: np.ndarray, flat: list[bytes], entry: int) -> Graph:
        levels = []
        for data in flat:
            values = np.frombuffer(data, np.int32)
            rows = values[1:].reshape(-1, values[0])
            links: list[list[int]] = [[] for _ in range(len(vectors))]
            for row in rows.tolist():
                links[row[0]] = row[1:]
            levels.append(links)
        return cls(vectors, levels, entry)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest entry near 1, so that squares neither overflow nor vanish; cosines stay the same."""
    most = np.abs(vectors).max(-1, keepdims=True)
    return np.ldexp(vectors, -np.frexp(most)[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return (vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))).astype(np.float32)


def cosines(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of q and each row, in double precision; equal rows get equal values."""
    q, vectors = scaled(q), scaled(vectors)
    return (vectors * q).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2): rows that have an id and a non-zero vector of finite numbers, each once.

    ``v`` is the vector in double precision, h1 and h2 are its hashes.
    """
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), "v").alias("h2")).dropDuplicates(["vec_id", "h1", "h2"])


@dataclass(frozen=True)
class Index:
    """Written shards and their number."""

    shards: DataFrame
    count: int


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> Index:
    """Graphs of all usable vectors of a table (vec_id, embedding), for up to k results a query.

    Vectors of several lengths, however long, have graphs of their own within a shard. Copies of a vector and rows that
    repeat one are indexed once, with their smallest ids. Rows without an id and vectors that are null, zero or hold
    null or non-finite entries are left out, other columns are not read; an empty table has an empty index.
    """
    smallest = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    kept = usable(vectors).withColumn("r", smallest).where(F.col("r") <= k + 1)
    grouped = written(
        kept.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct_vectors"
    )
    shards = max(1, math.ceil(grouped.count() / shard_rows))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if any(map(len, held)):
            for _, rows in pd.concat(held).groupby("shard"):
                yield graphs_of(rows)

    def graphs_of(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in rows.groupby(rows["v"].map(len)):
            same = same.sort_values(["h1", "h2"])
            v = np.stack(same["v"].to_numpy())
            graph = Graph.build(unit(v))
            out.append((v.shape[1], graph.entry, v.tobytes(), graph.flat(), same["ids"].tolist()))
        return pd.DataFrame(out, columns=["dims", "entry", "vectors", "levels", "ids"])

    # A partition by its number has one shard; by a hash some would have several and some none.
    shard = F.pmod("h1", F.lit(shards)).cast("int")
    dealt = grouped.withColumn("shard", shard).repartitionById(shards, F.col("shard"))
    graphs = dealt.mapInPandas(build, "dims int, entry int, vectors binary, levels array<binary>, ids array<array<long>>")
    return Index(written(graphs, "hnsw_shards"), shards)


def search(index: Index, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, without rows of the query's own id.

    ``queries`` is a table (vec_id, embedding); an id with several vectors is asked with the one of the
    smallest hash. Queries go to the shards in blocks of ``block`` distinct vectors. Nearest first, ties
    to the smaller id; fewer than k rows where there are fewer candidates; none for unusable vectors.
    """
    asked = usable(queries)
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("h1", "h2"))
    asked = asked.withColumn("r", first).where("r = 1").drop("r")
    distinct = written(asked.groupBy("h1", "h2").agg(F.first("v").alias("v")), "query_vectors")
    blocks = max(1, math.ceil(distinct.count() / block))
    packed = written(_packed(distinct.withColumn("block", F.pmod("h2", F.lit(blocks)).cast("int")), blocks), "query_blocks")
    found = None
    for b in range(blocks):
        part = written(_search_block(index, packed.where(F.col("block") == b), k, width), "nearest_of_block")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(merged, ["h1", "h2"]).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(queries: DataFrame, blocks: int) -> DataFrame:
    """(block, dims, hashes, asked): the queries of a block that have the same length, as arrays in one row."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if any(map(len, held)):
            rows = pd.concat(held).sort_values(["h1", "h2"])
            out = [
                (block, dims, same[["h1", "h2"]].to_numpy(np.int64).tobytes(), np.stack(same["v"].to_numpy()).tobytes())
                for (block, dims), same in rows.groupby([rows["block"], rows["v"].map(len)])
            ]
            yield pd.DataFrame(out, columns=["block", "dims", "hashes", "asked"])

    return queries.repartitionById(blocks, F.col("block")).mapInPandas(pack, "block int, dims int, hashes binary, asked binary")


def _search_block(index: Index, queries: DataFrame, k: int, width: int) -> DataFrame:
    """The nearest in each shard of one block's queries; the block's few rows go to the shards with vectors of their length."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.itertuples(index=False):
                hashes = np.frombuffer(shard.hashes, np.int64).reshape(-1, 2).tolist()
                asked = np.frombuffer(shard.asked).reshape(len(hashes), -1)
                v = np.frombuffer(shard.vectors).reshape(-1, shard.dims)
                graph = Graph.load(unit(v), list(shard.levels), shard.entry)
                out = []
                for (h1, h2), q, u in zip(hashes, asked, unit(asked)):
                    near = graph.search(u, max(width, k + 1))
                    scores = cosines(q, v[near])
                    hits = [(s, i) for s, x in zip(scores.tolist(), near) for i in shard.ids[x]]
                    out += [(h1, h2, i, s) for s, i in sorted(hits, key=lambda hit: (-hit[0], hit[1]))[: k + 1]]
                yield pd.DataFrame(out, columns=["h1", "h2", "vec_id", "score"])

    cells = index.shards.repartition(index.count).join(F.broadcast(queries), "dims")
    return cells.mapInPandas(visit, "h1 long, h2 long, vec_id long, score double")
