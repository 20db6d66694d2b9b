"""Near-duplicate documents by an exact Jaccard join of word shingles with prefix filtering.

Two texts link if ``100 * shared >= 80 * united`` holds for their sets of five-word shingles. Shingles
have one global order, rare ones first; two linked sets share a shingle within the first fifth of
either. So each set emits that prefix, prefixes are joined on their shingles, and a candidate pair
must pass a length filter, a positional filter (what can still follow the shared shingle) and a suffix
filter (how the shingles spread over 64 parts of the hash space) before its sets are compared.

Equal sets count once. As only components are asked for, pairs already connected are not compared: first
each set meets the set that leads most of its prefix shingles, then the rest of each shingle's
sets is compared between components - as pairs where few share the shingle, else in tasks of bounded
blocks that give back links only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.components import components
from tallyframe.llm.shingles import mixed, set_hash, shingle_set
from tallyframe.operators.joins import keyed_join
from tallyframe.session import written

PERCENT = 80
# Counters of shingle frequency; their number bounds what is broadcast. Shingles that share a counter
# only get a later place in the order, which stays the same for all sets.
COUNTERS = 1 << 18
_ROW = 4096
# Bits of the filter that tells most sets without any shared prefix shingle, in words of 64.
FILTER_WORDS = 1 << 18
# Sets to fetch are told from most others by so many values of their hash.
SET_BUCKETS = 1 << 18
PAIRS_UP_TO = 32
# Shingles whose counter is above this are too common for one task: their sets are counted in parts instead of side by side.
HOT_SETS = 500_000
# Sets of a block, and shingles of its sets together.
BLOCK = 2048
BLOCK_SHINGLES = 4_000_000
_PARTS = 64
_TASK_MEMORY = 200_000


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles) >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def ordered_prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order: by counter, then by hash."""
    order = np.lexsort((shingles, counts[_counter(shingles)]))
    return shingles[order[: prefix_length(len(shingles))]]


def _spread(shingles: np.ndarray) -> bytes:
    parts = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=_PARTS)
    return np.minimum(parts, 0xFFFF).astype(np.uint16).tobytes()


def _longs(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A column of whole numbers without nulls."""
    return np.asarray(rows.column(name))


def _values(batch: pa.RecordBatch, name: str) -> Iterator:
    """A column's values one after the other, so that no second copy of the whole column is held."""
    return (x.as_py() for x in batch.column(name))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: c if isinstance(c, pa.Array) else pa.array(c) for name, c in columns.items()})


def _sketch_and_ids(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row (doc_id, th, n, sig) each, and rows (part, counts) of the counters."""
    long, lists = pa.int64(), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            rows = batch.num_rows
            n, sig = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for i, raw in enumerate(_values(batch, "raw")):
                s = shingle_set(raw)
                if len(s):
                    np.add.at(counts, _counter(s), 1)
                    n[i], sig[i] = len(s), set_hash(s)
            ids, th = (batch.column(c) for c in ("doc_id", "th"))
            yield _batch(doc_id=ids, th=th, n=n, sig=sig, part=pa.nulls(rows, pa.int32()), counts=pa.nulls(rows, lists))
        used = [p for p in range(COUNTERS // _ROW) if counts[p * _ROW : (p + 1) * _ROW].any()]
        if used:
            none = pa.nulls(len(used), long)
            rows = pa.array([counts[p * _ROW : (p + 1) * _ROW] for p in used], lists)
            yield _batch(doc_id=none, th=none, n=none, sig=none, part=pa.array(used, pa.int32()), counts=rows)

    return written(docs.mapInArrow(run, "doc_id long, th long, n long, sig long, part int, counts array<long>"), "shingle_pass")


def _counts(passed: DataFrame) -> np.ndarray:
    rows = passed.where("part IS NOT NULL").select("part", F.posexplode("counts").alias("place", "c"))
    summed = rows.where("c > 0").groupBy("part", "place").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[summed["part"].to_numpy(np.int64) * _ROW + summed["place"].to_numpy(np.int64)] = summed["c"]
    return counts


def _once(seen: set[int], sig: int) -> bool:
    """False for a set that this task has had; it forgets now and then, which only costs a repeated row."""
    if sig in seen:
        return False
    if len(seen) >= _TASK_MEMORY:
        seen.clear()
    seen.add(sig)
    return True


def _postings(docs: DataFrame, counts: np.ndarray, hot_sets: int) -> DataFrame:
    """(token, sig, np, hot): the prefix of every set; np packs the set's size and the shingle's place, see ``_unpacked``.

    ``hot`` marks shingles that may stand in very many sets, by their counter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, sigs, packed, hot, rows = [], [], [], [], 0
            for raw in _values(batch, "raw"):
                s = shingle_set(raw)
                if not len(s) or not _once(seen, sig := set_hash(s)):
                    continue
                prefix = ordered_prefix(s, counts)
                hot.append(counts[_counter(prefix)] > hot_sets)
                tokens.append(prefix.view(np.int64))
                sigs.append(np.full(len(prefix), sig, np.int64))
                packed.append((len(s) << 32) + np.arange(len(prefix), dtype=np.int64))
                rows += len(prefix)
                if rows > 200_000:
                    yield _batch(token=np.concatenate(tokens), sig=np.concatenate(sigs), np=np.concatenate(packed), hot=np.concatenate(hot))
                    tokens, sigs, packed, hot, rows = [], [], [], [], 0
            if rows:
                yield _batch(token=np.concatenate(tokens), sig=np.concatenate(sigs), np=np.concatenate(packed), hot=np.concatenate(hot))

    return docs.mapInArrow(run, "token long, sig long, np long, hot boolean")


def _unpacked(packed: str, n: str, pos: str) -> list:
    return [F.shiftright(packed, 32).alias(n), F.col(packed).bitwiseAND(0xFFFFFFFF).alias(pos)]


def _shared(postings: DataFrame, any_hot: bool) -> DataFrame:
    """Postings of shingles that stand in the prefixes of several sets, each with the shingle's leader.

    The leader (lead, lead_np) is the set with the fewest rarer shingles. One shuffle serves for all of it, but for hot
    shingles: those are few, and are counted by partial sums that go back to their postings.
    """
    token = Window.partitionBy("token")
    before = F.lag("sig").over(token.orderBy("sig"))
    once = postings.where("NOT hot").withColumn("before", before).where("before IS NULL OR before != sig").drop("before", "hot")
    lead = F.min(F.struct(F.col("np").bitwiseAND(0xFFFFFFFF).alias("pos"), F.shiftright("np", 32).alias("n"), F.col("sig").alias("lead")))
    several = once.withColumns({"size": F.count("*").over(token), "l": lead.over(token), "hot": F.lit(False)}).where("size > 1")
    if any_hot:
        hot = postings.where("hot").dropDuplicates(["token", "sig"]).drop("hot")
        led = hot.groupBy("token").agg(F.count("*").alias("size"), lead.alias("l")).where("size > 1")
        several = several.unionByName(keyed_join(hot, led, "token", spread_by=["sig"]).withColumn("hot", F.lit(True)))
    return written(several.select("token", "sig", "np", "l.lead", (F.shiftleft("l.n", 32) + F.col("l.pos")).alias("lead_np"), "hot"), "shared_postings")


def _filter_bits(sig: np.ndarray) -> list[np.ndarray]:
    """Two places of a set in the filter, from its hash."""
    bits = np.uint64(64 - (FILTER_WORDS.bit_length() + 5))
    h = sig.astype(np.int64).view(np.uint64)
    return [(h >> bits).astype(np.int64), (mixed(h) >> bits).astype(np.int64)]


def _needed_sets(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(sig, n, spread, packed) of the sets in ``shared``, and of a few others that pass the filter.

    ``packed`` is the compressed text, a fraction of its hashed set's size. The filter is a bitmap
    of fixed size, so that texts need not be shuffled to find them.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_filter_bits(_longs(batch, "sig")))
            yield _batch(word=(both >> 6).astype(np.int32), bit=np.left_shift(np.int64(1), both & 63))

    marks = shared.select("sig").distinct().mapInArrow(places, "word int, bit long")
    words = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(FILTER_WORDS, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for raw in _values(batch, "raw"):
                s = shingle_set(raw)
                if not len(s):
                    continue
                sig = set_hash(s)
                marked = all(table[p[0] >> 6] >> (p[0] & 63) & 1 for p in _filter_bits(np.array([sig])))
                if marked and _once(seen, sig):
                    out.append((sig, len(s), _spread(s), zlib.compress(raw, 1)))
            if out:
                yield _batch(**dict(zip(("sig", "n", "spread", "packed"), map(list, zip(*out)))))

    found = texts.select("raw").mapInArrow(run, "sig long, n long, spread binary, packed binary")
    return written(found.dropDuplicates(["sig"]), "needed_sets")


def _set_of(packed: bytes) -> np.ndarray:
    return shingle_set(zlib.decompress(packed))


def _only(sets: DataFrame, sigs: DataFrame) -> DataFrame:
    """The sets of ``sigs`` and a few more: what is told from them by a list of bounded length is not shuffled."""
    bucket = F.pmod(F.col("sig"), F.lit(SET_BUCKETS)).alias("bucket")
    return sets.withColumn("bucket", bucket).join(F.broadcast(sigs.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")


def _links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the pairs that pass the suffix filter and whose sets are similar enough."""
    sigs = pairs.select(F.explode(F.array("u", "v")).alias("sig"))
    spreads = _only(sets.select("sig", "n", "spread"), sigs)
    a, b = (spreads.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("spread").alias(f"s{k}")) for k in "uv")

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_spreads(_values(batch, c)) for c in ("su", "sv"))
                keep = pa.array(_enough(_most_shared(x, y), _longs(batch, "nu"), _longs(batch, "nv")))
                yield batch.select(["u", "v"]).filter(keep)

    likely = written(pairs.join(a, "u").join(b, "v").mapInArrow(may_link, "u long, v long"), "likely_pairs")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(_set_of(x), _set_of(y)) for x, y in zip(_values(batch, "xu"), _values(batch, "xv"))]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    content = _only(sets.select("sig", "packed"), likely.select(F.explode(F.array("u", "v")).alias("sig")))
    full = likely.join(content.select(F.col("sig").alias("u"), F.col("packed").alias("xu")), "u")
    full = full.join(content.select(F.col("sig").alias("v"), F.col("packed").alias("xv")), "v")
    return full.mapInArrow(similar, "u long, v long")


def _spreads(rows: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, _PARTS).astype(np.int64)


def _most_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most so many shingles are shared, as no part of the hash space can share more than its smaller count.

    A counter that is full counts as unbounded.
    """
    least = np.minimum(x, y)
    return np.where((least == 0xFFFF).any(-1), np.iinfo(np.int64).max // 1000, least.sum(-1))


def _enough(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """100 * shared >= 80 * united, with united = n + m - shared."""
    return (100 + PERCENT) * shared >= PERCENT * (n + m)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return bool(_enough((a[place] == b).sum(), len(a), len(b)))


# For the smaller set n at place pos and the larger one at place p: length and positional filter.
_FILTERS = f"""{PERCENT} * greatest({{0}}.n, {{1}}.n) <= 100 * least({{0}}.n, {{1}}.n)
    AND {100 + PERCENT} * (1 + least({{0}}.pos, {{1}}.pos) + least({{0}}.n - {{0}}.pos - 1, {{1}}.n - {{1}}.pos - 1)) >= {PERCENT} * ({{0}}.n + {{1}}.n)"""


def _leader_pairs(shared: DataFrame) -> DataFrame:
    """Each set with the set that leads most of its shingles, as far as the filters let it."""
    rows = shared.where("sig != lead").select("sig", "lead", *_unpacked("np", "n", "pos"), *_unpacked("lead_np", "lead_n", "lead_pos"))
    rows = rows.select("sig", "lead", F.struct("n", "pos").alias("s"), F.struct(F.col("lead_n").alias("n"), F.col("lead_pos").alias("pos")).alias("l"))
    votes = rows.where(_FILTERS.format("s", "l")).groupBy("sig", "lead").count()
    best = votes.groupBy("sig").agg(F.max(F.struct("count", "lead")).alias("b"))
    return best.select(F.least("sig", "b.lead").alias("u"), F.greatest("sig", "b.lead").alias("v")).distinct()


def _open_postings(shared: DataFrame, roots: DataFrame, any_hot: bool) -> DataFrame:
    """(token, sig, n, pos, comp, size, shingles): postings of shingles whose sets are not all in one component.

    ``size`` counts a shingle's sets, ``shingles`` what they hold together.
    """
    labelled = shared.select("token", "sig", "np", "hot").join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left")
    labelled = labelled.select("token", "sig", "np", "hot", F.coalesce("root", "sig").alias("comp"))
    token = Window.partitionBy("token")
    sums = {"low": F.min("comp"), "high": F.max("comp"), "size": F.count("*"), "shingles": F.sum(F.shiftright("np", 32))}
    over = labelled.where("NOT hot").withColumns({name: of.over(token) for name, of in sums.items()})
    if any_hot:
        hot = written(labelled.where("hot"), "hot_postings")
        over = over.unionByName(keyed_join(hot, hot.groupBy("token").agg(*[of.alias(name) for name, of in sums.items()]), "token", spread_by=["sig"]))
    return over.where("low != high").select("token", "sig", *_unpacked("np", "n", "pos"), "comp", "size", "shingles")


def _block_links(postings: DataFrame, shared: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components within the groups of frequent shingles, compared block by block.

    A group is dealt to blocks; a task has two blocks of it at a time. A pair is compared under the first
    shingle that both prefixes share.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    per_token = postings.select("token", "sig", "n", "pos", "comp", blocks)
    mine = per_token.withColumn("block", F.pmod(F.xxhash64("sig", "token"), F.col("blocks")).cast("int"))
    # Block b meets the blocks from b on; a row goes to (i, b) for i up to b and to (b, j) for j beyond.
    cells = mine.withColumn("cell", F.explode(F.expr("transform(sequence(0, blocks - 1), i -> struct(least(i, block) AS i, greatest(i, block) AS j))")))
    sigs = written(postings.select("sig").distinct(), "open_sets")
    earlier = shared.join(sigs, "sig", "left_semi").select("sig", "token", *_unpacked("np", "n", "pos"))
    earlier = earlier.groupBy("sig").agg(F.collect_list(F.struct("pos", "token")).alias("tokens"))
    rows = cells.join(earlier, "sig").join(_only(sets.select("sig", "spread", "packed"), sigs), "sig")
    rows = rows.select(
        "token", "cell.i", "cell.j", "block", "sig", "n", "pos", "comp", "spread", "packed",
        F.expr("transform(filter(tokens, t -> t.pos < pos), t -> t.token)").alias("before"),
    )

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("pos", "ascending"), ("sig", "ascending")])
        sig, n, pos, comp, block = (_longs(cell, c).copy() for c in ("sig", "n", "pos", "comp", "block"))
        spread = _spreads(cell["spread"].to_pylist())
        across = cell["i"][0].as_py() != cell["j"][0].as_py()
        sets_of: dict[int, np.ndarray] = {}

        def set_at(i: int) -> np.ndarray:
            if i not in sets_of:
                sets_of[i] = _set_of(cell["packed"][i].as_py())
            return sets_of[i]

        before = [frozenset(x.as_py()) for x in cell["before"]]
        found: list[tuple[int, int]] = []
        for x in range(1, len(sig)):
            y = np.arange(x)
            fit = (comp[:x] != comp[x]) & (PERCENT * np.maximum(n[:x], n[x]) <= 100 * np.minimum(n[:x], n[x]))
            if across:
                fit &= block[:x] != block[x]
            fit &= _enough(1 + np.minimum(pos[:x], pos[x]) + np.minimum(n[:x] - pos[:x] - 1, n[x] - pos[x] - 1), n[:x], n[x])
            y = y[fit]
            if len(y):
                y = y[_enough(_most_shared(spread[y], spread[x]), n[y], n[x])]
            for other in y.tolist():
                if comp[other] != comp[x] and before[other].isdisjoint(before[x]) and linked(set_at(other), set_at(x)):
                    found.append((int(sig[other]), int(sig[x])))
                    comp[comp == comp[x]] = comp[other]
        u, v = ([pair[k] for pair in found] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("token", "i", "j").applyInArrow(compare, "u long, v long")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n, sig) of all texts, ``th`` being the text's hash, and classes (sig, root) of their sets."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("raw")
    )
    passed = _sketch_and_ids(texts)
    ids = passed.where("part IS NULL").select("doc_id", "th", "n", "sig")
    counts = _counts(passed)
    any_hot = bool((counts > HOT_SETS).any())
    postings = _postings(texts.select("raw"), counts, HOT_SETS)
    shared = _shared(written(postings, "postings") if any_hot else postings, any_hot)
    sets = _needed_sets(texts, shared)
    return ids, components(_all_links(shared, sets, any_hot)).withColumnRenamed("node", "sig")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    ``component_id`` is the smallest id that links reach, the row's own included. A text without words,
    or a null one, has 0 shingles and its own id. Texts with equal sets are linked, so repeated rows get
    the same component. A row without an id counts in components but gives them no id. An empty table
    gives an empty result.
    """
    ids, roots = _classes(docs)
    known = ids.where("n > 0")
    classes = known.groupBy("sig").agg(F.min("doc_id").alias("least")).join(roots, "sig", "left")
    classes = classes.select("sig", F.coalesce("root", "sig").alias("root"), "least")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("sig", "component_id")
    linked_rows = known.join(classes, "sig").select("doc_id", "n", "component_id")
    alone = ids.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate component, that with the smallest id, with all columns of docs.

    Rows without an id come last in this order, rows that share an id are ordered by their text's hash. Of
    rows that agree in id and text one stays. Texts without words all stay, null ones too.
    """
    ids, roots = _classes(docs)
    known = ids.where("n > 0").join(roots, "sig", "left").select("doc_id", "th", F.coalesce("root", "sig").alias("root"))
    rows = known.groupBy("root", "doc_id", "th").agg(F.count("*").alias("c"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    chosen = rows.groupBy("root").agg(F.min(order).alias("first"))
    decided = rows.join(chosen, "root").withColumn("stays", order.eqNullSafe(F.col("first")))
    touched = written(decided.where("NOT stays OR c > 1").select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), F.col("stays").alias("__stays")), "copies")
    marked = docs.withColumn("__h", F.xxhash64("text")).join(touched, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__th")), "left")
    untouched = marked.where("__stays IS NULL").select(docs.columns)
    repeated = marked.where("__stays").dropDuplicates(["__doc", "__th"]).select(docs.columns)
    return untouched.unionByName(repeated)


def _all_links(shared: DataFrame, sets: DataFrame, any_hot: bool) -> DataFrame:
    """Links that connect what any link connects, over the sets' hashes."""
    tried = written(_leader_pairs(shared), "leader_pairs")
    first = written(_links_of(tried, sets), "leader_links")
    rest = written(_open_postings(shared, components(first), any_hot), "open_postings")
    few = rest.where(F.col("size") <= PAIRS_UP_TO)
    met = few.alias("a").join(few.alias("b"), F.expr("a.token = b.token AND a.sig < b.sig AND a.comp != b.comp AND " + _FILTERS.format("a", "b")))
    pairs = met.select(F.col("a.sig").alias("u"), F.col("b.sig").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    many = _block_links(rest.where(F.col("size") > PAIRS_UP_TO), shared, sets)
    return first.unionByName(_links_of(pairs, sets)).unionByName(many)
