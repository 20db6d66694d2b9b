"""Removing repeated lines across a corpus by a deletion-neighbourhood join.

Lines are compared as sequences of words. Two lines are copies if their words are equal; they are
near copies if both have at least ``edit_words`` words and one word inserted, deleted or replaced turns
one into the other. A line goes if a copy or near copy stands earlier, in the order of (doc_id, text
hash, line number). Lines under ``min_words`` words take no part and stay, unless their words have
``min_word_chars`` characters or more on average, as those of scripts without blanks, addresses and long tokens have.

Everything is a column expression: a line emits a hashed key for itself and for each variant with one
word left out, lines with equal keys meet, and the word edit distance of each pair is checked. The
keys come from running sums of hashes of words with their places, so that a variant costs a few additions
and not a new pass over the line, and words in another order give another key. Only lines that share their first or last half with another line emit variants: one
edit leaves one of the halves as it is, so no pair is lost. Until then lines are not split: with one blank between
words, equal words are equal texts, and halves are parts of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import written

MIN_WORDS = 5
EDIT_WORDS = 10
# Words of this many characters on average are no short sentence of a script that puts blanks between words.
MIN_WORD_CHARS = 20
_OTHER_SPACES = "\t\x0b\x0c\r"
_MODULUS = 1 << 61
# What a join needs is told from most of the rest by this many hash values, so that the list of
# them that is broadcast never exceeds this many rows.
BUCKETS = 1 << 20


def split_words(line: Column) -> Column:
    """Words of a line, between blanks, tabs and the like."""
    blanks = F.when(line.rlike(f"[{_OTHER_SPACES}]"), F.translate(line, _OTHER_SPACES, " " * len(_OTHER_SPACES))).otherwise(line)
    return F.array_remove(F.split(blanks, " "), "")


def _count(text: Column, char: str) -> Column:
    """How often an ASCII character occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def _spaced(line: Column) -> Column:
    """The words of a line with one blank between; most lines are so already."""
    others = [F.contains(line, F.lit(blanks)) for blanks in (*_OTHER_SPACES, "  ")]
    uneven = reduce(or_, others) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(uneven, F.array_join(split_words(line), " ")).otherwise(line)


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc, th, line, spaced, n) of every line: its words with one blank between, and their number."""

    def row(spaced: Column, line: Column) -> Column:
        n = F.when(spaced == "", 0).otherwise(_count(spaced, " ") + 1)
        return F.struct(line.alias("line"), spaced.alias("spaced"), n.alias("n"))

    # The text is hashed before the rows are made, once for all of its lines, and a line's columns as they are made: a
    # filter on columns made later, or on an array that is a column, would work them out again.
    hashed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")
    return hashed.select("doc", "th", F.inline(F.transform(F.transform(F.split("text", "\n"), _spaced), row)))


def _half_keys(lines: DataFrame, edit_words: int) -> DataFrame:
    """The lines with ``halves``: hashes of the first and last ``m`` words, m at most half the line.

    ``m`` doubles with the length of the line. The shortest line of each class also emits the keys of
    the class below, as its partner with one word less is there.
    """
    half = edit_words // 2

    def keys(m: str) -> list[Column]:
        first, last = F.expr(f"substring_index(spaced, ' ', {m})"), F.expr(f"substring_index(spaced, ' ', -{m})")
        return [F.xxhash64(F.lit(1), F.expr(m), first), F.xxhash64(F.lit(2), F.expr(m), last)]

    both = F.array(*keys("m"), *keys("(m div 2)::int"))
    halves = (
        F.when(F.col("n") < edit_words, F.array().cast("array<bigint>"))
        .when((F.col("n") == 2 * F.col("m")) & (F.col("m") > half), both)
        .otherwise(F.array(*keys("m")))
    )
    return lines.withColumn("m", F.expr(f"shiftleft({half}, length(bin(n div {2 * half})) - 1)")).withColumn("halves", halves).drop("m")


def _sum(a: Column, b: Column) -> Column:
    return F.pmod(a + b, F.lit(_MODULUS))


def _running(first: Column, values: Column) -> Column:
    """``first`` and its sum with the first value, the first two values and so on."""
    return F.aggregate(values, F.array(first), lambda sums, x: F.array_append(sums, _sum(F.element_at(sums, -1), x)))


def _variants(lines: DataFrame) -> DataFrame:
    """(len, key, pos, at): the whole line (pos 0) and the line without its word ``pos``.

    ``key`` sums hashes of each word with its place. Leaving a word out moves all words behind it down by one
    place: with ``down`` the hashes at the lower places, the key is the sum of all of ``down`` without the
    word's, and of what staying adds for each word before it. ``at`` is the line's place and identity.
    """

    def placed(w: Column, place: Column) -> Column:
        return F.pmod(F.xxhash64(w, place), F.lit(_MODULUS))

    adds = F.transform("words", lambda w, i: F.pmod(placed(w, i + 1) - placed(w, i), F.lit(_MODULUS)))
    hashed = lines.select("at", "n", F.transform("words", placed).alias("down"), adds.alias("adds"), F.ceil(F.sqrt("n")).cast("int").alias("size"))
    # Adding to an array copies it, so the running sums are taken in about sqrt(n) parts.
    parts = F.transform(F.sequence(F.lit(0), F.expr("n div size").cast("int")), lambda k: F.slice("adds", k * F.col("size") + 1, F.col("size")))
    zero = F.lit(0).cast("long")
    parted = hashed.select("at", "n", "size", "down", F.transform(parts, lambda part: _running(zero, part)).alias("parts"))
    starts = _running(F.aggregate("down", zero, _sum), F.transform("parts", lambda part: F.element_at(part, -1)))
    before = F.zip_with("parts", F.slice(starts, 1, F.size("parts")), lambda part, start: F.transform(F.slice(part, 1, F.col("size")), lambda x: _sum(x, start)))
    # The sum of ``down`` and of what the words before each place add; the last one is the whole line's.
    summed = parted.select("at", "n", "down", F.flatten(before).alias("before"))
    itself = F.struct(F.col("n").alias("len"), F.element_at("before", -1).alias("key"), F.lit(0).alias("pos"))
    keys = F.zip_with(F.slice("before", 1, F.col("n")), "down", lambda sums, own: F.pmod(sums - own, F.lit(_MODULUS)))
    deletions = F.transform(keys, lambda key, i: F.struct((F.col("n") - 1).alias("len"), key.alias("key"), (i + 1).alias("pos")))
    return summed.select("at", F.inline(F.concat(F.array(itself), deletions)))


def _shared_variants(variants: DataFrame) -> DataFrame:
    """The variants whose key another line has as well; nearly all others are told by a list of bounded length."""
    # A line may have the same variant several times, where a word repeats; that alone is no match.
    line = F.xxhash64("at")
    lines = variants.groupBy("len", "key").agg(F.min(line).alias("low"), F.max(line).alias("high"))
    shared = written(lines.where("low != high").select("len", "key"), "shared_keys")
    bucket = F.pmod(F.xxhash64("len", "key"), F.lit(BUCKETS)).alias("bucket")
    likely = variants.select("*", bucket).join(F.broadcast(shared.select(bucket).distinct()), "bucket", "left_semi")
    return written(likely.drop("bucket").join(shared, ["len", "key"], "left_semi"), "shared_variants")


def _within_one_edit(a: Column, b: Column) -> Column:
    """One word inserted, deleted or replaced: common start and common end cover all but one word."""
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))

    def common(of_a, of_b) -> Column:
        same = F.transform(F.sequence(F.lit(1), shorter), lambda i: of_a(i) == of_b(i))
        first_other = F.array_position(same, False)
        return F.when(first_other == 0, shorter).otherwise(first_other - 1)

    start = common(lambda i: F.element_at(a, i), lambda i: F.element_at(b, i))
    end = common(lambda i: F.element_at(a, -i), lambda i: F.element_at(b, -i))
    return (longer - shorter <= 1) & (F.least(start + end, shorter) >= longer - 1)


def near_copies(lines: DataFrame) -> DataFrame:
    """Pairs (later, earlier) of places of near copies, at least one pair for each line to remove.

    ``lines``: distinct lines (at, n, words). Lines without the same word at the same place are mutual
    near copies, so each meets only the earliest of them; a line with one word less is a single line.
    """
    v = _shared_variants(_variants(lines))
    same_place = v.where("pos > 0").groupBy("len", "key", "pos").agg(F.min("at").alias("earliest"), F.count("*").alias("c")).where("c > 1")
    replaced = v.join(same_place, ["len", "key", "pos"]).where("at > earliest").select(F.col("at").alias("later"), F.col("earliest").alias("earlier"))
    whole = v.where("pos = 0").select("len", "key", F.col("at").alias("shorter"))
    inserted = (
        v.where("pos > 0")
        .join(whole, ["len", "key"])
        .select(F.greatest("at", "shorter").alias("later"), F.least("at", "shorter").alias("earlier"))
    )
    pairs = replaced.unionByName(inserted).distinct()
    words = lines.select("at", "words")
    return (
        pairs.join(words.select(F.col("at").alias("later"), F.col("words").alias("a")), "later")
        .join(words.select(F.col("at").alias("earlier"), F.col("words").alias("b")), "earlier")
        .where(_within_one_edit(F.col("a"), F.col("b")))
        .select("later", "earlier")
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS, min_word_chars: int = MIN_WORD_CHARS) -> DataFrame:
    """(doc, th, line) of every line with an earlier copy or near copy; ``th`` is the text's hash."""
    if edit_words < 4 or edit_words % 2:
        raise ValueError("edit_words must be an even number from 4")
    chars = F.length("spaced") - (F.col("n") - 1)
    unspaced = F.when((F.col("n") > 0) & (F.col("n") < min_words), chars >= F.col("n") * min_word_chars)
    lines = _half_keys(_line_rows(docs).where((F.col("n") >= min_words) | unspaced), edit_words)
    known = written(
        lines.select("doc", "th", "line", F.xxhash64("spaced").alias("h1"), F.xxhash64(F.lit(7), "spaced").alias("h2"), "halves"), "lines"
    )
    # One row for each distinct line: its first place, how often it occurs and the keys of its halves.
    distinct_lines = written(
        known.groupBy("h1", "h2").agg(
            F.min(F.struct("doc", "th", "line")).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves")
        ),
        "distinct_lines",
    )
    halves = distinct_lines.select("h1", "h2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    maybe_near = halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()
    first_places = distinct_lines.join(maybe_near, ["h1", "h2"], "left_semi").select("first.*")
    candidates = written(_fetched(docs, first_places), "candidate_lines")
    near = near_copies(candidates).select(F.col("later").alias("first")).distinct()
    removed = (
        distinct_lines.join(near.withColumn("near", F.lit(True)), "first", "left")
        .where("copies > 1 OR near")
        .select("h1", "h2", F.when(F.col("near").isNull(), F.col("first")).alias("stays"))
    )
    places = known.select(F.struct("doc", "th", "line").alias("at"), "h1", "h2")
    return places.join(removed, ["h1", "h2"]).where("NOT (at <=> stays)").select("at.*").distinct()


def _fetched(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(at, n, words) of the lines at the given places."""
    wanted = written(places.groupBy("doc", "th").agg(F.collect_set("line").alias("wanted")), "candidate_places")
    bucket = F.pmod(F.xxhash64("doc", "th"), F.lit(BUCKETS)).alias("bucket")
    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")
    texts = texts.select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").alias("d")
    rows = texts.join(wanted.alias("w"), F.expr("d.doc <=> w.doc AND d.th = w.th")).select("d.doc", "d.th", "text", "wanted")
    found = _of_lines(
        F.col("text"), lambda lines: F.transform("wanted", lambda line: F.struct(line.alias("line"), split_words(F.get(lines, line)).alias("words")))
    )
    lines = rows.dropDuplicates(["doc", "th"]).select("doc", "th", F.inline(found))
    return lines.select(F.struct("doc", "th", "line").alias("at"), F.size("words").alias("n"), "words")


def _of_lines(text: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a text's lines, for use with functions over elements.

    Those work out columns inside of them anew for each element; here the text is split once.
    """
    return F.transform(F.array(F.split(text, "\n")), result)[0]


def drop_repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS, min_word_chars: int = MIN_WORD_CHARS
) -> DataFrame:
    """The documents without their repeated lines, and ``n_lines`` and ``n_dropped``.

    Takes any table with ``doc_id`` and ``text``; other columns pass through (``n_lines`` and
    ``n_dropped`` are replaced where they exist). A null text stays null with 0 lines; an empty one has
    one empty line, which stays. A document whose lines all go keeps its row, with an empty text. Rows
    that agree in id and text count as one place and are treated alike; a null id sorts first. An
    empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_dropped")
    gone = (
        repeated_lines(docs.select("doc_id", "text"), min_words, edit_words, min_word_chars)
        .groupBy("doc", "th")
        .agg(F.collect_set("line").alias("gone"))
        .select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    )
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__th")), "left")

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_of_lines(F.col("text"), kept))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(_count(F.col("text"), "\n") + 1).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_dropped"),
    )
