"""Small document tables and their awkward cases."""

import random

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=()):
    """Documents 0, 1, ... with the given texts, and rows of ``extra`` as they are."""
    rows = [(i, t, "en", f"src{i % 20}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS)


def words(n, seed, vocabulary=2000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def text(n, seed):
    return " ".join(words(n, seed))


AWKWARD = [None, "", " ", "\n\n", "one", "é中\U0001f600", "a b c d e f g h i j k l " * 3000, "\t tab\x0bbed \r text"]


def with_clashes(docs, *names):
    """The table with extra columns of the given names."""
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("extra") for name in names})


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
