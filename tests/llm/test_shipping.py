"""Functions of the package reach workers that do not have it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]

# The driver finds the package by a path of its own; workers start in another folder and without it.
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
spark.sparkContext.setLogLevel("OFF")

@F.arrow_udf("boolean")
def found(x):
    import importlib.util, pyarrow as pa
    return pa.array([importlib.util.find_spec("tallyframe") is not None] * len(x))

assert spark.range(1).select(found("id")).first()[0] is False
from tallyframe.llm import decontaminate, hnsw, html_extract, jaccard_join, lang_id, lexical_search, quality, toxicity, warc, whitening
texts = [f"word{i % 7} some text of document number {i % 5} you idiot said she" for i in range(60)]
docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS label")
items = spark.createDataFrame([(1, texts[3]), (2, "short one"), (3, "text of")], "item_id long, text string")
pages = docs.selectExpr("doc_id AS page_id", "concat('http://h/', doc_id) AS url", "concat('<p>', text, '</p>') AS html")
vectors = spark.range(60).selectExpr("id AS vec_id", "transform(sequence(0, 7), k -> CAST(cos(id * (k + 1)) AS FLOAT)) AS embedding", "0 AS label")
done = {
    "lang_id": lang_id.identify(docs, lang_id.fit(docs), ["doc_id"]),
    "warc": warc.archive_and_read(pages),
    "html": html_extract.main_texts(pages, html_extract.fit(pages)),
    "quality": quality.score(docs, quality.fit(docs, labels), ["doc_id"]),
    "toxicity": toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]),
    "clean": toxicity.keep_clean(docs, toxicity.fit(docs, labels)),
    "leaks": decontaminate.leaks(docs, items),
    "without_leaks": decontaminate.without_leaks(docs, items),
    "nearest": hnsw.search(hnsw.build_index(vectors, 3), vectors.where("vec_id % 50 = 0"), 3),
    "components": jaccard_join.near_duplicate_components(docs),
    "one_of_each": jaccard_join.one_of_each(docs),
    "whitening": whitening.whiten(vectors),
    "search": lexical_search.search(lexical_search.build_index(docs), items),
}
for name, frame in done.items():
    frame.collect()
    print("done", name)
"""


def test_workers_need_not_have_the_package(tmp_path):
    script = tmp_path / "script.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script), str(REPO), str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.count("done") == 13
