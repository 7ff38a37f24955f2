"""Folds of a document's titles: the same rows as a plain loop, without a Python group for each document."""

import random

from pyspark.sql import functions as F

from foliospark.operators import similarity as M
from foliospark.plans import relational as R
from foliospark.sources import tables as T

WORDS = ["Report", "report", "of", "Straße", "İzmir", "a", "The", "the  end", "x" * 210, " "]


def _titles(spark, docs=60):
    rng = random.Random(11)
    rows = [(doc, seq, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))) for doc in range(docs) for seq in range(rng.choice([1, 1, 2, 25]))]
    rows += [(7, 0, "Given again"), (7, 0, "given twice"), (8, 0, ""), (None, 3, "Without a document"), (None, 4, "without a document!")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, seq long, text string").repartition(3)


def _by_document(rows, order):
    for doc in {r[0] for r in rows}:
        yield doc, sorted(((seq, text) for d, seq, text in rows if d == doc), key=order)


def _one_row_a_document(frame):
    return "FlatMapGroups" not in frame._jdf.queryExecution().toString()


def test_similar_titles_equal_a_loop(spark):
    rows, frame = _titles(spark)
    want = []
    for doc, titles in _by_document(rows, None):
        kept = []
        for seq, text in titles:
            if all(M.ratio(text.lower(), k) <= 0.8 for k in kept):
                kept.append(text.lower())
                want.append((doc, seq))
    got = M.drop_similar(frame)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len(want) < len(rows) and _one_row_a_document(got)


def test_contained_titles_equal_a_loop(spark):
    rows, frame = _titles(spark)
    want = []
    for doc, titles in _by_document(rows, lambda t: (len(t[1]), *t)):
        kept = []
        for seq, text in titles:
            text = " ".join(text.lower().split())
            if text and not any(text in k or k in text for k in kept):
                kept.append(text)
                want.append((doc, seq))
    got = M.drop_contained(frame)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len(want) < len(rows) and _one_row_a_document(got)


def test_folds_of_no_titles(spark):
    none = spark.createDataFrame([], "doc_id long, seq long, text string")
    assert M.drop_similar(none).collect() == [] == M.drop_contained(none).collect()


def test_titles_are_those_of_all_headings(spark, tmp_path):
    odd = ["# One", "## Two", "### Three", "#None", "1.2 Results", "IV. Future", "Introduction", "RESULTS", "Chapter 3 Overview", "def f(x):", "x = y + 1", "page 3", "- item", "", "  ", "Figure 1: Work", "Summary:", "Related Work", "2 Analysis", "[missing_page]"]
    rng = random.Random(2)
    docs = [(n, "\n".join(rng.choice(odd) for _ in range(40)), "en", "s") for n in range(30)] + [(99, None, "en", "s"), (100, "", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    every = T.headed(T.lines(T.read(spark, str(tmp_path), "documents"))).where("block_type in ('h1', 'h2') and title <> ''").select("doc_id", "seq", F.col("title").alias("text"))
    want = sorted(map(tuple, every.collect()))
    assert sorted(map(tuple, R._titles(spark, str(tmp_path)).collect())) == want
    assert any(seq % 8 for _, seq, _ in want)
