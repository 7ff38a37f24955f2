"""A corpus pipeline of the training-data operators; counted as part of the llm subpackage.

Five stages: documents predicted toxic go; of equal texts one stays; of each group linked by five-word shingles at a
similarity of 0.8 or more one stays; sources are mixed to their target weights; and what is left is packed
into token sequences. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup, jaccard, mixing, packing, queries, toxicity
from foliospark.llm.common import checkpoint, only, sized


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents that are not held out."""
    return toxicity.reject_toxic(docs, queries.table(spark, sf_dir, "labels"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, one row stays: that with the largest doc_id, any of them if rows repeat it.

    A row without doc_id stays only if no row of its group has one. Rows that share a doc_id but not their text are told apart.
    """
    groups = exact_dedup.exact_dedup(docs)
    keys = checkpoint(groups.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")).where(~F.col("kept") | (F.col("rows") > 1)))
    sha, key = _free(docs, "__sha"), F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase).cast("binary")
    marked = docs.withColumn(sha, F.sha2(key, 256))
    same = lambda side: F.col("doc_id").eqNullSafe(side["of_doc"]) & (F.col(sha) == side["of_sha"])
    of = lambda rows: sized(rows.select(F.col("doc_id").alias("of_doc"), F.col("text_sha256").alias("of_sha")))
    gone, repeated = of(keys.where(~F.col("kept"))), of(keys.where(F.col("kept")))
    rest = marked.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return rest.select(*docs.columns)
    once = rest.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", sha])
    return rest.join(repeated, same(repeated), "left_anti").unionByName(once).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component at five words and 0.8, one row stays: that with the smallest doc_id, any of them if rows repeat it.

    A row without doc_id stays only if no row of its component has one. Texts without words are components of their own. Rows are told
    apart by their place in ``docs``, which is a table or another input that reads the same each time.
    """
    row = _free(docs, "__row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    groups = jaccard.ngram_jaccard(placed.select(F.col(row).alias("doc_id"), "text"), words=5, num=80, den=100)
    labelled = groups.where("class_id is not null").select(F.col("doc_id").alias(row), "component_id").join(placed.select("doc_id", row), row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", row)).alias("first")
    members = checkpoint(labelled.select("component_id", "doc_id", row))
    kept = members.groupBy("component_id").agg(first).select(F.col(f"first.{row}").alias(row))
    gone = checkpoint(members.select(row).join(kept, row, "left_anti"))
    return placed.join(sized(gone), row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global shuffle; copies keep their doc_id."""
    mixed = mixing.mix(docs, queries.MIX_WEIGHTS, queries.MIX_DEFAULT, queries.MIX_EPOCHS, queries.MIX_SEED)
    return mixed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Stages of trained and packed results can't be written in SQL.
ORACLE_SQL: str | None = None


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    checkpoint(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet to the shared folder and read again.

    A stage's folder is deleted when its successor's is written; the last one stays for the reader.
    """
    folder, before = _folder(spark), None
    docs = queries.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
