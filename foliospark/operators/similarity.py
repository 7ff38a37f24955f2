"""Sequence-similarity operators that no built-in expression computes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(left: str, right: str) -> float:
    """The sequence matcher's similarity of two texts."""
    return SequenceMatcher(None, left, right).ratio()


def fuzzy_lookup(queries: DataFrame, cache: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Each query (key, lang, text) with its most similar cached entry (cache_key, lang, text) of ``threshold`` or more.

    A ratio of t needs lengths within t / (2 - t), an exact band. Texts are dealt into length buckets one band
    wide, so a query meets its own and the neighbouring buckets of its language only. The ratio runs on Arrow batches.
    """
    band = threshold / (2 - threshold)
    step = F.floor(F.log(F.greatest(F.length("text"), F.lit(1)).cast("double")) / F.log(F.lit(1 / band))).cast("int")
    asked = queries.select("key", "lang", "text", F.explode(F.array(step - 1, step, step + 1)).alias("bucket"))
    known = cache.select("cache_key", "lang", F.col("text").alias("cached"), step.alias("bucket"))
    near = asked.join(known, ["lang", "bucket"]).where(F.least(F.length("text"), F.length("cached")) >= band * F.greatest(F.length("text"), F.length("cached")))

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])

    scored = near.withColumn("ratio", similar("text", "cached")).where(F.col("ratio") >= threshold)
    best = scored.groupBy("key").agg(F.max(F.struct("ratio", F.col("cache_key"))).alias("b"))
    return best.select("key", F.col("b.cache_key").alias("cache_key"), F.col("b.ratio").alias("ratio"))


def drop_similar(titles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Titles (doc_id, seq, text) of a document that resemble none kept before them; a document bounds the group.

    The matcher's two bounds from lengths and letters rule most pairs out; only the others are aligned.
    """

    def keep(rows: list[tuple[int, str]]) -> list[int]:
        kept: list[SequenceMatcher] = []
        seqs = []
        for seq, text in sorted(rows):
            low = text.lower()
            if not any(_resembles(matcher, low, threshold) for matcher in kept):
                kept.append(SequenceMatcher(None, "", low))
                seqs.append(seq)
        return seqs

    return _fold_titles(titles, keep)


def _resembles(matcher: SequenceMatcher, text: str, threshold: float) -> bool:
    """Whether the ratio of a text and the matcher's own one is over the threshold."""
    matcher.set_seq1(text)
    return matcher.real_quick_ratio() > threshold and matcher.quick_ratio() > threshold and matcher.ratio() > threshold


def drop_contained(titles: DataFrame) -> DataFrame:
    """Titles, shortest first, that neither hold nor are held by one kept before; a document bounds the group."""

    def keep(rows: list[tuple[int, str]]) -> list[int]:
        kept: list[str] = []
        seqs = []
        for seq, title in sorted(rows, key=lambda r: (len(r[1]), *r)):
            text = " ".join(title.lower().split())
            if text and not any(text in k or k in text for k in kept):
                kept.append(text)
                seqs.append(seq)
        return seqs

    return _fold_titles(titles, keep)


def _fold_titles(titles: DataFrame, keep: Callable[[list[tuple[int, str]]], list[int]]) -> DataFrame:
    """The rows (doc_id, seq) whose seq ``keep`` returns of a document's (seq, text).

    A document is one row of an Arrow batch of many, as a group of its own would cost far more than its few titles.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups = batch.column("doc_id"), batch.column("titles")
            rows = groups.flatten()
            seqs, texts, ends = rows.field("seq").to_pylist(), rows.field("text").to_pylist(), np.cumsum(groups.value_lengths()).tolist()
            kept = [keep(list(zip(seqs[i:j], texts[i:j], strict=True))) for i, j in zip([0, *ends], ends, strict=False)]
            owners = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owners)), pa.array([s for k in kept for s in k], pa.int64())], ["doc_id", "seq"])

    rows = F.struct(F.col("seq").cast("long").alias("seq"), "text")
    return titles.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(rows).alias("titles")).mapInArrow(fold, "doc_id long, seq long")


def translate_lines(rows: Iterator[pd.DataFrame], translate) -> Iterator[pd.DataFrame]:
    """Boundary for a real model: apply ``translate(texts) -> texts`` to Arrow batches of a column named text."""
    for batch in rows:
        yield batch.assign(text=translate(batch["text"].tolist()))


def containing(texts: DataFrame, parts: DataFrame, part: str, limit: int = 10_000) -> DataFrame:
    """Rows of ``texts`` (text) with the rows of ``parts`` whose text they hold.

    Short lists of parts (counted) are broadcast. Beyond the limit both sides meet on the part's second to fifth word, whole
    words that a holding text has among its four-word shingles, so no text meets a part that it can't hold. Parts
    of under six words have no such words; they are broadcast, and more than ``limit`` of them are refused.
    """
    if parts.count() <= limit:
        return texts.join(F.broadcast(parts), F.contains(F.col("text"), F.col(part)))
    cut = F.split(part, r"\s+")
    brief, long = parts.where(F.size(cut) < 6), parts.where(F.size(cut) >= 6)
    if brief.count() > limit:
        raise ValueError(f"more than {limit} parts of under six words")
    words = F.split("text", r"\s+")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 3)), lambda i: F.concat_ws(" ", F.slice(words, i, 4)))
    near = texts.withColumn("__key", F.explode(F.array_distinct(shingles))).join(long.withColumn("__key", F.concat_ws(" ", F.slice(cut, 2, 4))), "__key")
    found = near.where(F.contains(F.col("text"), F.col(part))).drop("__key")
    return found.unionByName(texts.join(F.broadcast(brief), F.contains(F.col("text"), F.col(part))))
