"""Compositions: page merges, batch translation, cached validation, recovery state, reports, markup-first assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import scores as S
from foliospark.functions.portable import SPARK
from foliospark.operators.grouping import batches, ordered_text

#: Between the texts of a batch that is translated in one call.
JOINT = "\n%%%%\n"


def merged_pages(lines: DataFrame) -> DataFrame:
    """Pages extracted apart as one document: its text in page order, and the title of the first page that has one."""
    pages = lines.groupBy("doc_id", "page_num").agg(ordered_text("text", "\n").alias("text"), F.min_by(F.when(F.col("block_type").isin("h1", "h2"), F.col("title")), F.when(F.col("block_type").isin("h1", "h2"), F.col("seq"))).alias("title"))
    first = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("page_num")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"]), "\n")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), first.alias("title"), F.md5(whole).alias("text_md5"))


def translated_in_batches(lines: DataFrame, translate, limit: int) -> DataFrame:
    """Lines (doc_id, seq, text, ...) with ``translated``: batches are joined, translated by one call each, split and put back.

    ``translate`` is a boundary, a function of a text column. Where a call returns another number of parts than it got, the batch's
    lines keep their text.
    """
    batched = batches(lines, limit).join(lines.select("doc_id", "seq", "text"), ["doc_id", "seq"])
    calls = batched.groupBy("doc_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("items"))
    joint = F.array_join(F.transform("items", lambda x: x["text"]), JOINT)
    answered = calls.withColumn("parts", F.split(translate(joint), JOINT)).withColumn("whole", F.size("parts") == F.size("items"))
    out = answered.select("doc_id", "batch_id", "whole", F.explode(F.arrays_zip("items", F.when(F.col("whole"), F.col("parts")).otherwise(F.transform("items", lambda x: x["text"])).alias("made"))).alias("x"))
    return out.select("doc_id", F.col("x.items.seq").alias("seq"), "batch_id", "whole", F.col("x.made").alias("translated"))


def cached_validation(texts: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """Recognised texts (key, engine, text) after cache, choice, validation and store.

    Of a key's engines the best quality counts, the first name of equals. A text of the cache ``known(cache_key)`` is a hit; a miss of at
    least ``least`` quality is stored; a poorer one is corrected first.
    """
    scored = texts.withColumn("quality", F.expr(S.ocr_quality(SPARK, "text"))).withColumn("cache_key", F.md5("text"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("quality"), "engine"))).where("r = 1")
    joined = best.join(known.select("cache_key", F.lit(True).alias("hit")), "cache_key", "left")
    step = F.when(F.col("hit"), "hit").when(F.col("quality") >= least, "store").otherwise("correct")
    return joined.select("key", "engine", "quality", step.alias("step"))


def recovery_state(results: DataFrame) -> DataFrame:
    """For each file of item results (file, item, ok) the items to run again and the partial results kept, in order."""
    items = lambda ok: F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok") == ok, F.col("item")))), ",")
    return results.groupBy("file").agg(items(False).alias("failed_items"), F.count_if(F.col("ok")).alias("partial_results"), F.bool_and("ok").alias("done"))


def image_class(model: Column, width: Column, height: Column, name: Column) -> Column:
    """An image's class by the model, else by its shape, else by its file name; photographs are skipped, others go to the image tool."""
    shape = F.when(width / height > 4, "banner").when(F.greatest(width, height) < 100, "icon")
    by_name = F.when(name.contains("chart"), "chart").when(name.contains("photo"), "photo").otherwise("unknown")
    return F.coalesce(model, shape, by_name)


def report(counts: DataFrame, title: str) -> DataFrame:
    """A text report of (section, name, value) rows: sections and lines in order of their names."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda x: F.concat(x["name"], F.lit(": "), x["value"].cast("string"))), "\n")
    return counts.groupBy("section").agg(lines.alias("body")).select("section", F.concat(F.lit(f"{title}: "), "section", F.lit("\n"), "body").alias("report"))


def markup_first(lines: DataFrame, visuals: DataFrame) -> DataFrame:
    """Documents as HTML from typed lines, each page's first visual behind its last line."""
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(F.col("block_type").isin("h1", "h2", "h3"), F.col("block_type")).when(F.col("block_type") == "list_item", "li").otherwise("p")
    rows = lines.select("doc_id", "page_num", F.col("seq").cast("double").alias("seq"), F.concat(F.lit("<"), tag, F.lit(">"), esc, F.lit("</"), tag, F.lit(">")).alias("html"))
    last = lines.groupBy("doc_id", "page_num").agg((F.max("seq") + 0.5).alias("seq"))
    first = visuals.groupBy("doc_id", "page_num").agg(F.min("seq").alias("visual"))
    images = last.join(first, ["doc_id", "page_num"]).select("doc_id", "page_num", "seq", F.concat(F.lit('<img src="'), F.col("visual").cast("string"), F.lit('.png">')).alias("html"))
    return rows.unionByName(images).groupBy("doc_id").agg(F.count("*").alias("elements"), F.md5(ordered_text("html", "\n")).alias("html_md5"))
