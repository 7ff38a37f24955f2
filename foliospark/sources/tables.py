"""Readers and adapters: given tables to documents, lines, paragraphs, boxes and spans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import classify as C
from foliospark.functions.portable import CHECK, SPARK

#: Lines of a derived page.
PAGE_LINES = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table of fewer splits than cores over all cores by its keys, which later groupings by them reuse.

    A row group can't be split, so a small table of one would keep all work on one core; tables of enough splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache of one JSON object, key to text or to an entry, as rows; legacy text entries get the language ``unknown``."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("cache_key", "entry"))
    parsed = F.from_json("entry", "original_text string, translated_text string, target_language string, model_name string, usage_count long, quality_score double")
    typed = F.col("entry").startswith("{")
    return raw.select(
        "cache_key", F.when(typed, parsed["original_text"]).alias("original_text"), F.when(typed, parsed["translated_text"]).otherwise(F.col("entry")).alias("translated_text"),
        F.when(typed, parsed["target_language"]).otherwise(F.lit("unknown")).alias("target_language"), F.when(typed, parsed["model_name"]).otherwise(F.lit("unknown")).alias("model_name"),
        F.when(typed, F.coalesce(parsed["usage_count"], F.lit(1))).otherwise(F.lit(1)).alias("usage_count"),
    )


def write_json_cache(cache: DataFrame, path: str) -> None:
    """Cache rows as JSON lines, one file set for each target language."""
    cache.write.mode("overwrite").partitionBy("target_language").json(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A glossary of one JSON object as rows (term, translation)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "translation"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of a COCO file as two tables."""
    raw = spark.read.option("multiLine", True).schema("images array<struct<id:long,file_name:string,width:double,height:double>>, annotations array<struct<image_id:long,category_id:long,bbox:array<double>>>").json(path)
    return raw.select(F.inline("images")), raw.select(F.inline("annotations"))


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """Markup files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def scan_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """Names, sizes and times of the files of one folder with a suffix in any case, not below it; contents aren't read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder).select("path", "length", "modificationTime")


def lines(docs: DataFrame) -> DataFrame:
    """Documents cut at newlines: doc_id, seq, page_num, text, block_type. A narrow operator without shuffle."""
    cut = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    numbered = cut.select("doc_id", "lang", "source", F.col("seq").cast("long").alias("seq"), F.expr(f"cast(seq div {PAGE_LINES} + 1 as bigint)").alias("page_num"), "text")
    return numbered.withColumn("block_type", F.expr(C.block_type(SPARK, "text")))


#: Every eighth line of the given prose stands for a heading, and its first words for a title.
HEADED = "case when seq % 24 = 0 then 'h1' when seq % 8 = 0 then 'h2' else block_type end"


def headed(rows: DataFrame) -> DataFrame:
    """Lines with headings, and ``title``, the first six words of a line."""
    return rows.withColumn("block_type", F.expr(HEADED)).withColumn("title", F.regexp_extract("text", r"^\s*((?:\S+\s+){0,5}\S+)", 1))


def weighed(rows: DataFrame) -> DataFrame:
    """Lines with ``bare`` (stripped), ``low`` (its lower case) and ``importance``, each computed once."""
    marked = rows.withColumn("bare", F.expr(SPARK.strip("text"))).withColumn("low", F.lower("bare"))
    return marked.withColumn("importance", F.expr(C.importance(SPARK, "text", "block_type", "page_num", "bare", "low")))


LINES_SQL = f"""cut AS (SELECT doc_id, lang, source, unnest(str_split(text, chr(10))) AS text, unnest(range(len(str_split(text, chr(10))))) AS seq FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, lang, source, seq, CAST(seq // {PAGE_LINES} + 1 AS BIGINT) AS page_num, text, {C.block_type(CHECK, "text")} AS block_type FROM cut)"""


HEADED_SQL = LINES_SQL + f""",
headed AS (SELECT * REPLACE ({HEADED} AS block_type), regexp_extract(text, '^\\s*((\\S+\\s+){{0,5}}\\S+)', 1) AS title FROM lines)"""


def boxes(parts: DataFrame) -> DataFrame:
    """Deterministic layout boxes derived from part keys: twelve boxes a page, three pages a document."""
    k = F.col("p_partkey")
    return parts.select(
        F.expr("cast(p_partkey div 36 as bigint)").alias("doc_id"), F.expr("cast(p_partkey div 12 as bigint)").alias("page"), (k % 12).alias("seq"), F.col("p_name").alias("text"),
        ((k * 37) % 500).cast("double").alias("x0"), ((k * 53) % 700).cast("double").alias("y0"), ((k * 37) % 500 + 20 + F.col("p_size") * 3).cast("double").alias("x1"), ((k * 53) % 700 + 10 + (k * 7) % 40).cast("double").alias("y1"),
        F.expr("case p_partkey % 5 when 0 then 'figure' when 1 then 'title' when 2 then 'table' else 'text' end").alias("label"), ((k * 17) % 100 / F.lit(100.0)).alias("confidence"),
    )


BOXES_SQL = """boxes AS (SELECT CAST(p_partkey // 36 AS BIGINT) AS doc_id, CAST(p_partkey // 12 AS BIGINT) AS page, p_partkey % 12 AS seq, p_name AS text,
CAST((p_partkey * 37) % 500 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 700 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 500 + 20 + p_size * 3 AS DOUBLE) AS x1, CAST((p_partkey * 53) % 700 + 10 + (p_partkey * 7) % 40 AS DOUBLE) AS y1,
CASE p_partkey % 5 WHEN 0 THEN 'figure' WHEN 1 THEN 'title' WHEN 2 THEN 'table' ELSE 'text' END AS label, (p_partkey * 17) % 100 / 100.0::DOUBLE AS confidence FROM part)"""


def spans(events: DataFrame) -> DataFrame:
    """Events as trace spans: a trace for each user, the parent is the user's event before."""
    return events.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("operation"), F.col("ts").alias("started"), F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").cast("long").alias("found"))


SPANS_SQL = "spans AS (SELECT user_id AS trace_id, event_id AS span_id, event_type AS operation, ts AS started, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS found FROM events)"


def embedding_cache(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cache entries (cache_key, ...) with their vectors (cache_key, embedding); entries without a vector are dropped."""
    return entries.join(vectors.select("cache_key", "embedding"), "cache_key")


def write_embedding_cache(entries: DataFrame, vectors: DataFrame, path: str) -> None:
    """Entries and vectors as one Parquet table; nothing is pickled."""
    embedding_cache(entries, vectors).write.mode("overwrite").parquet(path)


def read_embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """A written embedding cache; rows whose vector is null are dropped as on writing."""
    return spark.read.parquet(path).where(F.col("embedding").isNotNull())


def quarantined(failed: DataFrame, most: int, batch_pages: int) -> DataFrame:
    """Failures (file, batch, error), one row each, as dead letters of the batches with ``most`` or more."""
    counted = failed.groupBy("file", "batch").agg(F.count("*").alias("failures"), F.max("error").alias("error")).where(F.col("failures") >= most)
    start = F.col("batch") * batch_pages
    return counted.select("file", "batch", "failures", start.alias("start_page"), (start + batch_pages - 1).alias("end_page"), "error", F.concat("file", F.lit("_batch_"), "batch", F.lit("_quarantine.json")).alias("name"))


def write_quarantine(letters: DataFrame, path: str) -> None:
    """Dead letters as JSON lines."""
    letters.write.mode("append").json(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """All dead letters of a folder."""
    return spark.read.schema("file long, batch long, failures long, start_page long, end_page long, error string, name string").json(path)


def with_heuristics(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Detections (doc_id, page, seq, label, confidence); images of documents without any count as figures of confidence 0.8."""
    columns = ["doc_id", "page", "seq", "label", "confidence"]
    missed = images.join(detections.select("doc_id").distinct(), "doc_id", "left_anti")
    stand_in = missed.select("doc_id", "page", "seq", F.lit("figure").alias("label"), F.lit(0.8).alias("confidence"), F.lit("heuristic").alias("method"))
    return detections.select(*columns, F.lit("model").alias("method")).unionByName(stand_in)


def output_folder(path: Column, root: str, most: int = 100) -> Column:
    """The output folder of an input path: its file name without extension, refused characters to _, runs of - and _ closed up, edges trimmed."""
    stem = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^(.*?)(\.[^.]*)?$", 1)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r'[<>:"/\\|?*+]', "_"), r"-{2,}", "-"), r"_{2,}", "_")
    clean = F.btrim(clean, F.lit(" ._-"))
    return F.concat(F.lit(root), F.when(clean == "", "sanitized_document").otherwise(F.left(clean, F.lit(most))))
