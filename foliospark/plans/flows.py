"""Queries of sinks, dispatches and compositions; the SQL beside each is written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import flows as O
from foliospark.operators import grouping as G
from foliospark.sources import tables as T

Build = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Build, str]] = {}


def _add(name: str, sql: str) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        CATALOG[name] = (build, sql)
        return build

    return keep


def _lines(s: SparkSession, d: str) -> DataFrame:
    return T.headed(T.lines(T.spread(T.read(s, d, "documents"), "doc_id")))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    return T.boxes(T.read(s, d, "part"))


_HEADED, _BOXES = f"WITH {T.HEADED_SQL}", f"WITH {T.BOXES_SQL}"


@_add("s02_image_scan", f"""{_BOXES} SELECT page, seq, concat('page_', page, '_img_', seq, '.png') AS filename, x1 - x0 AS width, y1 - y0 AS height FROM boxes
WHERE label IN ('figure', 'table') AND x1 - x0 >= 30 AND y1 - y0 >= 8 AND greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) <= 20""")  # fmt: skip
def _s02(s, d):
    """Images of a page that are large and square enough; their pixels are a boundary."""
    rows = _boxes(s, d).where("label in ('figure', 'table')").selectExpr("page", "seq", "concat('page_', page, '_img_', seq, '.png') as filename", "x1 - x0 as width", "y1 - y0 as height")
    return rows.where("width >= 30 and height >= 8 and greatest(width, height) / least(width, height) <= 20")


@_add("s19_inspection_files", f"""{_BOXES} SELECT label AS category, count(*) AS elements, md5(string_agg(concat(page, ':', seq), ',' ORDER BY page, seq)) AS locations_md5, count(DISTINCT page) AS pages FROM boxes GROUP BY label""")
def _s19(s, d):
    """A summary and location map for each category of visual elements."""
    rows = _boxes(s, d).withColumn("at", F.concat(F.col("page").cast("string"), F.lit(":"), F.col("seq").cast("string")))
    where = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "at"))), lambda x: x["at"]), ",")
    return rows.groupBy(F.col("label").alias("category")).agg(F.count("*").alias("elements"), F.md5(where).alias("locations_md5"), F.countDistinct("page").alias("pages"))


@_add("s20_recovery_state", """SELECT user_id AS file, coalesce(string_agg(event_id, ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS failed_items, count(*) FILTER (event_type <> 'error') AS partial_results, bool_and(event_type <> 'error') AS done
FROM events GROUP BY user_id""")  # fmt: skip
def _s20(s, d):
    """What a run that stopped has to do again."""
    return O.recovery_state(T.read(s, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("item"), (F.col("event_type") != "error").alias("ok")))


@_add("s28_area_filter", f"""{_BOXES} SELECT page, seq, label FROM boxes WHERE (label = 'table' AND x1 - x0 >= 40 AND y1 - y0 >= 20) OR (label = 'title' AND x1 - x0 >= 30 AND y1 - y0 >= 15) OR (label = 'figure' AND x1 - x0 >= 50 AND y1 - y0 >= 25)""")
def _s28(s, d):
    """Areas that are large enough to render, by kind; rendering is a boundary."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    least = {"table": (40, 20), "title": (30, 15), "figure": (50, 25)}
    fits = F.lit(False)
    for label, (w, h) in least.items():
        fits = fits | ((F.col("label") == label) & (wide >= w) & (high >= h))
    return _boxes(s, d).where(fits).select("page", "seq", "label")


@_add("s29_toc_aware_pages", f"""{_HEADED}, p AS (SELECT doc_id, page_num, count(*) AS blocks, (page_num <= 2 AND count(*) FILTER (regexp_matches(title, '[0-9]')) >= 1) OR page_num % 7 = 1 AS toc, string_agg(text, chr(10) ORDER BY seq) AS text FROM headed GROUP BY doc_id, page_num)
SELECT doc_id, page_num, CASE WHEN toc THEN 'toc_page' ELSE 'content' END AS kind, CASE WHEN toc THEN 0 ELSE blocks END AS blocks, CASE WHEN toc THEN NULL ELSE md5(text) END AS text_md5 FROM p""")  # fmt: skip
def _s29(s, d):
    """Pages of contents give a marker only, all others their blocks."""
    pages = _lines(s, d).groupBy("doc_id", "page_num").agg(F.count("*").alias("n"), F.count_if(F.col("title").rlike("[0-9]")).alias("digits"), G.ordered_text("text", "\n").alias("text"))
    toc = ((F.col("page_num") <= 2) & (F.col("digits") >= 1)) | (F.col("page_num") % 7 == 1)
    return pages.select("doc_id", "page_num", F.when(toc, "toc_page").otherwise("content").alias("kind"), F.when(toc, F.lit(0).cast("long")).otherwise(F.col("n")).alias("blocks"), F.when(~toc, F.md5("text")).alias("text_md5"))


@_add("s32_run_report", """WITH c AS (SELECT coalesce(source, 'none') AS section, coalesce(lang, 'none') AS name, count(*) AS value FROM documents GROUP BY ALL)
SELECT section, 'Documents by language: ' || section || chr(10) || string_agg(name || ': ' || value, chr(10) ORDER BY name, value) AS report FROM c GROUP BY section""")  # fmt: skip
def _s32(s, d):
    """A text report of each source."""
    counts = T.read(s, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("section"), F.coalesce("lang", F.lit("none")).alias("name")).agg(F.count("*").alias("value"))
    return O.report(counts, "Documents by language")


_NAME = "case when seq % 3 = 0 then 'chart.png' when seq % 3 = 1 then 'photo.png' else 'x.png' end"


@_add("c32_image_dispatch", f"""{_BOXES}, k AS (SELECT page, seq, coalesce(CASE WHEN confidence > 0.6 THEN label END, CASE WHEN (x1 - x0) / (y1 - y0) > 4 THEN 'banner' WHEN greatest(x1 - x0, y1 - y0) < 100 THEN 'icon' END,
CASE WHEN contains({_NAME}, 'chart') THEN 'chart' WHEN contains({_NAME}, 'photo') THEN 'photo' ELSE 'unknown' END) AS kind FROM boxes) SELECT page, seq, kind, CASE WHEN kind IN ('photo', 'icon') THEN 'skip' ELSE 'image' END AS tool FROM k""")  # fmt: skip
def _c32(s, d):
    """An image's class by model, shape or name, and the tool it is sent to."""
    kind = O.image_class(F.when(F.col("confidence") > 0.6, F.col("label")), F.expr("x1 - x0"), F.expr("y1 - y0"), F.expr(_NAME))
    return _boxes(s, d).select("page", "seq", kind.alias("kind")).withColumn("tool", F.when(F.col("kind").isin("photo", "icon"), "skip").otherwise("image"))


@_add("o02_page_merge", f"""{_HEADED}, p AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY seq) AS text, arg_min(title, seq) FILTER (block_type IN ('h1', 'h2')) AS title FROM headed GROUP BY doc_id, page_num)
SELECT doc_id, count(*) AS pages, arg_min(title, page_num) FILTER (title IS NOT NULL) AS title, md5(string_agg(text, chr(10) ORDER BY page_num)) AS text_md5 FROM p GROUP BY doc_id""")  # fmt: skip
def _o02(s, d):
    """Pages that were extracted apart, merged in order."""
    return O.merged_pages(_lines(s, d))


@_add("o03_batch_translation", f"""WITH RECURSIVE {T.HEADED_SQL}, i AS (SELECT doc_id, seq, text, length(text) AS n FROM headed), f(doc_id, seq, g, z) AS (SELECT doc_id, seq, 0, n FROM i WHERE seq = 0 UNION ALL
SELECT i.doc_id, i.seq, CASE WHEN f.z + i.n > 4000 THEN f.g + 1 ELSE f.g END, CASE WHEN f.z + i.n > 4000 THEN i.n ELSE f.z + i.n END FROM f JOIN i ON i.doc_id = f.doc_id AND i.seq = f.seq + 1)
SELECT doc_id, seq, g::BIGINT AS batch_id, true AS whole, md5(replace(text, ' ', '_')) AS translated_md5 FROM f JOIN i USING (doc_id, seq)""")  # fmt: skip
def _o03(s, d):
    """Lines translated in joint calls and put back; joining words by _ stands for the translation."""
    return O.translated_in_batches(_lines(s, d), lambda t: F.replace(t, F.lit(" "), F.lit("_")), 4000).select("doc_id", "seq", "batch_id", "whole", F.md5("translated").alias("translated_md5"))


_WORDS = "len(list_filter(str_split_regex(text, '\\s+'), lambda x: x <> ''))"
_QUALITY = f"""(CASE WHEN length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) * 2 > greatest(length(text), 1) THEN 30 ELSE 10 END + CASE WHEN (length(text) - length(replace(text, chr(10), ''))) * 10 < greatest(length(text), 1) THEN 25 ELSE 5 END
+ CASE WHEN {_WORDS} > 20 THEN 30 WHEN {_WORDS} > 5 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(text, '[�□■]') THEN 0 ELSE 15 END) / 100"""


@_add("o05_cached_validation", f"""WITH t AS (SELECT doc_id AS key, e AS engine, CASE e WHEN 'a' THEN left(text, 90) ELSE text END AS text FROM documents, (VALUES ('a'), ('b')) v(e) WHERE text IS NOT NULL), q AS (SELECT *, {_QUALITY} AS quality FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY quality DESC, engine) AS r FROM q), k AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL)
SELECT key, engine, quality, CASE WHEN h IS NOT NULL THEN 'hit' WHEN quality >= 0.8 THEN 'store' ELSE 'correct' END AS step FROM b LEFT JOIN k ON md5(text) = h WHERE r = 1""")  # fmt: skip
def _o05(s, d):
    """Texts of two engines, of which one reads the first line or so: best engine, cache, validation, store."""
    docs = T.spread(T.read(s, d, "documents"), "doc_id").where("text is not null")
    texts = docs.select(F.col("doc_id").alias("key"), F.explode(F.expr("array(named_struct('engine', 'a', 'text', left(text, 90)), named_struct('engine', 'b', 'text', text))")).alias("x")).select("key", "x.engine", "x.text")
    return O.cached_validation(texts, docs.where("doc_id % 5 = 0").select(F.md5("text").alias("cache_key")).distinct())


@_add("o09_markup_first", f"""WITH {T.HEADED_SQL}, {T.BOXES_SQL}, t AS (SELECT *, CASE WHEN block_type IN ('h1', 'h2', 'h3') THEN block_type WHEN block_type = 'list_item' THEN 'li' ELSE 'p' END AS tag FROM headed),
v AS (SELECT doc_id, page % 3 + 1 AS page_num, min(seq) AS visual FROM boxes WHERE label = 'figure' GROUP BY 1, 2),
h AS (SELECT doc_id, seq::DOUBLE AS seq, '<' || tag || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '>' AS html FROM t
UNION ALL SELECT l.doc_id, max(l.seq) + 0.5, '<img src="' || any_value(visual) || '.png">' FROM headed l JOIN v ON l.doc_id = v.doc_id AND l.page_num = v.page_num GROUP BY l.doc_id, l.page_num)
SELECT doc_id, count(*) AS elements, md5(string_agg(html, chr(10) ORDER BY seq)) AS html_md5 FROM h GROUP BY doc_id""")  # fmt: skip
def _o09(s, d):
    """Documents assembled as HTML from markup, with the visuals of their pages."""
    return O.markup_first(_lines(s, d), _boxes(s, d).where("label = 'figure'").withColumn("page_num", F.expr("page % 3 + 1")))
