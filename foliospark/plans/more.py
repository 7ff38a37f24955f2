"""Further queries of the engine: profiles, classifiers over aggregates, ordered merges, rendering, two-tier caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import classify as C
from foliospark.functions import predicates as P
from foliospark.functions import scores as S
from foliospark.functions.portable import CHECK, SPARK, Dialect, cases, flag
from foliospark.operators import layout as L
from foliospark.sources import tables as T

Build = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Build, str]] = {}
_HEADED = f"WITH {T.HEADED_SQL}"
_LINES, _BOXES, _SPANS = f"WITH {T.LINES_SQL}", f"WITH {T.BOXES_SQL}", f"WITH {T.SPANS_SQL}"


def _add(name: str, sql: str) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        CATALOG[name] = (build, sql)
        return build

    return keep


def _docs(s: SparkSession, d: str) -> DataFrame:
    return T.spread(T.read(s, d, "documents"), "doc_id")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return T.lines(_docs(s, d))


def _headed(s: SparkSession, d: str) -> DataFrame:
    return T.headed(_lines(s, d))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    return T.boxes(T.read(s, d, "part"))


def _page_features(d: Dialect) -> dict[str, str]:
    """Counts of a page's text that profiles are made of."""
    return {"math": d.count("text", P.FORMULA_SIGNS) + " + " + d.count("text", r"\$"), "pipes": d.count("text", "[|]"), "digits": d.count("text", "[0-9]"), "words": d.words("text")}


_PROFILE = cases(("math > 5", "'formula_dense'"), ("pipes > 6", "'table_heavy'"), ("digits * 4 > words", "'technical_manual'"), ("words < 20", "'mixed_content'"), otherwise="'text_heavy'")
_COMPLEX = "least(1.0, cast(blocks as double) / 40 + 0.4 * least(1.0, cast(math as double) / 10) + 0.3 * least(1.0, cast(pipes as double) / 10))"
_ADVICE = cases(("complexity > 0.7", "'markup'"), ("complexity > 0.4", "'strong'"), otherwise="'fast'")
_PAGES_SQL = f"{_LINES}, q AS (SELECT doc_id, page_num, {', '.join(f'{v} AS {k}' for k, v in _page_features(CHECK).items())} FROM lines), g AS (SELECT doc_id, page_num, count(*) AS blocks, CAST(sum(math) AS BIGINT) AS math, CAST(sum(pipes) AS BIGINT) AS pipes, CAST(sum(digits) AS BIGINT) AS digits, CAST(sum(words) AS BIGINT) AS words FROM q GROUP BY ALL), pages AS (SELECT *, {_PROFILE} AS kind, {_COMPLEX} AS complexity FROM g)"


def page_profiles(lines: DataFrame) -> DataFrame:
    """One row per page: counts, content type and complexity."""
    rows = lines.select("doc_id", "page_num", *[F.expr(v).alias(k) for k, v in _page_features(SPARK).items()])
    grouped = rows.groupBy("doc_id", "page_num").agg(F.count("*").alias("blocks"), *[F.sum(c).alias(c) for c in ("math", "pipes", "digits", "words")])
    return grouped.withColumn("kind", F.expr(_PROFILE)).withColumn("complexity", F.expr(_COMPLEX))


@_add("a30_page_profiles", f"{_PAGES_SQL} SELECT doc_id, page_num, blocks, math, pipes, words, kind, complexity FROM pages")
def _a30(s, d):
    return page_profiles(_lines(s, d)).select("doc_id", "page_num", "blocks", "math", "pipes", "words", "kind", "complexity")


@_add("c14_page_content_type", f"{_PAGES_SQL} SELECT kind, count(*) AS n FROM pages GROUP BY kind")
def _c14(s, d):
    return page_profiles(_lines(s, d)).groupBy("kind").agg(F.count("*").alias("n"))


@_add("c15_page_recommendation", f"{_PAGES_SQL} SELECT doc_id, page_num, complexity, {_ADVICE} AS advice FROM pages")
def _c15(s, d):
    return page_profiles(_lines(s, d)).select("doc_id", "page_num", "complexity", F.expr(_ADVICE).alias("advice"))


@_add("c03b_profile_routing", f"{_PAGES_SQL} SELECT doc_id, page_num, {C.profile_tool(CHECK, 'kind', 'complexity', chr(39) + 'fast' + chr(39))} AS tool FROM pages")
def _c03b(s, d):
    return page_profiles(_lines(s, d)).select("doc_id", "page_num", F.expr(C.profile_tool(SPARK, "kind", "complexity", "'fast'")).alias("tool"))


@_add("c28_strategy_recommendation", f"{_PAGES_SQL} SELECT doc_id, CASE WHEN count_if(kind = 'formula_dense') * 10 > count(*) * 3 OR avg(complexity) > 0.6 THEN 'markup_first' WHEN avg(complexity) > 0.3 THEN 'hybrid' ELSE 'text' END AS strategy FROM pages GROUP BY doc_id")
def _c28(s, d):
    return page_profiles(_lines(s, d)).groupBy("doc_id").agg(F.expr("case when count_if(kind = 'formula_dense') * 10 > count(*) * 3 or avg(complexity) > 0.6 then 'markup_first' when avg(complexity) > 0.3 then 'hybrid' else 'text' end").alias("strategy"))


@_add("a07b_complexity_buckets", f"{_PAGES_SQL} SELECT doc_id, avg(complexity) AS mean, max(complexity) AS most, count_if(complexity < 0.25) AS low, count_if(complexity >= 0.25 AND complexity < 0.5) AS medium, count_if(complexity >= 0.5) AS high FROM pages GROUP BY doc_id")
def _a07b(s, d):
    n = lambda t: F.count_if(F.expr(t))
    return page_profiles(_lines(s, d)).groupBy("doc_id").agg(F.avg("complexity").alias("mean"), F.max("complexity").alias("most"), n("complexity < 0.25").alias("low"), n("complexity >= 0.25 and complexity < 0.5").alias("medium"), n("complexity >= 0.5").alias("high"))


# --- classifiers over sizes, detections and aggregates
_HEAD = "case when score >= 6 then 'h' || cast(least(3, greatest(1, cast(4 - trunc(z) as bigint))) as {t}) else 'paragraph' end"
_ADAPTIVE = "(case when z > 1.5 then 4 when z > 1 then 3 when z > 0.5 then 2 else 0 end) + (case when label = 'title' then 3 else 0 end) + (case when length(text) < 10 then 1 else 0 end)"


@_add("c04_adaptive_heading", f"{_BOXES}, a AS (SELECT doc_id, avg(y1 - y0) AS m, stddev_pop(y1 - y0) AS sd FROM boxes GROUP BY 1), b AS (SELECT page, seq, text, label, CASE WHEN sd > 0 THEN (y1 - y0 - m) / sd ELSE 0 END AS z FROM boxes JOIN a USING (doc_id)) SELECT page, seq, CAST({_ADAPTIVE} AS BIGINT) AS score FROM b")
def _c04(s, d):
    b = _boxes(s, d)
    a = b.groupBy("doc_id").agg(F.avg(F.expr("y1 - y0")).alias("m"), F.stddev_pop(F.expr("y1 - y0")).alias("sd"))
    return b.join(a, "doc_id").withColumn("z", F.expr("case when sd > 0 then (y1 - y0 - m) / sd else 0 end")).select("page", "seq", F.expr(f"cast({_ADAPTIVE} as bigint)").alias("score"))


_LEGACY = "case when words > 12 or length(text) > 90 then 'paragraph' when size > 1.4 * m then 'h1' when size > 1.2 * m then 'h2' else 'paragraph' end"


@_add("c05_legacy_heading", f"{_BOXES}, a AS (SELECT doc_id, avg(y1 - y0) AS m FROM boxes GROUP BY 1), b AS (SELECT page, seq, text, {CHECK.words('text')} AS words, y1 - y0 AS size, m FROM boxes JOIN a USING (doc_id)) SELECT page, seq, {_LEGACY} AS kind FROM b")
def _c05(s, d):
    b = _boxes(s, d).withColumn("size", F.expr("y1 - y0")).withColumn("words", F.expr(SPARK.words("text")))
    return b.join(b.groupBy("doc_id").agg(F.avg("size").alias("m")), "doc_id").select("page", "seq", F.expr(_LEGACY).alias("kind"))


@_add("c07_semantic_role", f"{_BOXES}, r AS (SELECT page, seq, y1 - y0 AS size, avg(y1 - y0) OVER (PARTITION BY doc_id) AS m, dense_rank() OVER (PARTITION BY doc_id ORDER BY y1 - y0 DESC) AS k FROM boxes) SELECT page, seq, CASE WHEN size > 1.2 * m AND k <= 6 THEN 'h' || CAST(k AS VARCHAR) WHEN size < 0.9 * m THEN 'caption' ELSE 'body' END AS role FROM r")
def _c07(s, d):
    b = _boxes(s, d).withColumn("size", F.expr("y1 - y0")).withColumn("m", F.avg("size").over(Window.partitionBy("doc_id"))).withColumn("k", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))
    return b.select("page", "seq", F.expr("case when size > 1.2 * m and k <= 6 then 'h' || cast(k as string) when size < 0.9 * m then 'caption' else 'body' end").alias("role"))


_AREA = "(x1 - x0) * (y1 - y0)"
_LAYOUT = cases(("covered > 0.5 and confidence > 0.6", "'document'"), ("covered > 0.2", "'mixed'"), ("covered > 0.05", "'caption'"), ("regions > 0", "'diagram'"), otherwise="'no_text'")


@_add("c19_ocr_layout", f"{_BOXES}, g AS (SELECT page, sum(CASE WHEN label = 'text' THEN {_AREA} ELSE 0 END) / (612.0::DOUBLE * 792) AS covered, avg(confidence) AS confidence, count_if(label = 'text') AS regions FROM boxes GROUP BY page) SELECT page, {_LAYOUT} AS layout FROM g")
def _c19(s, d):
    g = _boxes(s, d).groupBy("page").agg((F.sum(F.when(F.col("label") == "text", L.area()).otherwise(0.0)) / F.lit(612.0 * 792)).alias("covered"), F.avg("confidence").alias("confidence"), F.count_if(F.col("label") == "text").alias("regions"))
    return g.select("page", F.expr(_LAYOUT).alias("layout"))


_RELEVANCE = cases((f"{_AREA} < 1000", "'low'"), (f"{_AREA} > 4000 and confidence > 0.5", "'high'"), ("label = 'text'", "'skip'"), otherwise="'medium'")


@_add("c17_image_relevance", f"{_BOXES} SELECT page, seq, {_RELEVANCE} AS relevance FROM boxes")
def _c17(s, d):
    return _boxes(s, d).select("page", "seq", F.expr(_RELEVANCE).alias("relevance"))


@_add("a32_classification_statistics", f"{_BOXES} SELECT {_RELEVANCE} AS relevance, count(*) AS n, avg(confidence) AS confidence FROM boxes GROUP BY 1")
def _a32(s, d):
    return _boxes(s, d).groupBy(F.expr(_RELEVANCE).alias("relevance")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


@_add("p35_relevance_filter", f"{_BOXES} SELECT page, seq FROM boxes WHERE {_RELEVANCE} <> 'skip'")
def _p35(s, d):
    return _boxes(s, d).where(F.expr(f"{_RELEVANCE} <> 'skip'")).select("page", "seq")


@_add("c23_detection_class", f"{_BOXES} SELECT page, seq, {C.detection_class('label')} AS class FROM boxes")
def _c23(s, d):
    return _boxes(s, d).select("page", "seq", F.expr(C.detection_class("label")).alias("class"))


@_add("c24_extraction_type", f"SELECT p_partkey, {C.extraction_type(CHECK, 'name')} AS kind FROM (SELECT p_partkey, 'page_' || CASE p_partkey % 4 WHEN 0 THEN 'visual' WHEN 1 THEN 'table' WHEN 2 THEN 'equation' ELSE 'img' END || '_1.png' AS name FROM part)")
def _c24(s, d):
    name = "'page_' || case p_partkey % 4 when 0 then 'visual' when 1 then 'table' when 2 then 'equation' else 'img' end || '_1.png'"
    return T.read(s, d, "part").select("p_partkey", F.expr(name).alias("name")).select("p_partkey", F.expr(C.extraction_type(SPARK, "name")).alias("kind"))


@_add("c26_type_upgrade", f"{_BOXES}, t AS (SELECT page, max(confidence) AS best FROM boxes WHERE label = 'title' GROUP BY page) SELECT b.page, b.seq, CASE WHEN b.label = 'text' AND t.best > 0.7 THEN 'heading' ELSE b.label END AS kind FROM boxes b LEFT JOIN t ON b.page = t.page")
def _c26(s, d):
    b = _boxes(s, d)
    best = b.where("label = 'title'").groupBy("page").agg(F.max("confidence").alias("best"))
    return b.join(best, "page", "left").select("page", "seq", F.when((F.col("label") == "text") & (F.col("best") > 0.7), "heading").otherwise(F.col("label")).alias("kind"))


@_add("c33_document_parts", f"{_LINES}, p AS (SELECT doc_id, page_num, bool_or({flag(P.content_start(CHECK, 'text'))}) AS starts, bool_or({flag(P.back_matter(CHECK, 'text'))}) AS back FROM lines GROUP BY ALL), f AS (SELECT *, min(CASE WHEN starts THEN page_num END) OVER (PARTITION BY doc_id) AS st FROM p) SELECT doc_id, page_num, CASE WHEN st IS NOT NULL AND page_num < st THEN 'front' WHEN back THEN 'back' ELSE 'main' END AS part FROM f")
def _c33(s, d):
    p = _lines(s, d).groupBy("doc_id", "page_num").agg(F.bool_or(F.expr(flag(P.content_start(SPARK, "text")))).alias("starts"), F.bool_or(F.expr(flag(P.back_matter(SPARK, "text")))).alias("back"))
    first = F.min(F.when(F.col("starts"), F.col("page_num"))).over(Window.partitionBy("doc_id"))
    return p.withColumn("st", first).select("doc_id", "page_num", F.expr("case when st is not null and page_num < st then 'front' when back then 'back' else 'main' end").alias("part"))


_FAMILY = {"scientific": ("theorem", "equation"), "technical": ("system", "data"), "legal": ("license", "agreement")}


def _weights(d: Dialect) -> dict[str, str]:
    return {k: f"3 * {d.count('lower(text)', w[0])} + 2 * {d.count('lower(text)', w[1])}" for k, w in _FAMILY.items()}


_WEIGHTED = "CASE WHEN scientific + technical + legal = 0 THEN 'general' WHEN scientific >= technical AND scientific >= legal THEN 'scientific' WHEN technical >= legal THEN 'technical' ELSE 'legal' END"


@_add("c12_weighted_classification", f"WITH w AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _weights(CHECK).items())} FROM documents) SELECT doc_id, {_WEIGHTED} AS primary_type, greatest(scientific, technical, legal) / greatest(1, scientific + technical + legal) AS confidence FROM w")
def _c12(s, d):
    w = _docs(s, d).select("doc_id", *[F.expr(v).alias(k) for k, v in _weights(SPARK).items()])
    return w.select("doc_id", F.expr(_WEIGHTED).alias("primary_type"), F.expr("greatest(scientific, technical, legal) / greatest(1, scientific + technical + legal)").alias("confidence"))


# --- joins
@_add("j19_section_batch", f"{_LINES}, b AS (SELECT doc_id, page_num, (page_num - 1) // 5 + 1 AS batch FROM lines GROUP BY ALL) SELECT l.doc_id, l.seq, b.batch FROM lines l JOIN b ON l.doc_id = b.doc_id AND l.page_num = b.page_num")
def _j19(s, d):
    return _lines(s, d).select("doc_id", "seq", F.expr("(page_num - 1) div 5 + 1").alias("batch"))


@_add("j22_visuals_before_blocks", f"{_BOXES} SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN label IN ('figure','table') THEN 0 ELSE 1 END, seq) AS position FROM boxes")
def _j22(s, d):
    order = Window.partitionBy("page").orderBy(F.when(F.col("label").isin("figure", "table"), 0).otherwise(1), "seq")
    return _boxes(s, d).select("page", "seq", F.row_number().over(order).cast("long").alias("position"))


@_add("j24_translated_containment", "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _j24(s, d):
    from foliospark.operators.similarity import containing

    return containing(_docs(s, d), T.read(s, d, "benchmark").select("item_id", F.col("text").alias("part")), "part").select("doc_id", "item_id").distinct()


@_add("j25_image_ocr_by_name", "WITH o AS (SELECT p_brand AS name, max(p_name) AS ocr FROM part GROUP BY 1) SELECT p_partkey, o.ocr, o.ocr IS NOT NULL AND length(o.ocr) > 8 AS needed FROM part p LEFT JOIN o ON p.p_brand = o.name")
def _j25(s, d):
    p = T.read(s, d, "part")
    o = p.groupBy(F.col("p_brand").alias("name")).agg(F.max("p_name").alias("ocr"))
    return p.join(o, p.p_brand == o.name, "left").select("p_partkey", "ocr", (F.col("ocr").isNotNull() & (F.length("ocr") > 8)).alias("needed"))


# --- aggregations
@_add("a04_heading_hierarchy", f"{_BOXES}, g AS (SELECT doc_id, CAST(y1 - y0 AS BIGINT) AS size, count(*) AS n FROM boxes WHERE label = 'title' GROUP BY ALL) SELECT doc_id, size, n, least(1.0, n / 5.0)::DOUBLE AS confidence, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level FROM g")
def _a04(s, d):
    g = _boxes(s, d).where("label = 'title'").groupBy("doc_id", F.expr("cast(y1 - y0 as bigint)").alias("size")).agg(F.count("*").alias("n"))
    return g.select("doc_id", "size", "n", F.least(F.lit(1.0), F.col("n") / F.lit(5.0)).alias("confidence"), F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))).cast("long").alias("level"))


@_add("a21_success_ratios", "SELECT user_id, count(*) AS n, count_if(event_type <> 'error') / count(*) AS success FROM events GROUP BY user_id")
def _a21(s, d):
    return T.read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.count_if(F.col("event_type") != "error") / F.count("*")).alias("success"))


@_add("a22_data_flow_audit", f"{_LINES} SELECT 'all' AS stage, count(*) AS n FROM lines UNION ALL SELECT 'translatable', count(*) FROM lines WHERE block_type IN ('h1','h2','h3','paragraph','list_item','footnote','caption') UNION ALL SELECT 'kept', count(*) FROM lines WHERE NOT {flag(P.skip_content(CHECK, 'text'))}")
def _a22(s, d):
    rows = _lines(s, d).agg(F.count("*").alias("all"), F.count_if(F.expr("block_type in ('h1','h2','h3','paragraph','list_item','footnote','caption')")).alias("translatable"), F.count_if(F.expr(f"not {flag(P.skip_content(SPARK, 'text'))}")).alias("kept"))
    return rows.select(F.expr("stack(3, 'all', `all`, 'translatable', translatable, 'kept', kept) as (stage, n)"))


@_add("a27_grouping_report", f"{_LINES} SELECT doc_id, count(*) AS items, CAST(ceil(count(*) / 8.0) AS BIGINT) AS groups, (count(*) - ceil(count(*) / 8.0)) * 100 / count(*) AS reduction FROM lines GROUP BY doc_id")
def _a27(s, d):
    g = _lines(s, d).groupBy("doc_id").agg(F.count("*").alias("items"))
    return g.select("doc_id", "items", F.ceil(F.col("items") / 8).cast("long").alias("groups"), ((F.col("items") - F.ceil(F.col("items") / 8)) * 100 / F.col("items")).cast("double").alias("reduction"))


@_add("a28_visual_rollup", f"{_BOXES} SELECT page, seq, label, row_number() OVER (PARTITION BY page ORDER BY CASE label WHEN 'figure' THEN 3 WHEN 'table' THEN 2 ELSE 1 END DESC, seq) AS position FROM boxes WHERE label IN ('figure','table','title')")
def _a28(s, d):
    rank = F.expr("case label when 'figure' then 3 when 'table' then 2 else 1 end")
    return _boxes(s, d).where("label in ('figure','table','title')").select("page", "seq", "label", F.row_number().over(Window.partitionBy("page").orderBy(rank.desc(), "seq")).cast("long").alias("position"))


@_add("a31_session_statistics", "SELECT event_id, sum(value) OVER w AS total, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) OVER w AS success FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _a31(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return T.read(s, d, "events").select("event_id", F.sum("value").over(w).alias("total"), F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)).over(w).alias("success"))


_ENTRY = "concat('1.', seq, ' ', title, ' ..... ', page_num * 2)"


@_add("a33_toc_analysis", f"{_HEADED}, t AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_ENTRY}, '^[0-9]+([.][0-9]+)*[.]?\\s+', ''), '[ .]*[0-9]*$', '')) AS title, CAST(nullif(regexp_extract({_ENTRY}, '\\s([0-9]{{1,4}})$', 1), '') AS BIGINT) AS page FROM headed WHERE block_type IN ('h1', 'h2')) SELECT doc_id, count(*) AS entries, string_agg(title || '=' || CAST(page AS VARCHAR), ';' ORDER BY title, page) AS pages FROM t WHERE page IS NOT NULL GROUP BY doc_id")
def _a33(s, d):
    """Entries of a table of contents, as lines of number, title, leaders and page, parsed and gathered."""
    entries = _headed(s, d).where("block_type in ('h1', 'h2')").select("doc_id", F.expr(_ENTRY).alias("text"))
    t = entries.select("doc_id", F.expr(S.toc_title(SPARK, "text")).alias("title"), F.expr(S.toc_page(SPARK, "text")).alias("page")).where("page is not null")
    return t.groupBy("doc_id").agg(F.count("*").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "page"))), lambda x: F.concat(x["title"], F.lit("="), x["page"].cast("string"))), ";").alias("pages"))


@_add("a34_output_validation", "SELECT source, count(*) AS n, concat_ws(',', CASE WHEN count_if(text IS NULL OR text = '') > 0 THEN 'empty' END, CASE WHEN max(length(text)) > 50000 THEN 'long' END) AS issues FROM documents GROUP BY source")
def _a34(s, d):
    return _docs(s, d).groupBy("source").agg(F.count("*").alias("n"), F.concat_ws(",", F.when(F.count_if(F.expr("text is null or text = ''")) > 0, "empty"), F.when(F.max(F.length("text")) > 50000, "long")).alias("issues"))


# --- ordered operators
_MARK = "seq % 7 = 3"


@_add("w04_page_counter", f"{_LINES} SELECT doc_id, seq, CAST(1 + sum(CASE WHEN {_MARK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS page FROM lines")
def _w04(s, d):
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return _lines(s, d).select("doc_id", "seq", (F.sum(F.when(F.expr(_MARK), 1).otherwise(0)).over(w) + 1).cast("long").alias("page"))


@_add("w10_images_by_position", f"{_BOXES} SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN label = 'figure' AND seq % 2 = 0 THEN NULL ELSE y0 END NULLS LAST, seq) AS position FROM boxes")
def _w10(s, d):
    order = F.when((F.col("label") == "figure") & (F.col("seq") % 2 == 0), None).otherwise(F.col("y0")).asc_nulls_last()
    return _boxes(s, d).select("page", "seq", F.row_number().over(Window.partitionBy("page").orderBy(order, "seq")).cast("long").alias("position"))


@_add("w13_priority_batches", f"{_LINES}, p AS (SELECT doc_id, seq, length(text) AS n, {C.role_priority(CHECK, 'block_type')} AS priority FROM lines) SELECT doc_id, seq, CAST(priority AS BIGINT) AS priority, CAST(sum(n) OVER (PARTITION BY doc_id, priority ORDER BY seq) // 15000 AS BIGINT) AS batch FROM p")
def _w13(s, d):
    p = _lines(s, d).select("doc_id", "seq", F.length("text").cast("long").alias("n"), F.expr(C.role_priority(SPARK, "block_type")).cast("long").alias("priority"))
    w = Window.partitionBy("doc_id", "priority").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("t", F.sum("n").over(w)).select("doc_id", "seq", "priority", F.expr("t div 15000").alias("batch"))


@_add("w16_list_islands", f"{_LINES}, r AS (SELECT *, sum(CASE WHEN block_type = 'list_item' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM lines) SELECT doc_id, CAST(run AS BIGINT) AS run, min(seq) AS seq, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS size FROM r WHERE run > 0 GROUP BY doc_id, run")
def _w16(s, d):
    from foliospark.operators.grouping import island

    r = _lines(s, d).withColumn("run", island(F.col("block_type") == "list_item")).where("run > 0")
    return r.groupBy("doc_id", F.col("run").cast("long").alias("run")).agg(F.min("seq").alias("seq"), F.count("*").alias("lines"), F.sum(F.length("text")).alias("size"))


@_add("w19_table_rows", f"{_BOXES}, g AS (SELECT page, seq, y0, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, seq) > 50 THEN 1 ELSE 0 END AS c FROM boxes) SELECT page, seq, CAST(sum(c) OVER (PARTITION BY page ORDER BY y0, seq) AS BIGINT) AS table_id FROM g")
def _w19(s, d):
    w = Window.partitionBy("page").orderBy("y0", "seq")
    g = _boxes(s, d).withColumn("c", F.when(F.col("y0") - F.lag("y0").over(w) > 50, 1).otherwise(0))
    return g.select("page", "seq", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("table_id"))


@_add("w20_footnote_split", f"{_LINES} SELECT doc_id, count_if({flag(CHECK.any_like('text', P.FOOTNOTE))}) AS footnotes, md5(coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (NOT {flag(CHECK.any_like('text', P.FOOTNOTE))}), '')) AS main_md5 FROM lines GROUP BY doc_id")
def _w20(s, d):
    rows = _lines(s, d).withColumn("note", F.expr(flag(SPARK.any_like("text", P.FOOTNOTE))))
    kept = F.collect_list(F.when(~F.col("note"), F.struct("seq", "text")))
    return rows.groupBy("doc_id").agg(F.count_if("note").alias("footnotes"), F.md5(F.array_join(F.transform(F.array_sort(kept), lambda x: x["text"]), "\n")).alias("main_md5"))


@_add("w22_batch_stitch", f"{_LINES}, b AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY seq) AS t FROM lines GROUP BY ALL), x AS (SELECT doc_id, page_num, t, coalesce(NOT regexp_matches(lag(t) OVER (PARTITION BY doc_id ORDER BY page_num), '[.!?]$'), false) AS joined FROM b) SELECT doc_id, md5(string_agg(CASE WHEN page_num = 1 THEN '' WHEN joined THEN chr(10) ELSE chr(10) || chr(10) END || t, '' ORDER BY page_num)) AS md5 FROM x GROUP BY doc_id")
def _w22(s, d):
    b = _lines(s, d).groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("t"))
    joined = F.coalesce(~F.lag("t").over(Window.partitionBy("doc_id").orderBy("page_num")).rlike("[.!?]$"), F.lit(False))
    part = F.concat(F.when(F.col("page_num") == 1, "").when(F.col("joined"), "\n").otherwise("\n\n"), F.col("t"))
    return b.withColumn("joined", joined).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", part.alias("p")))), lambda x: x["p"]), "")).alias("md5"))


@_add("w25_toc_rendering", f"{_HEADED} SELECT doc_id, string_agg(text, ';' ORDER BY seq) AS toc FROM headed WHERE block_type IN ('h1','h2','h3') GROUP BY doc_id")
def _w25(s, d):
    return _headed(s, d).where("block_type in ('h1','h2','h3')").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), ";").alias("toc"))


# --- top-k, sets, functions
@_add("t06_best_page_set", f"{_LINES}, g AS (SELECT doc_id, page_num, count_if({flag(P.toc_line(CHECK, 'text'))}) AS n FROM lines GROUP BY ALL) SELECT doc_id, page_num, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page_num) AS r FROM g) WHERE r = 1")
def _t06(s, d):
    g = _lines(s, d).groupBy("doc_id", "page_num").agg(F.count_if(F.expr(flag(P.toc_line(SPARK, "text")))).alias("n"))
    return g.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("page_num")).alias("p"))).alias("b")).select("doc_id", (-F.col("b.p")).alias("page_num"), F.col("b.n").alias("n"))


@_add("t07_best_correction", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS r FROM events) WHERE r = 1")
def _t07(s, d):
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "ts", "event_id")
    return T.read(s, d, "events").withColumn("r", F.row_number().over(best)).where("r = 1").select("user_id", "event_id")


@_add("u06_heading_dedup", f"{_HEADED}, h AS (SELECT doc_id, seq, lower({CHECK.replace('title', '_Toc_Bookmark_[0-9]+', '')}) AS k FROM headed WHERE block_type IN ('h1','h2','h3','caption')) SELECT doc_id, min(seq) AS seq FROM h GROUP BY doc_id, k")
def _u06(s, d):
    rows = _headed(s, d).where("block_type in ('h1','h2','h3','caption')")
    return rows.groupBy("doc_id", F.lower(F.expr(SPARK.replace("title", "_Toc_Bookmark_[0-9]+", ""))).alias("k")).agg(F.min("seq").alias("seq")).select("doc_id", "seq")


@_add("u07_competing_extractions", f"{_BOXES}, o AS (SELECT page, seq, label, x0 + 6 AS x0, y0 + 4 AS y0, x1 + 6 AS x1, y1 + 4 AS y1 FROM boxes WHERE seq % 3 <> 1) SELECT a.page, a.seq AS a, b.seq AS b FROM boxes a JOIN o b ON a.page = b.page AND a.label = b.label WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.2 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))")
def _u07(s, d):
    """Boxes of one reader with those of another, which sees some of them a little off, that cover a fifth of the smaller one."""
    one = _boxes(s, d)
    other = one.where("seq % 3 <> 1").selectExpr("page", "seq", "label", "x0 + 6 as x0", "y0 + 4 as y0", "x1 + 6 as x1", "y1 + 4 as y1")
    a, b = one.alias("a"), other.alias("b")
    size = lambda n: f"({n}.x1 - {n}.x0) * ({n}.y1 - {n}.y0)"
    share = F.expr(f"greatest(0D, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0D, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.2 * least({size('a')}, {size('b')})")
    return a.join(b, F.expr("a.page = b.page and a.label = b.label")).where(share).select(F.col("a.page").alias("page"), F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))


@_add("f19_box_math", f"{_BOXES} SELECT page, seq, {_AREA} AS area, (x0 + x1) / 2 / 612 AS xc, (y0 + y1) / 2 / 792 AS yc, (x1 - x0) / 612 AS w, (y1 - y0) / 792 AS h FROM boxes")
def _f19(s, d):
    return _boxes(s, d).select("page", "seq", L.area().alias("area"), *[F.expr(e).alias(n) for n, e in (("xc", "(x0 + x1) / 2 / 612"), ("yc", "(y0 + y1) / 2 / 792"), ("w", "(x1 - x0) / 612"), ("h", "(y1 - y0) / 792"))])


@_add("f21_glossary_apply", "SELECT p_partkey, replace(replace(p_name, 'small', 'klein'), 'red', 'rot') AS name FROM part")
def _f21(s, d):
    fold = "aggregate(array(struct('small' as t, 'klein' as r), struct('red' as t, 'rot' as r)), p_name, (a, x) -> replace(a, x.t, x.r))"
    return T.read(s, d, "part").select("p_partkey", F.expr(fold).alias("name"))


@_add("f14_mask_round_trip", "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL")
def _f14(s, d):
    masked = "replace(replace(text, '$', '\u0001D\u0001'), '|', '\u0001P\u0001')"
    return _docs(s, d).where("text is not null").select("doc_id", (F.expr(f"replace(replace({masked}, '\u0001P\u0001', '|'), '\u0001D\u0001', '$')") == F.col("text")).alias("same"))


@_add("f15_group_combine_split", f"{_LINES} SELECT doc_id, count(*) AS parts FROM lines GROUP BY doc_id")
def _f15(s, d):
    g = _lines(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "%%%%ITEM_BREAK%%%%").alias("j"))
    return g.select("doc_id", F.size(F.split("j", "%%%%ITEM_BREAK%%%%")).cast("long").alias("parts"))


@_add("f25_document_title", f"{_LINES}, f AS (SELECT doc_id, arg_min(text, seq) AS t FROM lines WHERE seq < 3 AND length(trim(text)) BETWEEN 1 AND 199 GROUP BY doc_id) SELECT d.doc_id, coalesce(f.t, 'Untitled Document') AS title FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id")
def _f25(s, d):
    first = _lines(s, d).where("seq < 3 and length(trim(text)) between 1 and 199").groupBy("doc_id").agg(F.min_by("text", "seq").alias("t"))
    return _docs(s, d).join(first, "doc_id", "left").select("doc_id", F.coalesce("t", F.lit("Untitled Document")).alias("title"))


@_add("f35_model_serialisation", f"{_LINES} SELECT doc_id, seq, length(block_type) + length(text) AS n FROM lines")
def _f35(s, d):
    packed = _lines(s, d).select("doc_id", "seq", F.to_json(F.struct("block_type", "text")).alias("j"))
    back = F.from_json("j", "block_type string, text string")
    return packed.select("doc_id", "seq", (F.length(back["block_type"]) + F.length(back["text"])).cast("long").alias("n"))


@_add("o04_two_tier_cache", "WITH m AS (SELECT source, sha256(text) AS k, min(doc_id) AS i FROM documents GROUP BY ALL), p AS (SELECT sha256(text) AS k, min(doc_id) AS i FROM documents GROUP BY ALL) SELECT d.doc_id, CASE WHEN m.i < d.doc_id THEN 'memory' WHEN p.i < d.doc_id THEN 'persistent' ELSE 'call' END AS tier FROM documents d LEFT JOIN m ON sha256(d.text) = m.k AND d.source = m.source LEFT JOIN p ON sha256(d.text) = p.k")
def _o04(s, d):
    """A text seen before in its source comes from memory, one seen anywhere before from the persistent cache."""
    rows = _docs(s, d).select("doc_id", "source", F.sha2("text", 256).alias("k"))
    memory, kept = rows.groupBy("source", "k").agg(F.min("doc_id").alias("m")), rows.groupBy("k").agg(F.min("doc_id").alias("p"))
    tier = F.when(F.col("m") < F.col("doc_id"), "memory").when(F.col("p") < F.col("doc_id"), "persistent").otherwise("call")
    return rows.join(memory, ["source", "k"], "left").join(kept, "k", "left").select("doc_id", tier.alias("tier"))


@_add("s22_trace_export", f"{_SPANS} SELECT span_id, trace_id, operation FROM spans")
def _s22(s, d):
    """Spans as JSON lines, read back; no trace is gathered in one row."""
    rows = T.spans(T.read(s, d, "events")).select("span_id", F.to_json(F.struct("trace_id", "operation", "duration_ms")).alias("j"))
    return rows.select("span_id", F.get_json_object("j", "$.trace_id").cast("long").alias("trace_id"), F.get_json_object("j", "$.operation").alias("operation"))
