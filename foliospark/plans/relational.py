"""Queries of joins, aggregations, ordered operators, top-k, sets and stream analogues, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import classify as C
from foliospark.functions import scores as S
from foliospark.functions.portable import CHECK, SPARK
from foliospark.operators import grouping as G
from foliospark.operators import layout as L
from foliospark.sources import tables as T

Build = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Build, str]] = {}


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


def _spans(s: SparkSession, d: str) -> DataFrame:
    return T.spans(T.read(s, d, "events"))


_HEADED = f"WITH {T.HEADED_SQL}"
_LINES, _BOXES, _SPANS = f"WITH {T.LINES_SQL}", f"WITH {T.BOXES_SQL}", f"WITH {T.SPANS_SQL}"
_TOOL = C.routing_tool(SPARK, "text", "importance", "low")
_TOOL_SQL = C.routing_tool(CHECK, "text", "importance")
# Cost for 1,000 characters or an item of each tool, in units of a hundred-thousandth.
_RATE = "case tool when 'fast' then 15 when 'strong' then 150 when 'markup' then 100 else 0 end"


@_add("flagship_block_routing", f"""{_LINES}, i AS (SELECT doc_id, text, {C.importance(CHECK, "text", "block_type", "page_num")} AS importance FROM lines), r AS (SELECT doc_id, length(text) AS n, {_TOOL_SQL} AS tool FROM i)
SELECT doc_id, tool, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(n * {_RATE}) AS BIGINT) AS cost_units FROM r GROUP BY doc_id, tool""")  # fmt: skip
def flagship(s: SparkSession, d: str) -> DataFrame:
    """Block profile and routing cost of each document."""
    rows = T.weighed(_lines(s, d))
    routed = rows.select("doc_id", F.length("text").cast("long").alias("n"), F.expr(_TOOL).alias("tool"))
    return routed.groupBy("doc_id", "tool").agg(F.count("*").alias("blocks"), F.sum("n").alias("chars"), F.sum(F.expr(f"n * {_RATE}")).alias("cost_units"))


# --- scans, filters, projections over rows
@_add("s04_element_scan", f"{_LINES} SELECT doc_id, page_num, count(*) AS spans, sha256(string_agg(text, chr(10) ORDER BY seq)) AS text_sha256, bool_or(block_type IN ('h1','h2','h3')) AS has_heading FROM lines GROUP BY doc_id, page_num")
def _s04(s, d):
    return _lines(s, d).groupBy("doc_id", "page_num").agg(F.count("*").alias("spans"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n"), 256).alias("text_sha256"), F.bool_or(F.col("block_type").isin("h1", "h2", "h3")).alias("has_heading"))


@_add("s05_primary_line", f"{_LINES} SELECT doc_id, page_num, arg_max(seq, length(text) * 100000 - seq) AS seq FROM lines GROUP BY doc_id, page_num")
def _s05(s, d):
    return _lines(s, d).groupBy("doc_id", "page_num").agg(F.max_by("seq", F.struct(F.length("text"), -F.col("seq"))).alias("seq"))


@_add("s08_page_ranges", "SELECT doc_id, b * 5 AS first_page, least(b * 5 + 4, n - 1) AS last_page, b + 1 AS batch FROM (SELECT doc_id, n, unnest(range((n + 4) // 5)) AS b FROM (SELECT doc_id, length(text) // 500 + 1 AS n FROM documents WHERE text IS NOT NULL))")
def _s08(s, d):
    n = _docs(s, d).where("text is not null").select("doc_id", F.expr("cast(length(text) div 500 + 1 as bigint)").alias("n"))
    return n.select("doc_id", "n", F.explode(F.expr("sequence(0L, (n + 4) div 5 - 1)")).alias("b")).select("doc_id", (F.col("b") * 5).alias("first_page"), F.least(F.col("b") * 5 + 4, F.col("n") - 1).alias("last_page"), (F.col("b") + 1).alias("batch"))


@_add("s09_first_reader", "SELECT p.page_id, coalesce(nullif(regexp_extract(p.html, '<h1>([^<]*)', 1), ''), nullif(regexp_extract(p.html, '<title>([^<]*)', 1), ''), p.url) AS title FROM pages p")
def _s09(s, d):
    part = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return T.read(s, d, "pages").select("page_id", F.coalesce(part("<h1>([^<]*)"), part("<title>([^<]*)"), "url").alias("title"))


@_add("s16_html_sink", f"{_LINES} SELECT doc_id, sha256(string_agg({S.html_block(CHECK, 'block_type', 'text')}, chr(10) ORDER BY seq)) AS html_sha256, count(*) AS blocks FROM lines GROUP BY doc_id")
def _s16(s, d):
    rows = _lines(s, d).select("doc_id", F.struct("seq", F.expr(S.html_block(SPARK, "block_type", "text")).alias("h")).alias("x"))
    return rows.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "\n"), 256).alias("html_sha256"), F.count("*").alias("blocks"))


@_add("s21_failure_quarantine", f"{_SPANS} SELECT trace_id, count(*) AS failures FROM spans WHERE operation = 'error' GROUP BY trace_id HAVING count(*) >= 3")
def _s21(s, d):
    return _spans(s, d).where("operation = 'error'").groupBy("trace_id").agg(F.count("*").alias("failures")).where("failures >= 3")


@_add("s23_label_lines", f"{_BOXES} SELECT page, string_agg(concat(CAST(CASE label WHEN 'text' THEN 0 WHEN 'title' THEN 1 WHEN 'table' THEN 3 ELSE 4 END AS VARCHAR), ' ', CAST(CAST(floor((x0 + x1) * 500 / 612) AS BIGINT) AS VARCHAR), ' ', CAST(CAST(floor((y0 + y1) * 500 / 792) AS BIGINT) AS VARCHAR)), ';' ORDER BY seq) AS labels FROM boxes GROUP BY page")
def _s23(s, d):
    line = F.concat_ws(" ", F.expr("case label when 'text' then 0 when 'title' then 1 when 'table' then 3 else 4 end").cast("string"), F.floor((F.col("x0") + F.col("x1")) * 500 / 612).cast("string"), F.floor((F.col("y0") + F.col("y1")) * 500 / 792).cast("string"))
    return _boxes(s, d).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), ";").alias("labels"))


@_add("p01_type_filter", f"{_LINES} SELECT doc_id, seq FROM lines WHERE block_type = 'list_item'")
def _p01(s, d):
    return _lines(s, d).where("block_type = 'list_item'").select("doc_id", "seq")


@_add("p02_page_filter", f"{_LINES} SELECT doc_id, seq, text FROM lines WHERE page_num = 2")
def _p02(s, d):
    return _lines(s, d).where("page_num = 2").select("doc_id", "seq", "text")


@_add("p04_headings", f"{_HEADED} SELECT doc_id, page_num, seq, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, seq) AS ordinal FROM headed WHERE block_type IN ('h1','h2','h3')")
def _p04(s, d):
    return _headed(s, d).where("block_type in ('h1','h2','h3')").select("doc_id", "page_num", "seq", "text", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "seq")).cast("long").alias("ordinal"))


@_add("p10_detection_filter", f"{_BOXES} SELECT page, seq FROM boxes WHERE (x1 - x0) * (y1 - y0) BETWEEN 100 AND 0.8 * 612 * 792 AND label IN ('figure','table') AND confidence >= 0.5")
def _p10(s, d):
    return _boxes(s, d).where(L.area().between(100, 0.8 * 612 * 792) & F.col("label").isin("figure", "table") & (F.col("confidence") >= 0.5)).select("page", "seq")


@_add("p12_ocr_regions", f"{_BOXES} SELECT page, count(*) AS regions, sum((x1 - x0) * (y1 - y0)) AS covered, avg(confidence) AS confidence FROM boxes WHERE confidence > 0.3 AND label = 'text' GROUP BY page")
def _p12(s, d):
    return _boxes(s, d).where("confidence > 0.3 and label = 'text'").groupBy("page").agg(F.count("*").alias("regions"), F.sum(L.area()).alias("covered"), F.avg("confidence").alias("confidence"))


@_add("p28_visual_pages", f"{_BOXES} SELECT page, count_if(label = 'figure') AS figures, sum(CASE WHEN label = 'text' THEN (x1 - x0) * (y1 - y0) ELSE 0 END) / (612.0::DOUBLE * 792) AS coverage, count_if(label = 'figure') >= 3 OR sum(CASE WHEN label = 'text' THEN (x1 - x0) * (y1 - y0) ELSE 0 END) / (612.0::DOUBLE * 792) < 0.2 AS visual FROM boxes GROUP BY page")
def _p28(s, d):
    text = F.sum(F.when(F.col("label") == "text", L.area()).otherwise(0.0)) / F.lit(612.0 * 792)
    return _boxes(s, d).groupBy("page").agg(F.count_if(F.col("label") == "figure").alias("figures"), text.alias("coverage")).withColumn("visual", (F.col("figures") >= 3) | (F.col("coverage") < 0.2))


@_add("p30_legacy_projection", f"{_LINES} SELECT doc_id, seq, CASE WHEN block_type IN ('h1','h2','h3') THEN 'heading' WHEN block_type IN ('list_item','caption','equation','code_block') THEN block_type ELSE 'paragraph' END AS kind, CASE block_type WHEN 'h1' THEN 1 WHEN 'h2' THEN 2 WHEN 'h3' THEN 3 END::BIGINT AS level FROM lines WHERE block_type <> 'metadata'")
def _p30(s, d):
    kind = F.when(F.col("block_type").isin("h1", "h2", "h3"), "heading").when(F.col("block_type").isin("list_item", "caption", "equation", "code_block"), F.col("block_type")).otherwise("paragraph")
    return _lines(s, d).where("block_type <> 'metadata'").select("doc_id", "seq", kind.alias("kind"), F.expr("cast(case block_type when 'h1' then 1 when 'h2' then 2 when 'h3' then 3 end as bigint)").alias("level"))


# --- joins
@_add("j01_reattach_composite", f"{_LINES}, t AS (SELECT doc_id, seq, max('[xx] ' || text) AS tr FROM lines WHERE block_type = 'paragraph' GROUP BY doc_id, seq) SELECT l.doc_id, l.seq, coalesce(t.tr, l.text) AS text FROM lines l LEFT JOIN t ON l.doc_id = t.doc_id AND l.seq = t.seq")
def _j01(s, d):
    rows = _lines(s, d)
    done = rows.where("block_type = 'paragraph'").groupBy("doc_id", "seq").agg(F.max(F.concat(F.lit("[xx] "), "text")).alias("tr"))
    return rows.join(done, ["doc_id", "seq"], "left").select("doc_id", "seq", F.coalesce("tr", "text").alias("text"))


@_add("j02_reattach_block_id", "SELECT c.conv_id, c.turn, coalesce(t.tr, c.text) AS text FROM conversations c LEFT JOIN (SELECT md5(text) AS k, min('[xx] ' || text) AS tr FROM conversations WHERE role = 'user' GROUP BY 1) t ON md5(c.text) = t.k")
def _j02(s, d):
    rows = T.read(s, d, "conversations").withColumn("k", F.md5("text"))
    done = rows.where("role = 'user'").groupBy("k").agg(F.min(F.concat(F.lit("[xx] "), "text")).alias("tr"))
    return rows.join(done, "k", "left").select("conv_id", "turn", F.coalesce("tr", "text").alias("text"))


@_add("j04_first_visual", f"{_BOXES} SELECT t.page, t.seq, v.vseq FROM boxes t LEFT JOIN (SELECT page, min(seq) AS vseq FROM boxes WHERE label = 'figure' GROUP BY page) v ON t.page = v.page WHERE t.label = 'title'")
def _j04(s, d):
    b = _boxes(s, d)
    return b.where("label = 'title'").join(b.where("label = 'figure'").groupBy("page").agg(F.min("seq").alias("vseq")), "page", "left").select("page", "seq", "vseq")


@_add("j04b_best_detection", f"{_BOXES} SELECT t.page, t.seq, v.vseq FROM boxes t LEFT JOIN (SELECT page, arg_max(seq, confidence * 1000 - seq / 100.0) AS vseq FROM boxes WHERE label IN ('figure','table') GROUP BY page) v ON t.page = v.page WHERE t.label = 'title'")
def _j04b(s, d):
    b = _boxes(s, d)
    best = b.where("label in ('figure','table')").groupBy("page").agg(F.max_by("seq", F.struct("confidence", -F.col("seq"))).alias("vseq"))
    return b.where("label = 'title'").join(best, "page", "left").select("page", "seq", "vseq")


@_add("j05_page_profile", f"{_LINES}, p AS (SELECT doc_id, page_num, count(*) AS n FROM lines GROUP BY ALL) SELECT l.doc_id, l.seq, p.n AS page_lines FROM lines l JOIN p USING (doc_id, page_num)")
def _j05(s, d):
    rows = _lines(s, d)
    return rows.join(rows.groupBy("doc_id", "page_num").agg(F.count("*").alias("page_lines")), ["doc_id", "page_num"]).select("doc_id", "seq", "page_lines")


@_add("j06_page_context_semi", f"{_BOXES} SELECT page, seq FROM boxes b WHERE label = 'figure' AND EXISTS (SELECT 1 FROM boxes t WHERE t.page = b.page AND t.label = 'text' AND contains(t.text, 'red'))")
def _j06(s, d):
    b = _boxes(s, d)
    return b.where("label = 'figure'").join(b.where("label = 'text' and contains(text, 'red')").select("page"), "page", "left_semi").select("page", "seq")


@_add("j07_toc_title_contains", f"{_HEADED} SELECT l.doc_id, l.seq, min(t.seq) AS entry FROM headed l JOIN headed t ON l.doc_id = t.doc_id AND t.block_type IN ('h1', 'h2') AND t.title <> '' AND contains(lower(l.text), lower(t.title)) GROUP BY l.doc_id, l.seq")
def _j07(s, d):
    """Blocks with the first entry of their document's contents whose title they hold; a document bounds the pairs."""
    rows = _headed(s, d)
    entries = rows.where("block_type in ('h1', 'h2') and title <> ''").select("doc_id", F.col("seq").alias("entry"), F.lower("title").alias("title"))
    held = rows.select("doc_id", "seq", F.lower("text").alias("low")).join(entries, "doc_id").where(F.contains("low", "title"))
    return held.groupBy("doc_id", "seq").agg(F.min("entry").alias("entry"))


@_add("j08_nearest_text", f"{_BOXES}, c AS (SELECT page, seq, label, (y0 + y1) / 2 AS cy FROM boxes), n AS (SELECT f.page, f.seq AS figure_seq, t.seq AS text_seq, abs(f.cy - t.cy) AS distance, row_number() OVER (PARTITION BY f.page, f.seq ORDER BY abs(f.cy - t.cy), t.seq) AS r FROM c f LEFT JOIN c t ON f.page = t.page AND t.label = 'text' AND abs(f.cy - t.cy) < 200 WHERE f.label = 'figure') SELECT page, figure_seq, text_seq, distance FROM n WHERE r = 1")
def _j08(s, d):
    return L.nearest_text(_boxes(s, d))


@_add("j08b_nearest_text_2d", f"{_BOXES}, c AS (SELECT page, seq, label, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM boxes), n AS (SELECT f.page, f.seq AS figure_seq, t.seq AS text_seq, t.cx - f.cx AS dx, t.cy - f.cy AS dy, row_number() OVER (PARTITION BY f.page, f.seq ORDER BY (t.cx - f.cx) * (t.cx - f.cx) + (t.cy - f.cy) * (t.cy - f.cy), t.seq) AS r FROM c f JOIN c t ON f.page = t.page AND t.label <> 'figure' WHERE f.label = 'figure') SELECT page, figure_seq, text_seq, {C.relative_position('dx', 'dy')} AS position FROM n WHERE r = 1")
def _j08b(s, d):
    return L.nearest_text_2d(_boxes(s, d))


@_add("j09_quarantine_anti", f"{_SPANS} SELECT span_id FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM spans WHERE operation = 'error' GROUP BY trace_id HAVING count(*) >= 20)")
def _j09(s, d):
    rows = _spans(s, d)
    return rows.join(rows.where("operation = 'error'").groupBy("trace_id").count().where("count >= 20"), "trace_id", "left_anti").select("span_id")


@_add("j10_captions", f"{_BOXES}, n AS (SELECT f.page, f.seq AS figure_seq, t.seq AS text_seq, t.y0 - f.y1 AS gap, row_number() OVER (PARTITION BY f.page, f.seq ORDER BY t.y0 - f.y1, t.seq) AS r FROM boxes f JOIN boxes t ON f.page = t.page AND t.label IN ('text','title') WHERE f.label = 'figure' AND t.y0 - f.y1 >= 0 AND t.y0 - f.y1 <= greatest(50, least(100, (f.y1 - f.y0) / 2)) AND (least(f.x1, t.x1) - greatest(f.x0, t.x0)) / (f.x1 - f.x0) > 0.2) SELECT page, figure_seq, text_seq, gap FROM n WHERE r = 1")
def _j10(s, d):
    return L.captions(_boxes(s, d))


@_add("j11_box_overlaps", f"{_BOXES} SELECT a.page, a.seq AS a, b.seq AS b, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1 FROM boxes a JOIN boxes b ON a.page = b.page AND a.seq < b.seq AND a.x0 <= b.x1 + 10 AND b.x0 <= a.x1 + 10 AND a.y0 <= b.y1 + 10 AND b.y0 <= a.y1 + 10")
def _j11(s, d):
    return L.overlaps(_boxes(s, d))


@_add("j12_outside_visuals", f"{_BOXES} SELECT page, seq FROM boxes t WHERE label NOT IN ('figure','table') AND NOT EXISTS (SELECT 1 FROM boxes v WHERE v.page = t.page AND v.label IN ('figure','table') AND t.x0 < v.x1 AND v.x0 < t.x1 AND t.y0 < v.y1 AND v.y0 < t.y1)")
def _j12(s, d):
    return L.outside_visuals(_boxes(s, d))


_CACHE = "cache AS (SELECT sha256(text) AS k, min(doc_id) AS first_id FROM documents GROUP BY 1)"


@_add("j13_exact_cache", f"WITH {_CACHE} SELECT d.doc_id, c.first_id, coalesce(c.first_id < d.doc_id, false) AS hit FROM documents d LEFT JOIN cache c ON sha256(d.text) = c.k")
def _j13(s, d):
    rows = _docs(s, d).select("doc_id", F.sha2("text", 256).alias("k"))
    return rows.join(rows.groupBy("k").agg(F.min("doc_id").alias("first_id")), "k", "left").select("doc_id", "first_id", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)).alias("hit"))


@_add("j14_normalised_cache", f"WITH n AS (SELECT doc_id, lang, {S.similarity_key(CHECK, 'text')} AS k FROM documents), c AS (SELECT k, lang, min(doc_id) AS first_id FROM n GROUP BY ALL) SELECT n.doc_id, c.first_id FROM n LEFT JOIN c ON n.k = c.k AND n.lang = c.lang")
def _j14(s, d):
    rows = _docs(s, d).select("doc_id", "lang", F.expr(S.similarity_key(SPARK, "text")).alias("k"))
    return rows.join(rows.groupBy("k", "lang").agg(F.min("doc_id").alias("first_id")), ["k", "lang"], "left").select("doc_id", "first_id")


@_add("j17_images_with_boxes", f"{_BOXES} SELECT i.doc_id, count(b.seq) AS boxes FROM (SELECT DISTINCT doc_id FROM boxes) i LEFT JOIN boxes b ON i.doc_id = b.doc_id AND b.label = 'figure' AND b.confidence > 0.9 GROUP BY i.doc_id")
def _j17(s, d):
    b = _boxes(s, d)
    return b.groupBy("doc_id").agg(F.count_if(F.expr("label = 'figure' and confidence > 0.9")).alias("boxes"))


@_add("j18_toc_heading", f"{_HEADED}, h AS (SELECT doc_id, text, min(page_num) AS page FROM headed GROUP BY ALL) SELECT l.doc_id, l.seq, coalesce(h.page, 1) AS page FROM headed l LEFT JOIN h ON l.doc_id = h.doc_id AND l.text = h.text WHERE l.block_type IN ('h1','h2','h3')")
def _j18(s, d):
    rows = _headed(s, d)
    first = rows.groupBy("doc_id", "text").agg(F.min("page_num").alias("page"))
    return rows.where("block_type in ('h1','h2','h3')").join(first, ["doc_id", "text"], "left").select("doc_id", "seq", F.coalesce("page", F.lit(1)).alias("page"))


@_add("j20_glossary_terms", f"WITH g(term) AS (VALUES ('license'), ('version'), ('token'), ('stupid'), ('street')) SELECT doc_id, string_agg(term, ',' ORDER BY term) AS terms FROM documents JOIN g ON contains(lower(text), term) GROUP BY doc_id")
def _j20(s, d):
    terms = F.broadcast(s.createDataFrame([(x,) for x in ("license", "version", "token", "stupid", "street")], "term string"))
    return _docs(s, d).join(terms, F.expr("contains(lower(text), term)")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


@_add("j21_span_parent", f"{_SPANS}, p AS (SELECT *, lag(span_id) OVER (PARTITION BY trace_id ORDER BY started, span_id) AS parent_id FROM spans) SELECT c.span_id, c.parent_id, q.operation AS parent_operation FROM p c LEFT JOIN spans q ON c.trace_id = q.trace_id AND c.parent_id = q.span_id")
def _j21(s, d):
    rows = _spans(s, d)
    kids = rows.withColumn("parent_id", F.lag("span_id").over(Window.partitionBy("trace_id").orderBy("started", "span_id")))
    parents = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.col("operation").alias("parent_operation"))
    return kids.join(parents, ["trace_id", "parent_id"], "left").select("span_id", "parent_id", "parent_operation")


@_add("j23_merge_visuals", f"{_BOXES} SELECT page, seq, 'figure' AS source, CAST(NULL AS DOUBLE) AS confidence FROM boxes WHERE label = 'figure' UNION ALL SELECT page, seq, 'table', confidence FROM boxes WHERE label = 'table'")
def _j23(s, d):
    b = _boxes(s, d)
    return b.where("label = 'figure'").select("page", "seq", F.lit("figure").alias("source")).unionByName(b.where("label = 'table'").select("page", "seq", F.lit("table").alias("source"), "confidence"), allowMissingColumns=True)


@_add("j26_visual_by_hash", "WITH t AS (SELECT substr(md5(p_name), 1, 8) AS k, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, n AS sharing FROM part JOIN t ON substr(md5(p_name), 1, 8) = k")
def _j26(s, d):
    rows = T.read(s, d, "part").select("p_partkey", F.substring(F.md5("p_name"), 1, 8).alias("k"))
    return rows.join(rows.groupBy("k").agg(F.count("*").alias("sharing")), "k").select("p_partkey", "sharing")


# --- aggregations
@_add("a01_document_statistics", f"{_LINES} SELECT doc_id, count(*) AS blocks, count_if(block_type IN ('h1','h2','h3')) AS headings, count_if(block_type = 'list_item') AS items, count_if(block_type NOT IN ('equation','code_block','metadata')) AS translatable, max(page_num) AS pages FROM lines GROUP BY doc_id")
def _a01(s, d):
    n = lambda t: F.count_if(F.expr(t))
    return _lines(s, d).groupBy("doc_id").agg(F.count("*").alias("blocks"), n("block_type in ('h1','h2','h3')").alias("headings"), n("block_type = 'list_item'").alias("items"), n("block_type not in ('equation','code_block','metadata')").alias("translatable"), F.max("page_num").alias("pages"))


@_add("a02_size_statistics", f"{_BOXES}, m AS (SELECT doc_id, y1 - y0 AS size, count(*) AS n, min(page * 100 + seq) AS f FROM boxes GROUP BY ALL) SELECT b.doc_id, avg(y1 - y0) AS mean, median(y1 - y0) AS middle, stddev_pop(y1 - y0) AS deviation, any_value(k.size) AS mode FROM boxes b JOIN (SELECT doc_id, arg_max(size, n * 1e12::DOUBLE - f) AS size FROM m GROUP BY doc_id) k USING (doc_id) GROUP BY b.doc_id")
def _a02(s, d):
    b = _boxes(s, d).withColumn("size", F.col("y1") - F.col("y0"))
    sizes = b.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min(F.col("page") * 100 + F.col("seq")).alias("f"))
    mode = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("f"))).alias("mode"))
    return b.groupBy("doc_id").agg(F.avg("size").alias("mean"), F.median("size").alias("middle"), F.stddev_pop("size").alias("deviation")).join(mode, "doc_id")


@_add("a03_histograms", f"{_BOXES} SELECT label, CAST(y1 - y0 AS BIGINT) AS size, count(*) AS n FROM boxes GROUP BY GROUPING SETS ((label), (CAST(y1 - y0 AS BIGINT)))")
def _a03(s, d):
    b = _boxes(s, d).select("label", (F.col("y1") - F.col("y0")).cast("long").alias("size"))
    return b.groupingSets([[F.col("label")], [F.col("size")]], "label", "size").agg(F.count("*").alias("n"))


@_add("a05_font_thresholds", f"{_BOXES}, a AS (SELECT doc_id, avg(y1 - y0) AS m FROM boxes GROUP BY 1) SELECT doc_id, string_agg(CAST(size AS VARCHAR), ',' ORDER BY size DESC) AS sizes FROM (SELECT DISTINCT doc_id, CAST(y1 - y0 AS BIGINT) AS size FROM boxes JOIN a USING (doc_id) WHERE y1 - y0 > 1.2 * m) GROUP BY doc_id")
def _a05(s, d):
    g = _boxes(s, d).groupBy("doc_id").agg(F.avg(F.col("y1") - F.col("y0")).alias("m"), F.collect_set((F.col("y1") - F.col("y0")).cast("long")).alias("all"))
    kept = F.reverse(F.array_sort(F.filter("all", lambda x: x > F.col("m") * 1.2)))
    return g.select("doc_id", kept.alias("k")).where(F.size("k") > 0).select("doc_id", F.array_join("k", ",").alias("sizes"))


@_add("a06_page_layout", f"{_BOXES} SELECT edges, count(*) AS pages FROM (SELECT page, count(DISTINCT x0) AS edges FROM boxes GROUP BY page) GROUP BY edges")
def _a06(s, d):
    return _boxes(s, d).groupBy("page").agg(F.count_distinct("x0").alias("edges")).groupBy("edges").agg(F.count("*").alias("pages"))


@_add("a07_page_rollup", f"{_LINES} SELECT doc_id, page_num, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY ROLLUP (doc_id, page_num)")
def _a07(s, d):
    return _lines(s, d).rollup("doc_id", "page_num").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@_add("a08_routing_pages", f"{_LINES}, p AS (SELECT DISTINCT doc_id, page_num, {C.text_block_type(CHECK, 'text')} AS kind FROM lines) SELECT doc_id, kind, string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) AS pages FROM p GROUP BY ALL")
def _a08(s, d):
    rows = _lines(s, d).select("doc_id", "page_num", F.expr(C.text_block_type(SPARK, "text")).alias("kind"))
    return rows.groupBy("doc_id", "kind").agg(F.array_join(F.array_sort(F.collect_set("page_num")), ",").alias("pages"))


@_add("a09_routing_groups", f"WITH t(tool) AS (VALUES ('fast'), ('strong'), ('markup'), ('image'), ('skip')), {T.LINES_SQL}, i AS (SELECT text, {C.importance(CHECK, 'text', 'block_type', 'page_num')} AS importance FROM lines), r AS (SELECT {_TOOL_SQL} AS tool, count(*) AS n FROM i GROUP BY 1) SELECT t.tool, coalesce(r.n, 0) AS items FROM t LEFT JOIN r ON t.tool = r.tool")
def _a09(s, d):
    tools = s.createDataFrame([(x,) for x in ("fast", "strong", "markup", "image", "skip")], "tool string")
    rows = T.weighed(_lines(s, d)).groupBy(F.expr(_TOOL).alias("tool")).agg(F.count("*").alias("n"))
    return tools.join(rows, "tool", "left").select("tool", F.coalesce("n", F.lit(0)).alias("items"))


@_add("a10_strategy_stats", f"{_LINES} SELECT {C.importance(CHECK, 'text', 'block_type', 'page_num')} AS importance, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY 1")
def _a10(s, d):
    return T.weighed(_lines(s, d)).groupBy("importance").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@_add("a11_call_estimate", "SELECT source, greatest(1, CAST(sum(length(text)) AS BIGINT) // 12000) AS grouped_calls, CAST(sum(length(text)) AS BIGINT) // 500 AS single_calls, greatest(1, CAST(sum(length(text)) AS BIGINT) // 12000) * 3 / 60 AS minutes FROM documents GROUP BY source")
def _a11(s, d):
    g = _docs(s, d).groupBy("source").agg(F.sum(F.length("text")).alias("n"))
    calls = F.greatest(F.lit(1), F.expr("n div 12000"))
    return g.select("source", calls.alias("grouped_calls"), F.expr("n div 500").alias("single_calls"), (calls * 3 / 60).alias("minutes"))


@_add("a12_images_by_page", f"{_BOXES} SELECT page, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS images FROM boxes WHERE label = 'figure' GROUP BY page")
def _a12(s, d):
    return _boxes(s, d).where("label = 'figure'").groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("images"))


@_add("a13_chunk_statistics", f"{_LINES} SELECT block_type, count(*) AS chunks, avg(length(text)) AS mean, min(length(text)) AS least, max(length(text)) AS most FROM lines GROUP BY block_type")
def _a13(s, d):
    n = F.length("text").cast("long")
    return _lines(s, d).groupBy("block_type").agg(F.count("*").alias("chunks"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


@_add("a14_cache_statistics", f"WITH {_CACHE} SELECT lang, count(*) AS lookups, count_if(c.first_id < d.doc_id) AS hits, count_if(c.first_id < d.doc_id) / count(*) AS hit_rate FROM documents d LEFT JOIN cache c ON sha256(d.text) = c.k GROUP BY lang")
def _a14(s, d):
    rows = _docs(s, d).select("doc_id", "lang", F.sha2("text", 256).alias("k"))
    joined = rows.join(rows.groupBy("k").agg(F.min("doc_id").alias("first_id")), "k", "left")
    hits = F.count_if(F.col("first_id") < F.col("doc_id"))
    return joined.groupBy("lang").agg(F.count("*").alias("lookups"), hits.alias("hits"), (hits / F.count("*")).alias("hit_rate"))


@_add("a15_class_distribution", f"WITH k(label) AS (VALUES ('figure'), ('table'), ('text'), ('title'), ('equation')), {T.BOXES_SQL} SELECT k.label, count(b.seq) AS n, count(b.seq) / (SELECT count(DISTINCT page) FROM boxes) AS per_page FROM k LEFT JOIN boxes b USING (label) GROUP BY k.label")
def _a15(s, d):
    b = _boxes(s, d)
    kinds = s.createDataFrame([(x,) for x in ("figure", "table", "text", "title", "equation")], "label string")
    counts = b.groupBy("label").agg(F.count("*").alias("c"))
    pages = b.agg(F.count_distinct("page").alias("pages"))
    return kinds.join(counts, "label", "left").join(F.broadcast(pages)).select("label", F.coalesce("c", F.lit(0)).alias("n"), (F.coalesce("c", F.lit(0)) / F.col("pages")).alias("per_page"))


@_add("a16_trace_summary", f"{_SPANS} SELECT trace_id, count(*) AS spans, CAST(sum(found) AS BIGINT) AS found, max(duration_ms) AS longest, arg_max(span_id, duration_ms * 1e9::DOUBLE - span_id) AS slowest, avg(duration_ms) AS mean, count_if(operation = 'error') AS errors FROM spans GROUP BY trace_id")
def _a16(s, d):
    return _spans(s, d).groupBy("trace_id").agg(F.count("*").alias("spans"), F.sum("found").alias("found"), F.max("duration_ms").alias("longest"), F.max_by("span_id", F.struct("duration_ms", -F.col("span_id"))).alias("slowest"), F.avg("duration_ms").alias("mean"), F.count_if(F.col("operation") == "error").alias("errors"))


@_add("a17_toc_summary", f"{_LINES}, t AS (SELECT doc_id, {C.toc_level(CHECK, 'text')} AS level, {S.toc_page(CHECK, 'text')} AS page FROM lines) SELECT doc_id, count_if(level <= 2) AS upper, count_if(level > 2) AS lower, max(level)::BIGINT AS deepest, bool_or(page IS NOT NULL) AS any_page FROM t GROUP BY doc_id")
def _a17(s, d):
    t = _lines(s, d).select("doc_id", F.expr(C.toc_level(SPARK, "text")).alias("level"), F.expr(S.toc_page(SPARK, "text")).alias("page"))
    return t.groupBy("doc_id").agg(F.count_if(F.col("level") <= 2).alias("upper"), F.count_if(F.col("level") > 2).alias("lower"), F.max("level").cast("long").alias("deepest"), F.bool_or(F.col("page").isNotNull()).alias("any_page"))


@_add("a18_structure_validation", "SELECT conv_id, count(*) AS n, bool_and(ok) AS monotonic FROM (SELECT conv_id, coalesce(length(text) >= lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), true) AS ok FROM conversations) GROUP BY conv_id")
def _a18(s, d):
    ok = F.coalesce(F.length("text") >= F.lag(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(True))
    return T.read(s, d, "conversations").select("conv_id", ok.alias("ok")).groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("monotonic"))


@_add("a19_item_counts", f"{_LINES} SELECT doc_id, count_if(block_type = 'h1') AS h1, count_if(block_type = 'h2') AS h2, count_if(block_type = 'list_item') AS list_item, count_if(block_type = 'paragraph') AS paragraph FROM lines GROUP BY doc_id")
def _a19(s, d):
    p = _lines(s, d).groupBy("doc_id").pivot("block_type", ["h1", "h2", "list_item", "paragraph"]).count()
    return p.na.fill(0)


@_add("a20_cross_references", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+\.[0-9]+'))), ',') AS refs FROM documents WHERE regexp_matches(text, '[0-9]+\.[0-9]+')")
def _a20(s, d):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))))
    return _docs(s, d).select("doc_id", found.alias("f")).where(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("refs"))


@_add("a23_error_summary", "SELECT event_type AS severity, count(*) AS n, max(value) > 20 AS critical FROM events GROUP BY event_type")
def _a23(s, d):
    return T.read(s, d, "events").groupBy(F.col("event_type").alias("severity")).agg(F.count("*").alias("n"), (F.max("value") > 20).alias("critical"))


@_add("a24_document_hash", f"{_LINES} SELECT doc_id, md5(string_agg(concat(block_type, ':', text, '|'), '' ORDER BY seq)) AS hash FROM lines GROUP BY doc_id")
def _a24(s, d):
    part = F.concat("block_type", F.lit(":"), "text", F.lit("|"))
    return _lines(s, d).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("p")))), lambda x: x["p"]), "")).alias("hash"))


@_add("a25_rolling_best", "SELECT event_id, max(value) OVER w AS best, avg(value) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def _a25(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return T.read(s, d, "events").select("event_id", F.max("value").over(w).alias("best"), F.avg("value").over(w).alias("mean"))


@_add("a26_table_boxes", f"{_BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS cells FROM boxes WHERE label = 'table' GROUP BY page")
def _a26(s, d):
    return _boxes(s, d).where("label = 'table'").groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("cells"))


@_add("a29_otsu_threshold", "WITH h AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT user_id, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY user_id) AS wt, sum(n * v) OVER (PARTITION BY user_id) AS st FROM h WINDOW w AS (PARTITION BY user_id ORDER BY v)), f AS (SELECT user_id, v, w0 * (wt - w0) * pow(s0 / w0 - (st - s0) / (wt - w0), 2) AS b FROM c WHERE w0 < wt) SELECT user_id, threshold FROM (SELECT user_id, v AS threshold, row_number() OVER (PARTITION BY user_id ORDER BY round(b, 4) DESC, v) AS r FROM f) WHERE r = 1")
def _a29(s, d):
    h = T.read(s, d, "events").groupBy("user_id", F.floor("value").cast("long").alias("v")).agg(F.count("*").alias("n"))
    up, full = Window.partitionBy("user_id").orderBy("v").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("user_id")
    c = h.select("user_id", "v", F.sum("n").over(up).alias("w0"), F.sum(F.expr("n * v")).over(up).alias("s0"), F.sum("n").over(full).alias("wt"), F.sum(F.expr("n * v")).over(full).alias("st")).where("w0 < wt")
    f = c.select("user_id", "v", F.expr("round(w0 * (wt - w0) * pow(s0 / w0 - (st - s0) / (wt - w0), 2), 4)").alias("b"))
    return f.groupBy("user_id").agg(F.max_by("v", F.struct("b", -F.col("v"))).alias("threshold"))


# --- ordered operators
@_add("w01_two_sided_context", f"{_LINES} SELECT doc_id, seq, concat_ws('|', right(lag(text) OVER w, 200), right(lag(text, 2) OVER w, 200)) AS before, concat_ws('|', left(lead(text) OVER w, 200), left(lead(text, 2) OVER w, 200)) AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def _w01(s, d):
    return G.two_sided_context(_lines(s, d))


@_add("w02_neighbour_context", f"{_LINES} SELECT doc_id, seq, coalesce(right(lag(text) OVER w, 100), '') AS before, coalesce(left(lead(text) OVER w, 100), '') AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def _w02(s, d):
    return G.neighbour_context(_lines(s, d))


@_add("w05_page_estimates", f"{_LINES} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n, CAST(1 + count(*) FILTER (block_type = 'paragraph') OVER (PARTITION BY doc_id ORDER BY seq) // 50 AS BIGINT) AS page FROM lines")
def _w05(s, d):
    w = Window.partitionBy("doc_id").orderBy("seq")
    return _lines(s, d).select("doc_id", "seq", F.row_number().over(w).cast("long").alias("n"), F.count(F.when(F.col("block_type") == "paragraph", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c")).select("doc_id", "seq", "n", F.expr("1 + c div 50").alias("page"))


@_add("w06_section_bounds", f"{_HEADED}, h AS (SELECT doc_id, seq, page_num, lead(page_num) OVER (PARTITION BY doc_id ORDER BY seq) AS nx FROM headed WHERE block_type IN ('h1','h2','h3')), m AS (SELECT doc_id, max(page_num) AS pages FROM headed GROUP BY 1) SELECT doc_id, seq, page_num AS start_page, coalesce(nx - 1, pages) AS end_page FROM h JOIN m USING (doc_id)")
def _w06(s, d):
    return G.section_bounds(_headed(s, d))


@_add("w07_reading_order", f"{_BOXES}, t AS (SELECT *, greatest(10.0, least(30.0, avg(y1 - y0) OVER (PARTITION BY page) * 0.5)) AS tol FROM boxes) SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / tol, 0) * tol, x0, seq) AS position FROM t")
def _w07(s, d):
    return L.reading_order(_boxes(s, d))


@_add("w08_column_detection", f"{_BOXES}, e AS (SELECT DISTINCT page, x FROM (SELECT page, x0 AS x FROM boxes UNION ALL SELECT page, x1 FROM boxes)), g AS (SELECT page, x - lag(x) OVER (PARTITION BY page ORDER BY x) AS w FROM e) SELECT page, count_if(w > 20) AS gaps, coalesce(max(w), 0) AS widest, coalesce(max(w) > 40, false) AS multi_column FROM g GROUP BY page")
def _w08(s, d):
    return L.column_gaps(_boxes(s, d))


@_add("w09_multi_column_order", f"{_BOXES}, c AS (SELECT *, CAST((x0 + x1) / 2 >= 250 AS BIGINT) AS col FROM boxes) SELECT page, seq, col, row_number() OVER (PARTITION BY page ORDER BY col, y0, x0, seq) AS position FROM c")
def _w09(s, d):
    return L.multi_column_order(_boxes(s, d))


# A line of a table of contents, written for the checking engine alone.
_BARE_SQL = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_TOC_SQL = f"(regexp_matches({_BARE_SQL}, '(?i)(^[0-9]+[.]?\\s+|chapter\\s+[0-9]+|[.]{{3,}}|[0-9]+$|^\\w+\\s+[0-9]+$)') OR (length({_BARE_SQL}) < 100 AND regexp_matches(text, '[0-9]')))"


@_add("w11_smart_groups", f"""WITH RECURSIVE {T.LINES_SQL}, i AS (SELECT doc_id, seq, page_num AS p, block_type AS t, length(text) AS n, {_TOC_SQL} AS toc FROM lines),
f(doc_id, seq, g, k, z, p, t) AS (SELECT doc_id, seq, 0, 1, n + 18, p, t FROM i WHERE seq = 0 UNION ALL
SELECT i.doc_id, i.seq, f.g + c, CASE c WHEN 1 THEN 1 ELSE f.k + 1 END, CASE c WHEN 1 THEN 0 ELSE f.z END + i.n + 18, i.p, i.t FROM f JOIN i ON i.doc_id = f.doc_id AND i.seq = f.seq + 1,
LATERAL (SELECT CAST(f.k >= 8 OR f.z + i.n > CASE WHEN i.p <= 10 OR i.toc THEN 18000 ELSE 12000 END OR CASE WHEN i.p <= 10 THEN f.t IN ('image','table') OR i.t IN ('image','table') ELSE f.t IN ('h1','h2','h3') AND i.t NOT IN ('h1','h2','h3') END OR (f.k > CASE WHEN i.p <= 10 THEN 5 ELSE 3 END AND f.p <> i.p) AS INT) AS c))
SELECT doc_id, seq, CAST(g AS BIGINT) AS group_id FROM f""")  # fmt: skip
def _w11(s, d):
    return G.smart_groups(_lines(s, d))


@_add("w12_batches", f"""WITH RECURSIVE {T.LINES_SQL}, i AS (SELECT doc_id, seq, length(text) AS n FROM lines), f(doc_id, seq, g, z) AS (SELECT doc_id, seq, 0, n FROM i WHERE seq = 0 UNION ALL
SELECT i.doc_id, i.seq, CASE WHEN f.z + i.n > 2000 THEN f.g + 1 ELSE f.g END, CASE WHEN f.z + i.n > 2000 THEN i.n ELSE f.z + i.n END FROM f JOIN i ON i.doc_id = f.doc_id AND i.seq = f.seq + 1) SELECT doc_id, seq, CAST(g AS BIGINT) AS batch_id FROM f""")  # fmt: skip
def _w12(s, d):
    return G.batches(_lines(s, d), 2000)


@_add("w14_theme_sessions", f"{_LINES}, a AS (SELECT doc_id, seq, CASE WHEN seq = 0 THEN 'general' ELSE {C.argmax_words(CHECK, 'text', C.THEMES, 'general', occurrences=True)} END AS theme FROM lines), b AS (SELECT *, CASE WHEN lag(theme) OVER (PARTITION BY doc_id ORDER BY seq) <> theme THEN 1 ELSE 0 END AS c FROM a), r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS run FROM b) SELECT doc_id, seq, theme, run, (row_number() OVER (PARTITION BY doc_id, run ORDER BY seq) - 1) // 10 AS part FROM r")
def _w14(s, d):
    return G.theme_sessions(_lines(s, d), F.expr(C.argmax_words(SPARK, "text", C.THEMES, "general", occurrences=True)))


@_add("w15_sentence_chunks", """WITH RECURSIVE ss AS (SELECT doc_id, list_filter(str_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM ss), f(doc_id, i, chunk, k, z, last) AS (SELECT doc_id, i, 0, 1, length(x), length(x) FROM u WHERE i = 0 UNION ALL
SELECT u.doc_id, u.i, CASE WHEN f.k > 0 AND f.z + length(x) > 2000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.k > 0 AND f.z + length(x) > 2000 THEN 2 ELSE f.k + 1 END,
CASE WHEN f.k > 0 AND f.z + length(x) > 2000 THEN f.last + length(x) ELSE f.z + length(x) END, length(x) FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1)
SELECT doc_id, chunk::BIGINT AS chunk, arg_max(z, i)::BIGINT AS size FROM f GROUP BY doc_id, chunk""")
def _w15(s, d):
    return G.sentence_chunks(_docs(s, d).where("text is not null"), F.expr(S.sentences(SPARK, "text")))


@_add("w17_paragraph_runs", f"{_LINES}, r AS (SELECT *, sum(CASE WHEN block_type <> 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM lines) SELECT doc_id, min(seq) AS seq, count(*) AS members, min(page_num) AS page_num, md5(string_agg(text, '[PARAGRAPH_BREAK]' ORDER BY seq)) AS text_md5 FROM r WHERE block_type = 'paragraph' GROUP BY doc_id, run")
def _w17(s, d):
    return G.paragraph_runs(_lines(s, d))


@_add("w21_join_lines", f"{_LINES} SELECT doc_id, md5(replace(replace(string_agg(text, chr(10) ORDER BY seq), '-' || chr(10), ''), chr(10), ' ')) AS joined_md5 FROM lines GROUP BY doc_id")
def _w21(s, d):
    return G.join_lines(_lines(s, d))


_KNOWN = "CASE WHEN seq % 4 = 2 THEN seq * 2 ELSE NULL END"


@_add("w23_fill_pages", f"{_LINES}, k AS (SELECT doc_id, seq, {_KNOWN} AS known FROM lines), r AS (SELECT *, count(known) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM k) SELECT doc_id, seq, coalesce(first_value(known) OVER w + row_number() OVER w - 1, row_number() OVER (PARTITION BY doc_id ORDER BY seq)) AS page FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY seq)")
def _w23(s, d):
    return G.fill_pages(_lines(s, d), F.expr(_KNOWN))


_BOTH = "greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0))"


@_add("w24_greedy_suppression", f"""WITH RECURSIVE {T.BOXES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, seq, x0, y0, x1, y1) AS r FROM boxes),
f(page, r, kept) AS (SELECT page, r, [{{'seq': seq, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] FROM o WHERE r = 1 UNION ALL
SELECT f.page, o.r, CASE WHEN len(list_filter(f.kept, lambda k: {_BOTH} >= 0.5 * least((k.x1 - k.x0) * (k.y1 - k.y0), (o.x1 - o.x0) * (o.y1 - o.y0)))) > 0 THEN f.kept ELSE list_append(f.kept, {{'seq': o.seq, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}}) END FROM f JOIN o ON o.page = f.page AND o.r = f.r + 1),
e AS (SELECT page, unnest(arg_max(kept, r)) AS b FROM f GROUP BY page) SELECT page, b.seq AS seq FROM e""")
def _w24(s, d):
    return L.suppress(_boxes(s, d))


# --- sorts, limits, top-k
@_add("t01_top_detections", f"{_BOXES}, r AS (SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, page, seq) AS r FROM boxes) SELECT doc_id, page, seq, r AS rank FROM r WHERE r <= 10")
def _t01(s, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "page", "seq")
    return _boxes(s, d).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("doc_id", "page", "seq", "rank")


@_add("t02_best_visual", f"{_BOXES}, q AS (SELECT page, seq, least((x1 - x0) * (y1 - y0) / 10000, 3) + 2 * confidence AS quality FROM boxes WHERE label = 'figure'), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY quality DESC, seq) AS r FROM q) SELECT page, seq, quality FROM r WHERE r = 1")
def _t02(s, d):
    q = _boxes(s, d).where("label = 'figure'").withColumn("quality", F.least(L.area() / 10000, F.lit(3.0)) + 2 * F.col("confidence"))
    return q.groupBy("page").agg(F.max(F.struct("quality", -F.col("seq"))).alias("b")).select("page", (-F.col("b.col2")).alias("seq"), F.col("b.quality").alias("quality"))


@_add("t04_lfu_eviction", "SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY n, last, user_id) AS r FROM (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id)) WHERE r > 5")
def _t04(s, d):
    use = T.read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    out = use.orderBy("n", "last", "user_id").limit(5).select("user_id")  # the feature: the least used five go
    return use.join(F.broadcast(out), "user_id", "left_anti").select("user_id")


@_add("t05_best_engine", "SELECT user_id, event_type AS engine FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' AND max(value) >= 7 THEN 0 WHEN max(value) >= 7 THEN 1 ELSE 2 END, max(value) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def _t05(s, d):
    best = T.read(s, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    tier = F.expr("case when event_type = 'view' and v >= 7 then 0 when v >= 7 then 1 else 2 end")
    return best.groupBy("user_id").agg(F.min(F.struct(tier.alias("t"), (-F.col("v")).alias("v"), F.col("event_type").alias("e"))).alias("b")).select("user_id", F.col("b.e").alias("engine"))


@_add("t11_first_samples", f"{_LINES}, r AS (SELECT doc_id, seq, left(text, 500) AS sample, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM lines) SELECT doc_id, seq, sample FROM r WHERE r <= 5")
def _t11(s, d):
    return _lines(s, d).where("seq < 5").select("doc_id", "seq", F.expr("left(text, 500)").alias("sample"))


# --- sets and dedup
@_add("u01_merge_documents", "WITH n AS (SELECT max(turn) + 1 AS n FROM conversations WHERE conv_id = 0) SELECT turn, text FROM conversations WHERE conv_id = 0 UNION ALL SELECT turn + n, text FROM conversations, n WHERE conv_id = 1")
def _u01(s, d):
    c = T.read(s, d, "conversations")
    n = c.where("conv_id = 0").agg((F.max("turn") + 1).alias("n"))
    return c.where("conv_id = 0").select("turn", "text").union(c.where("conv_id = 1").join(F.broadcast(n)).select(F.expr("turn + n"), "text"))


@_add("u01_merge_pairs", "WITH n AS (SELECT conv_id // 2 AS pair, max(turn) + 1 AS n FROM conversations WHERE conv_id % 2 = 0 GROUP BY ALL) SELECT conv_id // 2 AS pair, turn + CASE WHEN conv_id % 2 = 0 THEN 0 ELSE coalesce(n, 0) END AS turn, text FROM conversations LEFT JOIN n ON conv_id // 2 = pair")
def _u01_pairs(s, d):
    c = T.read(s, d, "conversations").select(F.expr("shiftright(conv_id, 1)").alias("pair"), F.expr("conv_id & 1").alias("second"), "turn", "text")
    n = c.where("second = 0").groupBy("pair").agg((F.max("turn") + 1).alias("n"))
    return c.join(n, "pair", "left").select("pair", F.expr("turn + if(second = 1, coalesce(n, 0), 0)").alias("turn"), "text")


@_add("u02_title_dedup", f"{_LINES}, r AS (SELECT doc_id, seq, lower(trim(text)) AS k, row_number() OVER (PARTITION BY doc_id, lower(trim(text)) ORDER BY seq) AS r FROM lines WHERE length(trim(text)) > 3) SELECT doc_id, seq FROM r WHERE r = 1")
def _u02(s, d):
    return _lines(s, d).where("length(trim(text)) > 3").groupBy("doc_id", F.lower(F.trim("text")).alias("k")).agg(F.min("seq").alias("seq")).select("doc_id", "seq")


@_add("u03_title_page_dedup", f"{_LINES} SELECT doc_id, page_num, min(seq) AS seq FROM lines GROUP BY doc_id, page_num, text")
def _u03(s, d):
    return _lines(s, d).groupBy("doc_id", "page_num", "text").agg(F.min("seq").alias("seq")).select("doc_id", "page_num", "seq")


@_add("u08_distinct_pages", f"{_LINES} SELECT doc_id, count(DISTINCT page_num) AS pages, count(DISTINCT block_type) AS kinds FROM lines GROUP BY doc_id")
def _u08(s, d):
    return _lines(s, d).groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"), F.count_distinct("block_type").alias("kinds"))


@_add("u09_cache_upsert", "SELECT k, doc_id AS latest FROM (SELECT sha256(text) AS k, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def _u09(s, d):
    return _docs(s, d).groupBy(F.sha2("text", 256).alias("k")).agg(F.max("doc_id").alias("latest"))


# --- stream analogues, as batch
_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


@_add("st_rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def _st_rate(s, d):
    t = F.expr(_MICROS)
    return T.read(s, d, "events").select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy(t).rangeBetween(-3_600_000_000, 0)).alias("in_window"))


@_add("st_first_occurrence", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS hit FROM events")
def _st_first(s, d):
    return T.read(s, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) > 1).alias("hit"))


@_add("st_gap_sessions", "WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS c FROM events) SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g")
def _st_sessions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.expr(_MICROS) - F.lag(F.expr(_MICROS)).over(w) > 3_600_000_000, 1).otherwise(0)
    return T.read(s, d, "events").withColumn("c", gap).select("event_id", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("session"))


# --- similarity; no SQL expresses the sequence matcher, so tests compare with a plain loop
@_add("j15_fuzzy_lookup", "")
def _j15(s, d):
    from foliospark.operators.similarity import fuzzy_lookup

    rows = T.read(s, d, "benchmark").select(F.col("item_id").alias("key"), F.lit("en").alias("lang"), "text")
    return fuzzy_lookup(rows, rows.select(F.col("key").alias("cache_key"), "lang", F.expr("substring(text, 1, length(text) - 8)").alias("text")))


def _titles(s: SparkSession, d: str) -> DataFrame:
    """Titles of headings; lines that can't be one are let go before the costly rules of the other types are tried on them."""
    rows = _lines(s, d).where(f"seq % 8 = 0 or {C.heading_mark(SPARK, 'text')}")
    return T.headed(rows).where("block_type in ('h1', 'h2') and title <> ''").select("doc_id", "seq", F.col("title").alias("text"))


@_add("u04_substring_dedup", "")
def _u04(s, d):
    from foliospark.operators.similarity import drop_contained

    return drop_contained(_titles(s, d))


@_add("u05_similar_guard", "")
def _u05(s, d):
    from foliospark.operators.similarity import drop_similar

    return drop_similar(_titles(s, d))


@_add("j16_vector_top1", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS match_id, list_inner_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT vec_id, match_id FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, match_id) AS r FROM p) WHERE r = 1""")  # fmt: skip
def _j16(s, d):
    """Nearest other vector of the same label for the stated query set, every vec_id divisible by 20."""
    from foliospark.operators.vectors import nearest_of_label

    return nearest_of_label(T.read(s, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v")))
