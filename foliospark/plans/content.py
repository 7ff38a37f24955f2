"""Queries of text cascades, markdown parsing, reconciliation, caches and ordering; the SQL beside each is written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import cascades as X
from foliospark.functions import classify as C
from foliospark.functions import predicates as P
from foliospark.functions import scores as S
from foliospark.functions.portable import CHECK, SPARK
from foliospark.operators import grouping as G
from foliospark.operators import markdown as M
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


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Page texts."""
    return _lines(s, d).groupBy("doc_id", "page_num").agg(G.ordered_text("text", "\n").alias("text"))


#: Lines as markdown: every eighth a heading, others list items, blank lines and, if fenced, code.
MARKED = "case when seq % 24 = 0 then concat('# ', text) when seq % 8 = 0 then concat('## ', text) when seq % 8 = 3 then concat('    - ', text) when seq % 8 = 4 then concat('2. ', text) when seq % 8 = 6 then '' else text end"
FENCED = f"case when seq % 16 in (9, 13) then '```' else {MARKED} end"


def _marked(s: SparkSession, d: str, how: str = MARKED) -> DataFrame:
    return _lines(s, d).withColumn("md", F.expr(how))


_LINES, _BOXES, _SPANS = f"WITH {T.LINES_SQL}", f"WITH {T.BOXES_SQL}", f"WITH {T.SPANS_SQL}"
_PAGES = f"{_LINES}, pages AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY seq) AS text FROM lines GROUP BY doc_id, page_num)"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _any(col: str, words: tuple[str, ...]) -> str:
    """SQL of the checking engine: whether a text holds one of the words."""
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _many(col: str, words: tuple[str, ...]) -> str:
    """SQL of the checking engine: how many of the words a text holds."""
    return f"len(list_filter([{', '.join(chr(39) + w + chr(39) for w in words)}], lambda w: contains({col}, w)))"


# --- text cascades over pages
_F = f"""f AS (SELECT *, lower(text) AS low, trim(text, {_WS}) AS bare, list_filter(str_split_regex(text, '\\s+'), lambda x: x <> '') AS words, str_split(text, chr(10)) AS ls,
list_filter(list_transform(str_split(text, '.'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ss, len(str_split(text, '.')) AS parts,
list_filter(list_transform(str_split(text, chr(10) || chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS paras FROM pages)"""
_TITLE = r"^[^\p{L}]*\p{Lu}\p{Ll}*([^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$"
_AVG = "length(array_to_string(ss, '')) / greatest(1, len(ss))"
_PROSE_SQL = f"""CASE WHEN length(bare) < 150 OR len(ss) < 3 THEN false
WHEN {_AVG} > 40 AND len(list_filter(ss, lambda x: length(x) > 40)) / len(ss) > 0.3 AND len(paras) >= 2 THEN true
WHEN {_many('low', X.PROSE_PHRASES)} >= 2 AND len(ss) > 5 THEN true
WHEN len(words) > 50 AND {_many('low', X.CONNECTING)} / len(words) > 0.1 THEN true ELSE false END"""
_PLAIN_SQL = f"""CASE WHEN length(text) < 50 THEN true WHEN {_many('low', X.LISTING)} >= 2 THEN true WHEN {_any('low', X.BOOK_PARTS)} THEN true
WHEN len(ls) > 3 AND (len(list_filter(ls, lambda x: regexp_matches(x, '[0-9]'))) + len(list_filter(ls, lambda x: regexp_matches(trim(x, {_WS}), '^[•*-]\\s+')))) / len(ls) > 0.3 THEN true
WHEN len(ls) > 3 AND len(list_filter(ls, lambda x: regexp_matches(x, '[0-9]'))) / len(ls) > 0.4 THEN true
WHEN parts > 5 AND {_AVG} BETWEEN 30 AND 300 THEN true WHEN {_many('low', X.SCHOLARLY)} >= 2 THEN true
WHEN len(words) > 50 AND len(list_filter(words, lambda x: lower(x) IN {X.COMMON})) / len(words) > 0.15 THEN true
WHEN len(words) > 10 AND len(list_filter(words, lambda x: length(x) > 2 AND regexp_matches(x, '{_TITLE}'))) / len(words) > 0.3 THEN true ELSE false END"""
_FORMATTED_SQL = f"""CASE WHEN length(bare) < 50 THEN false WHEN {_many('low', X.FORMATTED)} >= 3 THEN true
WHEN len(ls) > 5 AND (len(list_filter(ls, lambda x: regexp_matches(trim(x, {_WS}), '^[0-9]+[.)]\\s+'))) + len(list_filter(ls, lambda x: regexp_matches(trim(x, {_WS}), '^[•*-]\\s+')))) / len(ls) > 0.3 THEN true
WHEN len(words) > 20 AND len(list_filter(words[1:len(words) - 1], lambda x: length(x) < 15 AND regexp_matches(x, '{_TITLE}'))) / len(words) > 0.2 THEN true ELSE false END"""


@_add("p19_prose", f"{_PAGES}, {_F} SELECT doc_id, page_num, {_PLAIN_SQL} AS plain, {_PROSE_SQL} AS prose, {_FORMATTED_SQL} AS formatted FROM f")
def _p19(s, d):
    return X.with_text_features(_pages(s, d)).select("doc_id", "page_num", X.plain_text().alias("plain"), X.continuous_prose().alias("prose"), X.formatted_page().alias("formatted"))


@_add("p20_placement_context", f"""{_PAGES}, {_F} SELECT doc_id, page_num, CASE WHEN length(bare) < 100 THEN false
WHEN regexp_matches(low, 'figure\\s+[0-9]+|fig\\.\\s*[0-9]+|diagram\\s+[0-9]+|chart\\s+[0-9]+|see\\s+figure|shown\\s+in\\s+figure|as\\s+illustrated|as\\s+shown') THEN true
WHEN {_many('low', X.VISUAL)} >= 2 THEN true WHEN {_many('low', X.TECHNICAL)} >= 3 AND {_many('low', X.VISUAL)} >= 1 THEN true WHEN {_any('low', X.TEXT_ONLY)} THEN false
WHEN ({_PROSE_SQL}) THEN false WHEN parts > 20 AND {_AVG} BETWEEN 40 AND 150 THEN false ELSE length(bare) >= 200 END AS keeps FROM f""")  # fmt: skip
def _p20(s, d):
    return X.with_text_features(_pages(s, d)).select("doc_id", "page_num", X.placement_context().alias("keeps"))


@_add("p26_assessment_text", f"""{_PAGES}, {_F} SELECT doc_id, page_num, CASE WHEN length(bare) < 20 THEN false WHEN {_any('low', X.ASSESSMENT)} THEN true
WHEN len(ls) > 2 AND len(list_filter(ls, lambda x: regexp_matches(lower(trim(x, {_WS})), '^[0-9]+[.)]\\s+.*(point|assessment|criterion|step|stage|evaluation)') OR regexp_matches(lower(trim(x, {_WS})), '^(first|second|third|fourth|fifth).*(point|assessment|criterion)'))) / len(ls) > 0.3 THEN true
WHEN {_many('low', X.EVALUATION)} >= 3 AND len(words) > 30 THEN true
WHEN len(words) > 50 AND length(array_to_string(words, '')) / len(words) > 4 AND length(regexp_replace(text, '[^.!?]', '', 'g')) > 2 AND len(words) / greatest(1, length(regexp_replace(text, '[^.!?]', '', 'g'))) > 10 THEN true ELSE false END AS assessment FROM f""")  # fmt: skip
def _p26(s, d):
    return X.with_text_features(_pages(s, d)).select("doc_id", "page_num", X.assessment_text().alias("assessment"))


_FILE = "concat('img_', page_num, case when page_num % 3 = 0 then '_Chart' else '' end, '.png')"


@_add("p11_ocr_skip", f"""{_PAGES}, {_F}, g AS (SELECT *, lower(bare) AS lb, lower({_FILE}) AS file FROM f)
SELECT doc_id, page_num, CASE WHEN bare = '' THEN 'empty' WHEN len(words) < 8 THEN 'few_words' WHEN {_any('lb', X.CHART)} THEN 'chart_word'
WHEN length(regexp_replace(lb, '[^\\p{{L}}]+', '', 'g')) > 0 AND length(regexp_replace(lb, '[\\p{{L}}\\s]+', '', 'g')) / length(lb) > 0.3 THEN 'symbols'
WHEN len(list_filter(words, lambda x: length(x) <= 3)) / len(words) > 0.5 THEN 'short_words' WHEN {_any('lb', X.MATH_SIGNS)} THEN 'math_sign' WHEN {_any('lb', X.ADDRESSES)} THEN 'address'
WHEN {_any('file', X.COMPLEX_FILES)} THEN 'file_name' WHEN len(ls) > 2 THEN 'lines' WHEN {_any('lb', X.INTERFACE)} THEN 'interface' WHEN len(words) < 10 THEN 'under_ten_words'
WHEN NOT {_any('lb', X.SENTENCE)} THEN 'no_sentence' WHEN {_any('lb', X.DESCRIPTIVE)} THEN 'descriptive' WHEN len(ss) <> 1 THEN 'sentences' WHEN NOT {_any('lb', X.ACADEMIC)} THEN 'not_academic' ELSE 'translate' END AS rule FROM g""")  # fmt: skip
def _p11(s, d):
    """The rule that keeps a recognised text from translation, or ``translate``."""
    return X.with_text_features(_pages(s, d)).withColumn("file", F.expr(_FILE)).select("doc_id", "page_num", X.ocr_skip("file").alias("rule"))


@_add("p27_embed_original", f"""{_LINES}, p AS (SELECT doc_id, page_num, CASE WHEN (doc_id + page_num) % 11 = 0 THEN 'toc_page' WHEN (doc_id + page_num) % 13 = 0 THEN 'error' ELSE 'content' END AS kind,
string_agg(text, ' ' ORDER BY seq) FILTER (trim(text, {_WS}) <> '') AS total FROM lines GROUP BY doc_id, page_num)
SELECT doc_id, page_num, CASE kind WHEN 'toc_page' THEN 'regenerate' WHEN 'error' THEN 'embed_error' ELSE CASE WHEN total IS NULL THEN 'embed_empty' WHEN length(trim(total, {_WS})) < 50 THEN 'embed_short'
WHEN length(regexp_replace(total, '[\\p{{L}}\\p{{N}}_\\s]+', '', 'g')) / length(total) > 0.3 THEN 'embed_special' ELSE 'keep' END END AS decision FROM p""")  # fmt: skip
def _p27(s, d):
    """Whether a page's original is embedded instead of its text, and why."""
    kind = F.expr("case when (doc_id + page_num) % 11 = 0 then 'toc_page' when (doc_id + page_num) % 13 = 0 then 'error' else 'content' end")
    pages = _lines(s, d).withColumn("shown", F.expr(f"if({SPARK.strip('text')} <> '', text, null)")).groupBy("doc_id", "page_num").agg(F.count("shown").alias("blocks"), G.ordered_text("shown", " ").alias("total"))
    return pages.select("doc_id", "page_num", X.embed_original(kind, F.col("blocks"), F.col("total")).alias("decision"))


@_add("p09_image_prefilter", f"""{_BOXES} SELECT page, seq, CASE WHEN (x1 - x0) * (y1 - y0) * 3 < 10000 THEN 'small_file' WHEN x1 - x0 < 50 OR y1 - y0 < 50 THEN 'small_side' WHEN seq <= 2 THEN 'few_colours'
WHEN confidence > 0.9 THEN 'one_colour' WHEN greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) > 10 THEN 'narrow' ELSE 'analyse' END AS reason FROM boxes WHERE label = 'figure'""")  # fmt: skip
def _p09(s, d):
    """Images worth analysing, by metadata of their files; the boxes stand for images of three bytes a point."""
    images = T.boxes(T.read(s, d, "part")).where("label = 'figure'").selectExpr("page", "seq", "x1 - x0 as width", "y1 - y0 as height", "seq + 3 as colours", "confidence as dominant")
    return images.select("page", "seq", X.image_prefilter("width * height * 3", "width", "height", "colours", "dominant").alias("reason"))


# --- classifiers
@_add("c11_content_type", f"""WITH s AS (SELECT doc_id, [{', '.join(_many('lower(text)', w) for w, _, _ in C.CONTENT_TYPES.values())}] AS n FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, CASE WHEN list_max(n) = 0 THEN 0 ELSE list_position(n, list_max(n)) END AS i FROM s)
SELECT doc_id, ['general', {', '.join(f"'{k}'" for k in C.CONTENT_TYPES)}][i + 1] AS kind, [1.0::DOUBLE, {', '.join(f'{m}::DOUBLE' for _, m, _ in C.CONTENT_TYPES.values())}][i + 1] AS multiplier, [0.1::DOUBLE, {', '.join(f'{t}::DOUBLE' for *_, t in C.CONTENT_TYPES.values())}][i + 1] AS temperature FROM b""")  # fmt: skip
def _c11(s, d):
    """Content type of a document with the batch multiplier and temperature that go with it."""
    low = _docs(s, d).where("text is not null").select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", C.content_type(F.col("low")).alias("c")).select("doc_id", "c.kind", "c.multiplier", "c.temperature")


@_add("c16_layout_complexity", f"""{_BOXES}, a AS (SELECT page, count(*) FILTER (label = 'table') AS tables, coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (label = 'figure'), 0) / (612 * 792) AS cover FROM boxes GROUP BY page)
SELECT page, tables > 0 AS has_tables, cover > 0.05 AS has_figures, CASE WHEN tables > 5 OR cover > 0.7 THEN 'very_complex' WHEN tables > 2 OR cover > 0.5 THEN 'complex' WHEN tables > 0 OR cover > 0.3 THEN 'moderate' ELSE 'simple' END AS detailed,
CASE WHEN cover > 0.4 THEN 'complex' WHEN cover > 0.2 OR tables > 0 THEN 'moderate' ELSE 'simple' END AS basic FROM a""")  # fmt: skip
def _c16(s, d):
    """A page's layout complexity as both readers tell it."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    pages = T.boxes(T.read(s, d, "part")).groupBy("page").agg(F.count_if(F.col("label") == "table").alias("tables"), (F.coalesce(F.sum(F.when(F.col("label") == "figure", area)), F.lit(0.0)) / (612 * 792)).alias("cover"))
    return pages.select("page", (F.col("tables") > 0).alias("has_tables"), (F.col("cover") > 0.05).alias("has_figures"), *[F.expr(C.layout_complexity("tables", "cover", reader)).alias(reader) for reader in ("detailed", "basic")])


_PAIRS = "p AS (SELECT i.page, i.seq AS figure_seq, t.seq AS text_seq, (i.x0 + i.x1 - t.x0 - t.x1) / 2 AS dx, (i.y0 + i.y1 - t.y0 - t.y1) / 2 AS dy FROM boxes i JOIN boxes t ON i.page = t.page AND i.label = 'figure' AND t.label = 'text')"
_SIDE = "CASE WHEN abs(dy) > abs(dx) THEN CASE WHEN dy < 0 THEN 'above' ELSE 'below' END WHEN dx < 0 THEN 'left' ELSE 'right' END"
_RELATION = f"CASE {_SIDE} WHEN 'above' THEN 'before' WHEN 'below' THEN 'after' ELSE 'alongside' END"


def _figure_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each figure with the texts of its page and the distance of their centres; a page holds a bounded number of boxes."""
    boxes = T.boxes(T.read(s, d, "part"))
    center = lambda a, b: (F.col(a) + F.col(b)) / 2
    figures = boxes.where("label = 'figure'").select("page", F.col("seq").alias("figure_seq"), center("x0", "x1").alias("ix"), center("y0", "y1").alias("iy"))
    texts = boxes.where("label = 'text'").select("page", F.col("seq").alias("text_seq"), (center("x0", "x1")).alias("tx"), center("y0", "y1").alias("ty"))
    return figures.join(texts, "page").withColumn("dx", F.col("ix") - F.col("tx")).withColumn("dy", F.col("iy") - F.col("ty"))


@_add("c27_relative_position", f"{_BOXES}, {_PAIRS} SELECT page, figure_seq, text_seq, {_SIDE} AS position, {_RELATION} AS relation FROM p")
def _c27(s, d):
    """Where a figure lies from a text, along the longer axis, and the order that gives."""
    placed = _figure_pairs(s, d).withColumn("position", F.expr(C.relative_position("dx", "dy")))
    return placed.select("page", "figure_seq", "text_seq", "position", F.expr(C.spatial_relation("position")).alias("relation"))


@_add("j27_image_placement", f"""{_BOXES}, {_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY page, figure_seq ORDER BY dx * dx + dy * dy, text_seq) AS r FROM p), k AS (SELECT page, figure_seq, text_seq, {_RELATION} AS relation FROM n WHERE r = 1),
c AS (SELECT i.page, i.seq AS figure_seq, t.seq AS caption_seq, row_number() OVER (PARTITION BY i.page, i.seq ORDER BY t.y0 - i.y1, t.seq) AS r FROM boxes i JOIN boxes t ON i.page = t.page AND i.label = 'figure' AND t.label IN ('text', 'title')
WHERE t.y0 - i.y1 BETWEEN 0 AND greatest(50, least(100, (i.y1 - i.y0) / 2)) AND (least(i.x1, t.x1) - greatest(i.x0, t.x0)) / (i.x1 - i.x0) > 0.2)
SELECT k.page, k.figure_seq, k.text_seq, relation, caption_seq, CASE relation WHEN 'before' THEN k.text_seq - 0.5::DOUBLE ELSE k.text_seq + 0.5::DOUBLE END AS position FROM k LEFT JOIN (SELECT * FROM c WHERE r = 1) c USING (page, figure_seq)""")  # fmt: skip
def _j27(s, d):
    """Nearest text, caption and reading position of each figure."""
    from foliospark.operators import layout as L

    near = _figure_pairs(s, d).groupBy("page", "figure_seq").agg(F.min(F.struct(F.expr("dx * dx + dy * dy").alias("d2"), "text_seq", "dx", "dy")).alias("b"))
    placed = near.select("page", "figure_seq", "b.text_seq", F.expr(C.spatial_relation(f"({C.relative_position('b.dx', 'b.dy')})")).alias("relation"))
    found = L.captions(T.boxes(T.read(s, d, "part"))).select("page", "figure_seq", F.col("text_seq").alias("caption_seq"))
    position = F.when(F.col("relation") == "before", F.col("text_seq") - 0.5).otherwise(F.col("text_seq") + 0.5)
    return placed.join(found, ["page", "figure_seq"], "left").select("page", "figure_seq", "text_seq", "relation", "caption_seq", position.alias("position"))


_FOOT = r"^\s*(?:\[([0-9]+)\]|\(([0-9]+)\)|([0-9]+)\.|([¹²³⁴⁵⁶⁷⁸⁹⁰]+)|(\*+))"


@_add("c08_typed_block", f"""{_LINES}, m AS (SELECT doc_id, seq, {MARKED} AS md FROM lines), r AS (SELECT doc_id, seq, md, trim(md, {_WS}) AS t, regexp_extract(md, '^(#+)\\s', 1) AS hashes FROM m),
k AS (SELECT *, CASE WHEN hashes <> '' THEN 'heading' WHEN regexp_matches(t, '^\\s*\\[[0-9]+\\]|^\\s*\\([0-9]+\\)|^\\s*[0-9]+\\.|^\\s*[¹²³⁴⁵⁶⁷⁸⁹⁰]+|^\\s*\\*+') OR (length(t) < 300 AND {_any('lower(t)', ('note:', 'see', 'cf.', 'ibid'))}) THEN 'footnote'
WHEN (CASE WHEN contains(t, '|') THEN 1 ELSE 0 END + CASE WHEN contains(t, chr(9)) THEN 1 ELSE 0 END + CASE WHEN contains(t, '  +') THEN 1 ELSE 0 END) >= 2 THEN 'table'
WHEN regexp_matches(t, '(?i)^([•*-]|[0-9]+[.)]|[a-z][.)]|[ivxlcdm]+[.)])\\s+') THEN 'list_item'
WHEN regexp_matches(t, '\\$.*?\\$|\\\\\\[.*?\\\\\\]|\\\\begin\\{{(equation|align)\\}}|[∑∏∫∂∇±×÷≤≥≠≈∞αβγδεζηθικλμνξοπρστυφχψω]') THEN 'formula' ELSE 'paragraph' END AS kind FROM r WHERE t <> '')
SELECT doc_id, seq, kind, CASE WHEN kind = 'heading' THEN least(length(hashes), 6) END AS level,
CASE WHEN kind = 'list_item' THEN (length(md) - length(ltrim(md, {_WS}))) // 4 + 1 END AS list_level, CASE WHEN kind = 'list_item' THEN regexp_matches(t, '(?i)^([0-9]+|[a-z]|[ivxlcdm]+)[.)]\\s+') END AS ordered,
CASE WHEN kind = 'list_item' THEN try_cast(regexp_extract(t, '^([0-9]+)[.)]\\s+', 1) AS BIGINT) END AS item_number,
CASE WHEN kind = 'footnote' THEN coalesce(nullif(regexp_extract(t, '^\\[([0-9]+)\\]', 1), ''), nullif(regexp_extract(t, '^\\(([0-9]+)\\)', 1), ''), nullif(regexp_extract(t, '^([0-9]+)\\.', 1), ''), nullif(regexp_extract(t, '^([¹²³⁴⁵⁶⁷⁸⁹⁰]+)', 1), ''), regexp_extract(t, '^(\\*+)', 1)) END AS reference FROM k""")  # fmt: skip
def _c08(s, d):
    """Typed blocks of markdown lines: heading, footnote, table, list item, formula, paragraph, with their fields."""
    return M.typed_blocks(_marked(s, d).select("doc_id", "seq", F.col("md").alias("text")))


# --- markdown
@_add("w18_markdown_items", f"""{_LINES}, m AS (SELECT doc_id, seq, trim({MARKED}, {_WS}) AS t FROM lines),
k AS (SELECT *, CASE WHEN regexp_matches(t, '^#{{1,6}}\\s+.+$') THEN 'h' || length(regexp_extract(t, '^#+')) WHEN regexp_matches(t, '^([-*+]|[0-9]+\\.)\\s+.+$') THEN 'list_item' END AS mark FROM m),
r AS (SELECT *, count(mark) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM k),
i AS (SELECT doc_id, seq, mark AS kind, trim(regexp_replace(t, '^(#+|[-*+]|[0-9]+\\.)\\s+', ''), {_WS}) AS text FROM r WHERE mark IS NOT NULL UNION ALL
SELECT doc_id, min(seq), 'paragraph', trim(string_agg(t, chr(10) ORDER BY seq), {_WS}) FROM r WHERE mark IS NULL GROUP BY doc_id, run HAVING max(t) <> '')
SELECT doc_id, seq, kind, md5(text) AS text_md5 FROM i""")  # fmt: skip
def _w18(s, d):
    """Structured items of marked-up text; headings and list items end the running paragraph."""
    return M.structured_items(_marked(s, d).select("doc_id", "seq", F.col("md").alias("text"))).select("doc_id", "seq", "kind", F.md5("text").alias("text_md5"))


_PREFIX = r"^(\s*(?:#{1,6}|[-*+]|\d+\.)\s+)"


@_add("f24_markdown_nodes", f"""{_LINES}, m AS (SELECT doc_id, seq, {FENCED} AS md FROM lines), p AS (SELECT *, starts_with(ltrim(md), '```') AS fence, sum(CASE WHEN starts_with(ltrim(md), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM m),
q AS (SELECT *, NOT fence AND n % 2 = 0 AND trim(md, {_WS}) <> '' AS node, regexp_extract(md, '^(\\s*(#{{1,6}}|[-*+]|[0-9]+\\.)\\s+)', 1) AS head FROM p)
SELECT doc_id, count(*) FILTER (node) AS nodes, md5(string_agg(md, chr(10) ORDER BY seq)) AS original_md5, md5(string_agg(CASE WHEN node THEN head || '[xx] ' || substr(md, length(head) + 1) ELSE md END, chr(10) ORDER BY seq)) AS translated_md5 FROM q GROUP BY doc_id""")  # fmt: skip
def _f24(s, d):
    """Translatable nodes of markdown outside code, and the document rebuilt from them as it was and translated."""
    nodes = M.text_nodes(_marked(s, d, FENCED).select("doc_id", "seq", F.col("md").alias("text")))
    rebuilt = nodes.withColumn("same", M.rebuilt(F.col("node_text"))).withColumn("made", M.rebuilt(F.concat(F.lit("[xx] "), "node_text")))
    return rebuilt.groupBy("doc_id").agg(F.count_if("is_node").alias("nodes"), F.md5(G.ordered_text("same", "\n")).alias("original_md5"), F.md5(G.ordered_text("made", "\n")).alias("translated_md5"))


@_add("o10_translation_ladder", f"""{_LINES}, m AS (SELECT doc_id, seq, {MARKED} AS md FROM lines), g AS (SELECT doc_id, count(*) FILTER (regexp_matches(md, '^#{{1,6}}\\s')) AS heads, count(*) FILTER (seq = 0 AND regexp_matches(md, '^#{{1,6}}\\s')) AS first_head,
string_agg(md, ' ' ORDER BY seq) AS flat, string_agg('[xx] ' || md, chr(10) ORDER BY seq) AS loose, string_agg(CASE WHEN trim(md, {_WS}) = '' THEN md ELSE regexp_extract(md, '^(\\s*(#{{1,6}}|[-*+]|[0-9]+\\.)\\s+)', 1) || '[xx] ' || substr(md, length(regexp_extract(md, '^(\\s*(#{{1,6}}|[-*+]|[0-9]+\\.)\\s+)', 1)) + 1) END, chr(10) ORDER BY seq) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN 10 * first_head >= 7 * heads THEN 'whole' ELSE 'lines' END AS step, md5(CASE WHEN 10 * first_head >= 7 * heads THEN flat ELSE kept END) AS text_md5 FROM g""")  # fmt: skip
def _o10(s, d):
    """The first candidate translation that keeps seven tenths of the headings: the whole text as one line, else line by line."""
    rows = _marked(s, d).withColumn("head", F.regexp_extract("md", _PREFIX, 1))
    line = F.when(F.expr(f"{SPARK.strip('md')} = ''"), F.col("md")).otherwise(F.concat("head", F.lit("[xx] "), F.expr("substr(md, length(head) + 1)")))
    texts = rows.withColumn("line", line).groupBy("doc_id").agg(G.ordered_text("md", "\n").alias("text"), G.ordered_text("md", " ").alias("whole"), G.ordered_text("line", "\n").alias("lines"))
    heads = lambda c: F.regexp_count(c, F.lit(r"(?m)^#{1,6}\s"))
    step = F.when(10 * heads("whole") >= 7 * heads("text"), "whole").otherwise("lines")
    return texts.withColumn("step", step).select("doc_id", "step", F.md5(F.when(F.col("step") == "whole", F.col("whole")).otherwise(F.col("lines"))).alias("text_md5"))


@_add("a35_markup_bundle", f"""{_LINES}, m AS (SELECT doc_id, seq, {MARKED} AS md FROM lines) SELECT doc_id, count(*) FILTER (regexp_matches(md, '^#{{1,6}}\\s+\\S')) AS sections, count(*) FILTER (regexp_matches(md, '^\\s*([-*+]|[0-9]+\\.)\\s+')) AS items,
count(*) FILTER (regexp_matches(md, '\\|.*\\|')) AS table_rows, count(*) FILTER (regexp_matches(md, '\\$[^$]+\\$')) AS equations, count(*) FILTER (regexp_matches(md, '(?i)(figure|fig\\.?)\\s*[0-9]+')) AS figures,
CAST(sum(len(list_filter(str_split_regex(md, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words, CAST(sum(length(md)) + count(*) - 1 AS BIGINT) AS chars FROM m GROUP BY doc_id""")  # fmt: skip
def _a35(s, d):
    """What a marked-up document holds, in one row."""
    return M.bundle(_marked(s, d).select("doc_id", "seq", F.col("md").alias("text")))


# --- joins and reconciliation
_TRANSLATABLE = "block_type in ('h1', 'h2', 'h3', 'paragraph', 'list_item', 'caption')"


@_add("j03_ordinal_merge", f"""{_LINES}, s AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place FROM lines WHERE {_TRANSLATABLE}),
t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place, '[xx] ' || text AS translated FROM lines WHERE {_TRANSLATABLE}) SELECT s.doc_id, s.seq, s.place, md5(translated) AS translated_md5 FROM s LEFT JOIN (SELECT * FROM t WHERE place % 50 <> 0) t USING (doc_id, place)""")  # fmt: skip
def _j03(s, d):
    """Translations, a list in order, put into the slots of translatable lines by their place; a missing one leaves its slot empty and shifts nothing."""
    slots = _lines(s, d).where(_TRANSLATABLE)
    results = G.numbered(slots, "place").select("doc_id", "place", F.concat(F.lit("[xx] "), "text").alias("translated")).where("place % 50 <> 0")
    return G.zip_by_place(slots, results).select("doc_id", "seq", "place", F.md5("translated").alias("translated_md5"))


_VISUAL = "SELECT doc_id, page % 3 + 1 AS page_num, min(seq) AS visual_seq FROM boxes WHERE label = 'figure' GROUP BY doc_id, page"
_BLOCKS_SQL = f"""WITH {T.LINES_SQL}, {T.BOXES_SQL}, k AS (SELECT doc_id, seq, page_num, CASE WHEN seq % 9 = 4 THEN 'placeholder' WHEN seq % 9 = 7 THEN 'table' WHEN block_type IN ('h1', 'h2', 'h3') OR seq % 8 = 0 THEN 'heading' ELSE 'paragraph' END AS role FROM lines),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS block_num FROM k), b AS (SELECT n.*, visual_seq FROM n LEFT JOIN ({_VISUAL}) v ON n.doc_id = v.doc_id AND n.page_num = v.page_num AND role = 'placeholder')"""


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    """Markup blocks with the first visual element of their page where they hold its place."""
    role = F.expr("case when seq % 9 = 4 then 'placeholder' when seq % 9 = 7 then 'table' when block_type in ('h1', 'h2', 'h3') or seq % 8 = 0 then 'heading' else 'paragraph' end")
    blocks = G.numbered(_lines(s, d).withColumn("role", role), "block_num")
    visuals = T.boxes(T.read(s, d, "part")).where("label = 'figure'").withColumn("page_num", F.expr("page % 3 + 1"))
    return M.reconcile(blocks, visuals)


@_add("p34_reconciled_blocks", f"{_BLOCKS_SQL} SELECT doc_id, block_num, CASE role WHEN 'placeholder' THEN 'image' ELSE role END AS kind, page_num, visual_seq FROM b WHERE role IN ('heading', 'paragraph') OR visual_seq IS NOT NULL")
def _p34(s, d):
    """Blocks that the reconciled document keeps: matched images, headings, paragraphs; numbers count the dropped ones too."""
    return M.kept_blocks(_reconciled(s, d)).select("doc_id", "block_num", "kind", "page_num", "visual_seq")


@_add("o07_reconciliation", f"{_BLOCKS_SQL} SELECT doc_id, count(*) AS blocks, count(visual_seq) AS images, count(*) FILTER (role = 'heading') AS headings, count(*) FILTER (role = 'paragraph') AS paragraphs, count(*) FILTER (role = 'table' OR (role = 'placeholder' AND visual_seq IS NULL)) AS dropped FROM b GROUP BY doc_id")
def _o07(s, d):
    """Each document's reconciliation in numbers."""
    kind = F.col("kind")
    return _reconciled(s, d).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count("visual_seq").alias("images"), F.count_if(kind == "heading").alias("headings"), F.count_if(kind == "paragraph").alias("paragraphs"), F.count_if(kind == "dropped").alias("dropped"))


# --- context and order
_SENTENCES = "list_filter(str_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@_add("w03_chunk_context", f"""WITH d AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, ss, unnest(range(0, len(ss), 4)) AS i FROM d)
SELECT doc_id, i // 4 AS chunk, CASE WHEN i = 0 THEN '' ELSE right(array_to_string(ss[i - 1:i], ' '), 200) END AS before, left(array_to_string(ss[i + 5:i + 6], ' '), 200) AS after FROM c""")  # fmt: skip
def _w03(s, d):
    """Chunks of four sentences with two sentences, at most 200 characters, on either side."""
    return G.chunk_context(_docs(s, d).where("text is not null").select("doc_id", F.expr(S.sentences(SPARK, "text")).alias("sentences")))


@_add("w26_adjacent_context", f"{_LINES} SELECT doc_id, seq, coalesce(right(lag(text) OVER w, 100), '') AS before, coalesce(left(lead(text) OVER w, 100), '') AS after FROM lines WHERE {_TRANSLATABLE} WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def _w26(s, d):
    """The neighbouring translatable lines, 100 characters of each."""
    return G.neighbour_context(_lines(s, d).where(_TRANSLATABLE))


@_add("t03_task_priority", f"{_LINES} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN starts_with(block_type, 'h') THEN 1 WHEN block_type IN ('paragraph', 'caption') THEN 2 ELSE 3 END, seq) AS turn FROM lines")
def _t03(s, d):
    """Translation tasks by priority, in document order among equals."""
    return G.numbered(_lines(s, d), "turn", F.expr(C.role_priority(SPARK, "block_type")), F.col("seq")).select("doc_id", "seq", "turn")


@_add("t08_result_order", f"{_BOXES} SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, seq) AS place FROM boxes")
def _t08(s, d):
    """Results of a document by page, then position."""
    return G.numbered(T.boxes(T.read(s, d, "part")), "place", F.col("page"), F.col("y0"), F.col("seq")).select("doc_id", "page", "seq", "place")


_LEVEL = "case when seq % 24 = 0 then 1 else 2 end"
_KNOWN_PAGE = "case when seq % 5 = 0 then null else page_num + (seq * 7) % 3 end"


@_add("t09_contents_order", f"{_LINES}, e AS (SELECT doc_id, seq, {_LEVEL} AS level, {_KNOWN_PAGE} AS page FROM lines WHERE seq % 8 = 0) SELECT doc_id, seq, page, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS LAST, level, seq) AS place FROM e")
def _t09(s, d):
    """Entries of a table of contents by page, those without one last, then level."""
    entries = _lines(s, d).where("seq % 8 = 0").select("doc_id", "seq", F.expr(_LEVEL).alias("level"), F.expr(_KNOWN_PAGE).alias("page"))
    return G.numbered(entries, "place", F.col("page").asc_nulls_last(), F.col("level"), F.col("seq")).select("doc_id", "seq", "page", "place")


@_add("t10_longest_term_first", "SELECT s_suppkey, replace(replace(replace(s_name, 'Supplier#0000', '<1>'), 'Supplier#', '<2>'), 'Supplier', '<3>') AS text FROM supplier")
def _t10(s, d):
    """A glossary applied longest term first, so that no term is lost inside a longer one."""
    terms = [("Supplier", "<3>"), ("Supplier#0000", "<1>"), ("Supplier#", "<2>")]
    return T.read(s, d, "supplier").select("s_suppkey", G.longest_first(F.col("s_name"), terms).alias("text"))


# --- sources, sinks, caches
@_add("s12_embedding_cache", "SELECT 'k' || item_id AS cache_key, text AS original_text, len(embedding)::BIGINT AS dims, round(sqrt(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))), 6) AS norm FROM benchmark JOIN embeddings ON item_id = vec_id WHERE vec_id % 7 <> 0")
def _s12(s, d):
    """Cache entries with their vectors; entries without one are dropped."""
    entries = T.read(s, d, "benchmark").select(F.concat(F.lit("k"), "item_id").alias("cache_key"), F.col("text").alias("original_text"))
    vectors = T.read(s, d, "embeddings").where("vec_id % 7 <> 0").select(F.concat(F.lit("k"), "vec_id").alias("cache_key"), "embedding")
    joined = T.embedding_cache(entries, vectors)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return joined.select("cache_key", "original_text", F.size("embedding").cast("long").alias("dims"), F.round(norm, 6).alias("norm"))


_INPUT = "concat('/in/', source, ' : report+', doc_id, '--draft__', lang, '?.pdf')"


@_add("s26_output_paths", f"""WITH p AS (SELECT doc_id, {_INPUT} AS path FROM documents), f AS (SELECT doc_id, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.*?)(\\.[^.]*)?$', 1) AS stem FROM p),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(stem, '[<>:"/\\\\|?*+]', '_', 'g'), '-{{2,}}', '-', 'g'), '_{{2,}}', '_', 'g'), ' ._-') AS clean FROM f) SELECT doc_id, '/out/' || CASE WHEN clean = '' THEN 'sanitized_document' ELSE left(clean, 100) END AS folder FROM c""")  # fmt: skip
def _s26(s, d):
    """The output folder of each input file: its name without characters that file systems refuse, at most 100 long."""
    return T.read(s, d, "documents").select("doc_id", T.output_folder(F.expr(_INPUT), "/out/").alias("folder"))


@_add("s27_batch_quarantine", """WITH f AS (SELECT user_id AS file, event_id % 4 AS batch, count(*) AS failures, max(event_type) AS error FROM events GROUP BY user_id, event_id % 4)
SELECT file, batch, failures, batch * 5 AS start_page, batch * 5 + 4 AS end_page, error, concat(file, '_batch_', batch, '_quarantine.json') AS name FROM f WHERE failures >= 3""")  # fmt: skip
def _s27(s, d):
    """Batches that failed three times or more, as dead letters."""
    failed = T.read(s, d, "events").select(F.col("user_id").alias("file"), F.expr("event_id % 4").alias("batch"), F.col("event_type").alias("error"))
    return T.quarantined(failed, most=3, batch_pages=5)


@_add("s33_heuristic_detections", f"""{_BOXES}, found AS (SELECT doc_id, page, seq, label, confidence FROM boxes WHERE confidence >= 0.97), none AS (SELECT DISTINCT doc_id FROM boxes EXCEPT SELECT doc_id FROM found)
SELECT *, 'model' AS method FROM found UNION ALL SELECT doc_id, page, seq, 'figure', 0.8, 'heuristic' FROM boxes JOIN none USING (doc_id) WHERE label = 'figure'""")  # fmt: skip
def _s33(s, d):
    """Detections of the model; embedded images stand in where a document has none."""
    boxes = T.boxes(T.read(s, d, "part"))
    return T.with_heuristics(boxes.where("confidence >= 0.97"), boxes.where("label = 'figure'"))


# --- scalars
@_add("f06_chunk_dispatch", f"""{_LINES}, c AS (SELECT doc_id, seq, CASE WHEN block_type IN ('h1', 'h2', 'h3') THEN 'heading' WHEN block_type IN ('list_item', 'caption') THEN block_type WHEN block_type = 'table' THEN 'table_content' WHEN block_type = 'equation' THEN 'mathematical' ELSE 'paragraph' END AS kind, {_SENTENCES} AS ss FROM lines)
SELECT doc_id, seq, kind, CASE WHEN kind = 'paragraph' THEN greatest(1, (len(ss) + 3) // 4) ELSE 1 END AS chunks FROM c""")  # fmt: skip
def _f06(s, d):
    """The chunking each line gets: one chunk but for paragraphs, which take four sentences a chunk."""
    rows = _lines(s, d).select("doc_id", "seq", F.expr(C.text_type("block_type")).alias("kind"), F.size(F.expr(S.sentences(SPARK, "text"))).alias("n"))
    return rows.select("doc_id", "seq", "kind", F.expr("cast(if(kind = 'paragraph', greatest(1, (n + 3) div 4), 1) as bigint)").alias("chunks"))


_MICROS = "unix_micros(cast(ts as timestamp))"


@_add("f26_retry_and_quota", """WITH w AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS attempt FROM events)
SELECT event_id, recent <= 60 AS allowed, [1, 2, 5, 10, 30][least(attempt, 4) + 1]::BIGINT AS delay, CAST(least(2 * pow(2, least(attempt, 10)), 2048) AS BIGINT) AS backoff FROM w""")  # fmt: skip
def _f26(s, d):
    """Whether the quota of 60 requests in a trailing minute allows a request, and the waits before a key's next attempt."""
    t = F.expr(_MICROS)
    rows = T.read(s, d, "events").withColumn("recent", F.count("*").over(Window.partitionBy("user_id").orderBy(t).rangeBetween(-60_000_000, 0)))
    rows = rows.withColumn("attempt", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1)
    return rows.select("event_id", (F.col("recent") <= 60).alias("allowed"), F.expr("cast(array(1, 2, 5, 10, 30)[least(attempt, 4)] as bigint)").alias("delay"), F.expr("shiftleft(2L, least(attempt, 10))").alias("backoff"))


@_add("f29_duration_speed", f"""{_SPANS} SELECT trace_id, span_id, duration_ms, CASE WHEN duration_ms > 0 THEN (found + 1) * 60000 / duration_ms END AS words_per_minute,
date_diff('microsecond', lag(started) OVER (PARTITION BY trace_id ORDER BY started, span_id), started) AS gap_us FROM spans""")  # fmt: skip
def _f29(s, d):
    """Durations of spans, the words a minute they make, and the gap since the span before."""
    spans, w = T.spans(T.read(s, d, "events")), Window.partitionBy("trace_id").orderBy("started", "span_id")
    micros = F.expr("unix_micros(cast(started as timestamp))")
    return spans.select("trace_id", "span_id", "duration_ms", F.expr("if(duration_ms > 0, (found + 1) * 60000 / duration_ms, null)").alias("words_per_minute"), (micros - F.lag(micros).over(w)).alias("gap_us"))


@_add("f33_correction_prompts", f"""{_LINES}, m AS (SELECT doc_id, seq, {FENCED} AS md FROM lines), v AS (SELECT *, CASE WHEN regexp_matches(md, '\\|.*\\|') THEN 'table' WHEN regexp_matches(md, '```|^\\s*(def|class|function)\\s') THEN 'code' WHEN regexp_matches(md, '\\$[^$]+\\$|\\\\[a-zA-Z]+\\{{') THEN 'latex' WHEN regexp_matches(md, '^\\s*([-*+]|[0-9]+\\.)\\s+') THEN 'list' ELSE 'general' END AS kind FROM m)
SELECT doc_id, seq, kind, md5('The ' || CASE kind WHEN 'general' THEN 'text' ELSE kind END || ' below lost its structure in translation.' || chr(10) || 'Issues: markers missing' || chr(10) || 'Fixes: ' || CASE kind WHEN 'table' THEN 'keep all rows, columns and pipes' WHEN 'code' THEN 'keep fences, names and indentation' WHEN 'latex' THEN 'keep commands and delimiters' WHEN 'list' THEN 'keep markers, order and levels' ELSE 'keep paragraphs and headings' END || chr(10) || 'Original: ' || md || chr(10) || 'Translation: [xx] ' || md || chr(10) || 'Language: fr') AS prompt_md5 FROM v""")  # fmt: skip
def _f33(s, d):
    """Prompts that ask for a corrected translation, by the kind of structure that was lost."""
    rows = _marked(s, d, FENCED).select("doc_id", "seq", "md", F.expr(C.validator_type(SPARK, "md")).alias("found"))
    kind = F.when(F.col("found") == "unknown", "general").otherwise(F.col("found"))
    return rows.withColumn("kind", kind).select("doc_id", "seq", "kind", F.md5(M.correction_prompt("kind", F.col("md"), F.concat(F.lit("[xx] "), "md"), "markers missing", "fr")).alias("prompt_md5"))


@_add("f36_visual_processing", f"""{_BOXES} SELECT page, seq, CASE label WHEN 'table' THEN '<table><tr><td>' || replace(text, ' ', '</td><td>') || '</td></tr></table>' WHEN 'title' THEN '$$' || text || '$$' ELSE text END AS made,
CASE label WHEN 'table' THEN 'html' WHEN 'title' THEN 'latex' ELSE 'as_is' END AS form FROM boxes""")  # fmt: skip
def _f36(s, d):
    """Tables as HTML, formulas (titles stand for them) as LaTeX, all else as it is."""
    return T.boxes(T.read(s, d, "part")).select("page", "seq", M.visual_markup("label", "text").alias("made"), F.expr("case label when 'table' then 'html' when 'title' then 'latex' else 'as_is' end").alias("form"))


# --- orchestrations
@_add("o06_intelligent_pipeline", f"""{_LINES}, i AS (SELECT doc_id, seq, page_num, text, {C.importance(CHECK, "text", "block_type", "page_num")} AS importance FROM lines), r AS (SELECT *, {C.routing_tool(CHECK, "text", "importance")} AS tool FROM i)
SELECT doc_id, count(*) AS blocks, count(*) FILTER (tool = 'skip') AS skipped, md5(string_agg(CASE WHEN tool = 'skip' THEN text ELSE '[' || tool || '] ' || text END, chr(10) ORDER BY page_num, seq)) AS text_md5 FROM r GROUP BY doc_id""")  # fmt: skip
def _o06(s, d):
    """Blocks routed to tools, processed in groups, skipped ones kept as they are, and put together in order."""
    routed = T.weighed(_lines(s, d)).withColumn("tool", F.expr(C.routing_tool(SPARK, "text", "importance", "low")))
    made = routed.withColumn("made", F.when(F.col("tool") == "skip", F.col("text")).otherwise(F.concat(F.lit("["), "tool", F.lit("] "), "text")))
    return made.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("tool") == "skip").alias("skipped"), F.md5(G.ordered_text("made", "\n")).alias("text_md5"))


@_add("o11_trace_lifecycle", f"""{_SPANS}, l AS (SELECT *, lead(started) OVER (PARTITION BY trace_id ORDER BY started, span_id) AS finished, lag(span_id) OVER (PARTITION BY trace_id ORDER BY started, span_id) AS parent FROM spans)
SELECT trace_id, span_id, parent, finished IS NULL AS open, date_diff('microsecond', started, finished) AS took_us FROM l""")  # fmt: skip
def _o11(s, d):
    """Start and finish of spans: a span ends where its trace's next one starts, the last one is open."""
    micros, w = F.expr("unix_micros(cast(started as timestamp))"), Window.partitionBy("trace_id").orderBy("started", "span_id")
    rows = T.spans(T.read(s, d, "events")).withColumn("ended", F.lead(micros).over(w))
    return rows.select("trace_id", "span_id", F.lag("span_id").over(w).alias("parent"), F.col("ended").isNull().alias("open"), (F.col("ended") - micros).alias("took_us"))
