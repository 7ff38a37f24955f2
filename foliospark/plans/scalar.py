"""Queries of single-row operators: predicates, classifiers, scores, extractors. One narrow projection each, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import classify as C
from foliospark.functions import predicates as P
from foliospark.functions import scores as S
from foliospark.functions.portable import CHECK, SPARK, Dialect, flag
from foliospark.sources import tables as T

Columns = Callable[[Dialect], dict[str, str]]


def _flags(**tests: Callable[[Dialect, str], str]) -> Columns:
    return lambda d: {name: flag(test(d, "text")) for name, test in tests.items()}


def _int(sql: str) -> str:
    return f"cast({sql} as bigint)"


#: Per line of every document.
LINES: dict[str, Columns] = {
    "p03_translatable_split": lambda d: {"translatable": "block_type in ('h1', 'h2', 'h3', 'paragraph', 'list_item', 'footnote', 'caption')"},
    "p05_skip_content": _flags(skip=P.skip_content),
    "p06_page_furniture": lambda d: {"furniture": flag(P.page_furniture(d, "text", "cast(seq * 31 % 792 as double)", "cast(seq * 31 % 792 + 12 as double)"))},
    "p07_page_number": _flags(page_number=P.page_number),
    "p08_processing_artifact": _flags(artifact=P.processing_artifact),
    "p13_markdown": _flags(markdown=P.markdown),
    "p14_footnote": _flags(footnote=P.footnote),
    "p15_table_diagram": _flags(table_line=P.table_line, formula_diagram=P.formula_diagram),
    "p16_math": _flags(math=P.math_content, equation=P.equation),
    "p17_code": _flags(code=P.code_block),
    "p18_diagram_chart_words": _flags(diagram=P.diagram_words, chart=P.chart_words),
    "p21_toc_page_score": lambda d: {"score": P.toc_score(d, "text"), "toc_line": flag(P.toc_line(d, "text"))},
    "p22_content_start_back_matter": _flags(starts=P.content_start, back=P.back_matter),
    "p23_heading_candidates": _flags(likely=P.likely_heading, pattern=P.heading_pattern, section=P.section_start),
    "p24_caption": _flags(caption=P.likely_caption, explicit=P.caption_mark),
    "p25_list_item": _flags(item=P.list_item, mark=P.list_mark),
    "p29_batch_size_guard": lambda d: {"over_limit": flag(P.over_model_limit(d, "text", "case when lang = 'en' then 100 else null end")), "tokens": S.token_estimate(d, "text")},
    "p31_pure_markdown_syntax": _flags(pure=P.markdown_syntax_only),
    "p32_equation_area": lambda d: {"confidence": f"cast(case when {d.like('text', P.EQUATION[4])} then 0.8 when {d.any_like('text', P.EQUATION[:4])} then 0.6 else 0 end as double)"},
    "p33_translated_copy": lambda d: {"original_text": "text", "content": "concat('[xx] ', text)", "block_id": S.block_id(d, "block_type", "page_num", "text")},
    "c01_importance": lambda d: {"importance": _importance(d)},
    "c02_strategy": lambda d: (lambda i: {
        "importance": i, "should_translate": f"{i} <> 'skip'", "model": f"case {i} when 'high' then 'strong' when 'skip' then null else 'fast' end",
        "temperature": f"cast(case {i} when 'high' then greatest(0.05, 0.1 - 0.02) when 'low' then least(0.3, 0.1 + 0.05) when 'medium' then 0.1 else null end as double)",
        "prompt_style": f"case {i} when 'high' then 'detailed' when 'medium' then 'standard' when 'low' then 'simple' else null end", "batch_priority": _int(f"case {i} when 'high' then 1 when 'medium' then 2 when 'low' then 3 else null end"), "quality_check": f"{i} = 'high'",
    })(_importance(d)),
    "c03_tool_routing": lambda d: {"tool": C.routing_tool(d, "text", _importance(d), "low" if d.spark else None)},
    "c06_block_factory": lambda d: {"block": "block_type", "level": _int("case block_type when 'h1' then 1 when 'h2' then 2 when 'h3' then 3 else null end")},
    "c09_text_block_type": lambda d: {"kind": C.text_block_type(d, "text")},
    "c20_markup_visual_type": lambda d: {"visual_type": C.markup_visual_type(d, "text")},
    "c21_heading_level": lambda d: {"toc_level": _int(C.toc_level(d, "text"))},
    "c22_markdown_item": lambda d: {"item": C.markdown_item(d, "text")},
    "c25_validator_dispatch": lambda d: {"validator": C.validator_type(d, "text")},
    "c29_potential_heading": lambda d: {"heading": C.potential_heading(d, "text")},
    "c30_role_priority": lambda d: {"priority": _int(C.role_priority(d, "block_type"))},
    "f03_block_ids": lambda d: {"block_id": S.block_id(d, "block_type", "page_num", "text")},
    "f04_sentence_split": lambda d: {"sentences": d.size(S.sentences(d, "text")), "joined": d.join(S.sentences(d, "text"), "|")},
    "f07_coherence": lambda d: {"score": S.coherence(d, "text", "block_type", d.size(S.sentences(d, "text")))},
    "f12_sanitizers": lambda d: {"xml": S.strip_control(d, "text"), "filename": S.safe_filename(d, "text")},
    "f13_cleaners": lambda d: {"clean": S.clean_markup(d, "text")},
    "f20_toc_line_parse": lambda d: {"title": S.toc_title(d, "text"), "page": S.toc_page(d, "text"), "is_entry": flag(P.toc_line(d, "text"))},
    "f22_html_render": lambda d: {"html": S.html_block(d, "block_type", "text")},
    "f23_prompt_builder": lambda d: {"prompt": "concat('Translate to French.', chr(10), 'Type: ', block_type, chr(10), 'Text: ', text)"},
    "f34_footnote_reference": lambda d: {"reference": S.footnote_reference(d, "text")},
    "f37_markdown_line": lambda d: {"prefix": d.extract("text", r"^(\s*(?:#{1,6}|[-*+]|\d+\.)\s+)"), "translated": f"concat({d.extract('text', r'^(\s*(?:#{1,6}|[-*+]|\d+\.)\s+)')}, '[xx] ', {d.replace('text', r'^\s*(?:#{1,6}|[-*+]|\d+\.)\s+', '')})"},
}

#: Per document.
DOCUMENTS: dict[str, Columns] = {
    "c10_document_type": lambda d: {"doc_type": C.argmax_words(d, "text", C.DOCUMENT_TYPES, "general")},
    "c13_theme": lambda d: {"theme": C.argmax_words(d, "text", C.THEMES, "general", occurrences=True)},
    "c31_markup_confidence": lambda d: {"confidence": C.markup_confidence(d, "text"), "mode": f"case when {C.markup_confidence(d, 'text')} >= 0.7 then 'keep' when {C.markup_confidence(d, 'text')} > 0.5 then 'hybrid' else 'fallback' end"},
    "f01_token_estimate": lambda d: {"tokens": S.token_estimate(d, "text")},
    "f02_cache_keys": lambda d: {"cache_key": S.cache_key(d, "text", "lang", "m1"), "context_key": S.context_key(d, "text", "lang", "source"), "similarity_key": S.similarity_key(d, "text")},
    "f05_math_chunk_split": lambda d: {"parts": d.size(d.keep(d.split("text", r"\n\s*\n"), "x <> ''"))},
    "f08_equations": lambda d: {"inline": d.size(d.extract_all("text", r"\$[^$]+\$")), "display": d.size(d.extract_all("text", r"\$\$[^$]+\$\$"))},
    "f09_tables": lambda d: {"table_rows": d.size(d.keep(d.split("text", r"\n"), d.like("x", r"\|.*\|"))), "pipes": d.count("text", "[|]")},
    "f10_sections_figures": lambda d: {"sections": d.size(d.extract_all("text", r"(?m)^#{1,6}\s+.+$")), "figures": d.join(d.distinct_sorted(d.extract_all("text", r"(?i)(?:figure|fig\.?)\s*(\d+)", 1)), ",")},
    "f11_metadata": lambda d: S.metadata(d, "text") | {"complexity": S.markup_complexity(d, "text")},
    "f16_structure_validator": lambda d: {"valid": flag(S.markdown_kept(d, "text", d.replace("text", r"\n", " "))), **{f"n_{k}": v for k, v in S.structure_counts(d, "text").items()}},
    "f17_markdown_validator": lambda d: {"kept": flag(S.markdown_kept(d, "text", d.replace("text", r"\n\n", " ")))},
    "f18_ocr_quality": lambda d: {"quality": S.ocr_quality(d, "text")},
    "f31_paragraph_split": lambda d: {"paragraphs": d.size(d.keep(d.each(d.split("text", r"\n\n"), d.strip("x")), "x <> ''"))},
    "f32_unified_visuals": lambda d: {"equations": d.size(d.extract_all("text", r"\$\$?[^$]+\$\$?")), "tables": d.size(d.extract_all("text", r"(?m)^\|.*\|$")), "images": d.size(d.extract_all("text", r"!\[[^\]]*\]\([^)]*\)"))},
}


#: Queries of lines whose importance is computed once, as a column.
WEIGHED = ("c01_importance", "c02_strategy", "c03_tool_routing")


def _importance(d: Dialect) -> str:
    return "importance" if d.spark else C.importance(d, "text", "block_type", "page_num")


def _line_query(columns: Columns, weighed: bool = False) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = T.lines(T.spread(T.read(spark, sf_dir, "documents"), "doc_id"))
        rows = T.weighed(rows) if weighed else rows
        return rows.select("doc_id", "seq", *[F.expr(sql).alias(name) for name, sql in columns(SPARK).items()])

    cols = ", ".join(f"{sql} AS {name}" for name, sql in columns(CHECK).items())
    return build, f"WITH {T.LINES_SQL} SELECT doc_id, seq, {cols} FROM lines"


def _document_query(columns: Columns) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = T.spread(T.read(spark, sf_dir, "documents"), "doc_id")
        return rows.select("doc_id", *[F.expr(sql).alias(name) for name, sql in columns(SPARK).items()])

    cols = ", ".join(f"{sql} AS {name}" for name, sql in columns(CHECK).items())
    return build, f"SELECT doc_id, {cols} FROM documents"


CATALOG = {name: _line_query(c, name in WEIGHED) for name, c in LINES.items()} | {name: _document_query(c) for name, c in DOCUMENTS.items()}
