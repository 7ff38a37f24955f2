"""Predicates over block texts (portable expressions)."""

from __future__ import annotations

from foliospark.functions.portable import Dialect, cases

# Patterns and word lists that decide results.
SKIP = (r"^\s*all rights reserved\s*$", r"^\s*copyright\s+\d{4}", r"^\s*confidential\s*$", r"^\s*εμπιστευτικό\s*$", r"^\s*page\s+\d+\s*$", r"^\s*σελίδα\s+\d+\s*$", r"^\s*\d+\s*$", r"^\s*[ivxlcdm]+\s*$")
CODE_LINE = (r"^\s*(def|class|import|from|if|for|while|try|except)\s+", r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*", r"^\s*#.*$", r"^\s*//.*$", r"^\s*/\*.*\*/\s*$", r"^\s*<[^>]+>\s*$")
PAGE_FURNITURE = (r"^\d+\s*$", r"^page\s+\d+$", r"^\d+\s*/\s*\d+$", r"^\d+\s+of\s+\d+$", r"^\d+\s*-\s*\d+$", r"^\s*\d{1,3}\s*$")
HEADER_BAND = (r"^chapter\s+\d+", r"^section\s+\d+", r"^\d+\.\d+")
FOOTER_PARTS = ("copyright", "©", "all rights reserved", "confidential", "draft", "www.", "http", "@")
METADATA = (r"^document\s+title", r"^author:", r"^date:", r"^version:", r"^revision:", r"^draft", r"^confidential", r"^internal\s+use", r"^proprietary")
PAGE_NUMBER = (r"^page\s+\d+$", r"^p\.?\s*\d+$", r"^\d+\s*of\s*\d+$", r"^-\s*\d+\s*-$")
ARTIFACT = (r"\[MISSING_PAGE\]", r"\[PAGE_BREAK\]", r"\[ERROR\]", r"\\begin\{.*?\}", r"\\end\{.*?\}", r"```\s*$")
CODE_BLOCK = (r"```", r"^\s*def\s+\w+\(", r"^\s*class\s+\w+", r"^\s*import\s+\w+", r"^\s*from\s+\w+\s+import", r"^\s*function\s+\w+\(", r"^\s*var\s+\w+\s*=", r"^\s*\w+\s*=\s*function\(")
EQUATION = (r"\$.*?\$", r"\\\[.*?\\\]", r"\\begin\{equation\}", r"\\begin\{align\}", r"[∑∏∫∂∇±×÷≤≥≠≈∞]", r"[αβγδεζηθικλμνξοπρστυφχψω]")
MARKDOWN = (r"^#{1,6}\s+", r"\*\*.*?\*\*", r"\*.*?\*", r"```", r"^\s*[-*+]\s+", r"^\s*\d+\.\s+")
FOOTNOTE = (r"^\s*\[\d+\]", r"^\s*\(\d+\)", r"^\s*\d+\.", r"^\s*[¹²³⁴⁵⁶⁷⁸⁹⁰]+", r"^\s*\*+")
LIST_ITEM = (r"^\s*[•\-*]\s+", r"^\s*\d+[.)]\s+", r"^\s*[a-zA-Z][.)]\s+", r"^\s*[ivxlcdm]+[.)]\s+")
LIST_MARK = (r"^[•·▪▫‣⁃]\s+", r"^[-*+]\s+", r"^\d+[.)]\s+", r"^[a-z][.)]\s+", r"^\([a-z0-9]+\)\s+")
MATH_ROUTE = (r"\$[^$]+\$", r"\\begin\{(equation|align|gather)\}", r"[∑∏∫∂∇∆∞±≤≥≠≈∈∉⊂⊃∪∩]", r"\\(alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|omega)", r"\\(sin|cos|tan|log|ln|exp|sqrt|frac)")
MATH_WORDS = ("theorem", "lemma", "proof", "equation", "formula", "derivative", "integral")
TABLE_ROUTE = (r"\|[^|]*\|[^|]*\|", r"\\begin\{(table|tabular)\}")
TABLE_MARKUP = (r"\|.*\|.*\|", r"\+[-=]+\+", r"\\begin\{tabular\}", r"\\begin\{table\}")
MATH_MARKUP = (r"\$.*\$", r"\\begin\{equation\}", r"\\begin\{align\}", r"\\frac\{", r"\\sum", r"\\int", r"\\alpha|\\beta|\\gamma", r"\\mathbf|\\mathrm")
DIAGRAM_WORDS = ("flow", "diagram", "chart", "process", "step", "arrow", "box", "node", "connection", "link", "input", "output", "decision", "start", "end")
CHART_WORDS = ("axis", "x-axis", "y-axis", "legend", "data", "graph", "plot", "chart", "bar", "line", "pie", "scatter", "histogram", "trend")
HEADING_WORDS = ("introduction", "conclusion", "methodology", "results", "discussion", "background", "summary", "abstract", "overview", "analysis", "findings", "implications", "recommendations", "future", "work")
HEADING_PATTERNS = (r"^\d+\.?\s+[A-Z]", r"^([A-Z]+\s){0,4}[A-Z]+$", r"^([A-Z][a-z]+\s){0,6}[A-Z][a-z]+$", r"^(Chapter|Section|Part|Appendix)\s+\d+", r"^\d+\.\d+", r"^[IVX]+\.\s+[A-Z]", r"^[A-Z]\.\s+[A-Z]")
SECTION_START = (r"^(introduction|conclusion|abstract|summary|overview)", r"^(background|methodology|results|discussion)", r"^(references|bibliography|appendix|glossary)", r"^\d+\.\s*(introduction|background|method)")
CAPTION_MARKS = (r"^(figure|fig|table|chart|diagram)\s*\d+", r"^(source|credit)[:.]", r"^\([a-z]\)", r"^\d+\.")
CAPTION = (
    r"^(figure|fig|image|diagram|chart|graph|table|schema|plate|exhibit)\s*\d*[:.\-\s]", r"^(fig\.|figure\.|table\.|chart\.|diagram\.)?\s*\d+[:.\-\s]", r"^(source|credit|copyright|adapted from|modified from)[:.\-\s]", r"^(photo|image)\s+(by|from|courtesy)",
    r"^\([^)]+\)$", r"^(step|phase|stage|example|case)\s*\d*[:.]", r"^(above|below|left|right)[:.\-\s]", r"^(figura|tabela|esquema|gráfico)\s*\d*[:.]", r"^(abbildung|tabelle|diagramm)\s*\d*[:.]", r"^(図|表|グラフ)\s*\d*[:.]", r"^\([a-z0-9]+\)",
)
CAPTION_WORDS = ("showing", "depicting", "illustrating", "displaying", "overview", "comparison", "analysis", "structure", "process", "workflow", "system", "model", "framework")
TOC_LINE = (r"^\d+\.?\s+", r"chapter\s+\d+", r"\.{3,}", r"\d+$", r"^\w+\s+\d+$")
BACKSLASH = chr(92)
FORMULA_SIGNS = "[→←↑↓⇌≡≈∆∇∑∫∂]"


def skip_content(d: Dialect, t: str, bare: str | None = None, low: str | None = None) -> str:
    """Boilerplate, code, texts under three characters, and texts with under 30 % letters are not worth translating.

    ``bare`` and ``low`` name columns that already hold the stripped text and its lower case.
    """
    bare = bare or d.strip(t)
    return f"({d.any_like(low or f'lower({bare})', SKIP)} or {d.any_like(t, CODE_LINE)} or length({bare}) < 3 or (length({t}) > 0 and {d.double(d.letters(t))} / length({t}) < 0.3))"


def page_furniture(d: Dialect, t: str, y0: str, y1: str) -> str:
    """Page numbers, running heads (upper band: marked, or under 50 characters all in capitals), running feet (lower band) and document metadata lines."""
    bare = d.strip(t)
    low = f"lower({bare})"
    capitals = f"(length({bare}) < 50 and {d.like(bare, '[' + BACKSLASH + 'p{Lu}]')} and not {d.like(bare, '[' + BACKSLASH + 'p{Ll}]')})"
    head = f"({y0} / 792.0 > 0.9 and ({d.any_like(low, HEADER_BAND)} or {capitals}))"
    foot = f"({y1} / 792.0 < 0.1 and ({d.any_of(low, FOOTER_PARTS)} or length({bare}) < 30))"
    return f"(length({bare}) < 3 or {d.any_like(low, PAGE_FURNITURE)} or {head} or {foot} or {d.any_like(low, METADATA)})"


def page_number(d: Dialect, t: str) -> str:
    """A number from 1 to 9999 or a common page-number form; digits alone always count."""
    bare = f"lower({d.strip(t)})"
    return f"({d.like(bare, '^[0-9]+$')} or {d.any_like(bare, PAGE_NUMBER)})"


def processing_artifact(d: Dialect, t: str) -> str:
    return d.guarded(t, ("[", BACKSLASH, "`"), d.like(t, "(?i)" + "|".join(ARTIFACT)))


def markdown(d: Dialect, t: str) -> str:
    return d.any_like(t, MARKDOWN)


def footnote(d: Dialect, t: str) -> str:
    """Footnote marks, or a short text with a referring word."""
    return f"({d.any_like(t, FOOTNOTE)} or (length({t}) < 300 and {d.any_of(f'lower({t})', ('note:', 'see', 'cf.', 'ibid'))}))"


def table_line(d: Dialect, t: str) -> str:
    """Of one line, at least two of: pipe, tab, the literal mark of a wide gap; of several lines, at least two that hold one of them."""
    marks = ("|", chr(9), "  +")
    marked = d.size(d.keep(d.split(t, r"\n"), d.any_of("x", marks)))
    return f"(case when {d.has(t, chr(10))} then {marked} >= 2 else {d.number_of(t, marks)} >= 2 end)"


def formula_diagram(d: Dialect, t: str) -> str:
    """Two formula signs, or two kinds of chemical or arithmetic notation."""
    kinds = " + ".join(f"(case when {d.like(t, p)} then 1 else 0 end)" for p in (r"[A-Z][a-z]?\d*", r"\d+\s*[+\-]\s*\d+", r"[A-Z]\s*[=]\s*[A-Z]"))
    return f"({d.count(t, FORMULA_SIGNS)} >= 2 or ({kinds}) >= 2)"


def math_content(d: Dialect, t: str, low: str | None = None) -> str:
    """Formulas, signs or words of mathematics; ``low`` names a column that holds the text's lower case."""
    signs = [p for p in MATH_ROUTE if p.startswith("[")]
    marked = d.guarded(t, ("$", BACKSLASH), d.like(t, "(?i)" + "|".join(p for p in MATH_ROUTE if p not in signs)))
    return f"({marked} or {d.any_like(t, signs)} or {d.any_of(low or f'lower({t})', MATH_WORDS)})"


def complex_table(d: Dialect, t: str) -> str:
    return d.guarded(t, ("|", BACKSLASH), d.any_like(t, TABLE_ROUTE))


def equation(d: Dialect, t: str) -> str:
    signs = [p for p in EQUATION if p.startswith("[")]
    return f"({d.guarded(t, ('$', BACKSLASH), d.any_like(t, [p for p in EQUATION if p not in signs]))} or {d.any_like(t, signs)})"


def code_block(d: Dialect, t: str) -> str:
    return f"({d.has(t, '```')} or {d.any_like(t, [p for p in CODE_BLOCK if p != '```'])})"


def diagram_words(d: Dialect, t: str) -> str:
    return f"({d.number_of(f'lower({t})', DIAGRAM_WORDS)} >= 2)"


def chart_words(d: Dialect, t: str) -> str:
    return f"({d.number_of(f'lower({t})', CHART_WORDS)} >= 2)"


def likely_heading(d: Dialect, t: str) -> str:
    """At most eight words, and short title or upper case, a heading word, or a colon at the end."""
    shaped = d.like(d.strip(t), r"^(\p{Lu}[\p{Lu}\s]*|(\p{Lu}\p{Ll}*\s)*\p{Lu}\p{Ll}*)$")
    return f"(not {d.words_from(t, 9)} and (({shaped} and not {d.words_from(t, 6)}) or {d.any_of(f'lower({t})', HEADING_WORDS)} or {d.like(t, ':' + chr(92) + 's*$')}))"


def heading_pattern(d: Dialect, t: str) -> str:
    return d.any_like(t, HEADING_PATTERNS)


def section_start(d: Dialect, t: str) -> str:
    return d.any_like(f"lower({t})", SECTION_START)


def caption_mark(d: Dialect, t: str) -> str:
    return d.like(d.strip(t), "(?i)^(?:" + "|".join(f"(?:{p[1:]})" for p in CAPTION_MARKS) + ")")


def likely_caption(d: Dialect, t: str) -> str:
    """Caption openings in several languages, or short texts of descriptive shape."""
    bare = d.strip(t)
    low = f"lower({bare})"
    n = d.words(bare)
    open_end = f"not {d.like(bare, '[.!?]$')}"
    shaped = f"({d.like(bare, '[*_]')} or ({d.letters(bare)} > 0 and ({bare} = upper({bare}) or {bare} = {low})))"
    return f"(length({bare}) >= 5 and ({d.any_like(low, CAPTION)} or ({n} <= 15 and {open_end} and {d.any_of(low, CAPTION_WORDS)}) or ({d.has(bare, ':')} and {n} <= 20) or ({n} <= 25 and {shaped})))"


def list_item(d: Dialect, t: str) -> str:
    return d.like(t, "(?i)^(?:" + "|".join(f"(?:{p[1:]})" for p in LIST_ITEM) + ")")


def list_mark(d: Dialect, t: str) -> str:
    return d.any_like(t, LIST_MARK)


def toc_line(d: Dialect, t: str) -> str:
    """Numbered, dotted or paged lines, and short lines with a digit."""
    bare = d.strip(t)
    return f"({d.any_like(f'lower({bare})', TOC_LINE)} or (length({bare}) < 100 and {d.like(bare, '[0-9]')}))"


def toc_score(d: Dialect, t: str) -> str:
    """Strong title 5, weak title 1, leaders 2, numbering 1, structure word 2; four make a contents page."""
    low = f"lower({t})"
    parts = ((d.any_like(low, (r"table of contents", r"^\s*contents\s*$", r"inhaltsverzeichnis", r"sommaire")), 5), (d.any_like(low, (r"\bindex\b", r"\boverview\b")), 1), (d.like(t, r"\.{3,}\s*\d+"), 2), (d.like(t, r"^\s*\d+(\.\d+)*\s+\S"), 1), (d.any_like(low, (r"chapter\s+\d+", r"section\s+\d+")), 2))
    return "cast(" + " + ".join(f"{cases((test, str(n)), otherwise='0')}" for test, n in parts) + " as bigint)"


def content_start(d: Dialect, t: str) -> str:
    return d.like(t, r"(?i)^\s*(chapter\s+(1|one|i)\b|1\.?\s+introduction|introduction\s*$|abstract\s*$)")


def back_matter(d: Dialect, t: str) -> str:
    return d.like(t, r"(?i)^\s*(references|bibliography|appendix(\s+[a-z0-9])?|glossary|index|acknowledg(e)?ments?)\s*$")


def over_model_limit(d: Dialect, t: str, limit: str) -> str:
    """Estimated tokens, a quarter of the characters, above 80 % of a model's limit (100,000 if unknown)."""
    return f"({d.div(f'length({t})', '4')} > 0.8 * coalesce({limit}, 100000))"


def markdown_syntax_only(d: Dialect, t: str) -> str:
    return d.any_like(t, (r"^\s*#{1,6}\s*$", r"^\s*[-*+]\s*$", r"^\s*\d+\.\s*$", r"^\s*[-*_]{3,}\s*$", r"^\s*```\w*\s*$", r"^\s*\|?[\s:|-]+\|[\s:|-]*$"))
