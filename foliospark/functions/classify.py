"""Classifiers: ordered choices over block texts and features (portable expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import predicates as P
from foliospark.functions.portable import Dialect, cases

# Word lists and pattern families that decide results.
ACADEMIC_WORDS = ("abstract", "introduction", "methodology", "conclusion", "results", "discussion", "analysis", "research", "study", "findings")
DOCUMENT_TYPES = {
    "academic": ("abstract", "methodology", "hypothesis", "literature review", "references", "citation"),
    "technical": ("algorithm", "implementation", "specification", "configuration", "system", "technical"),
    "legal": ("contract", "agreement", "clause", "liability", "jurisdiction", "legal"),
    "business": ("revenue", "strategy", "market", "customer", "business", "management"),
    "literary": ("chapter", "character", "narrative", "poetry", "novel", "story"),
}
THEMES = {
    "introduction": ("introduction", "overview", "background"), "methodology": ("method", "approach", "procedure"), "results": ("result", "finding", "outcome"),
    "discussion": ("discussion", "analysis", "interpretation"), "conclusion": ("conclusion", "summary", "future"), "references": ("reference", "bibliography", "citation"),
}


def text_block_type(d: Dialect, t: str) -> str:
    """header, table, math, reference, short or paragraph."""
    return cases(
        (f"starts_with({t}, '#')" if not d.spark else f"startswith({t}, '#')", "'header'"), (f"{d.count(t, '[|]')} > 2", "'table'"), (d.like(t, r"[$\\]"), "'math'"),
        (d.any_of(f"lower({t})", ("figure", "table", "equation")), "'reference'"), (f"{d.words(t)} < 10", "'short'"), otherwise="'paragraph'",
    )


def heading_mark(d: Dialect, t: str) -> str:
    """What a line has that is typed as a heading, unless an earlier type takes it."""
    return f"{d.like(t, '^#{1,6} ')} or {P.likely_heading(d, t)} and {P.heading_pattern(d, t)}"


def block_type(d: Dialect, t: str) -> str:
    """The typed block of a line: precedence artifact, code, equation, heading, list item, caption, paragraph."""
    level = cases((d.like(t, r"^#\s"), "'h1'"), (d.like(t, r"^##\s"), "'h2'"), (d.like(t, r"^#{3,6}\s"), "'h3'"), otherwise="'h2'")
    return cases(
        (P.processing_artifact(d, t), "'metadata'"), (P.code_block(d, t), "'code_block'"), (P.equation(d, t), "'equation'"),
        (heading_mark(d, t), level), (P.list_item(d, t), "'list_item'"), (P.caption_mark(d, t), "'caption'"), otherwise="'paragraph'",
    )


def importance(d: Dialect, t: str, kind: str, page: str, bare: str | None = None, low: str | None = None) -> str:
    """skip, low, medium or high by type, length, position and words; an image is medium from five words of its recognised text, else low.

    ``bare`` and ``low`` name columns that already hold the stripped text and its lower case.
    """
    bare = bare or d.strip(t)
    low, from_words = low or f"lower({bare})", lambda number: d.words_from(bare, number)
    paragraph = cases((f"not {from_words(5)}", "'low'"), (from_words(51), "'high'"), (d.any_of(low, ACADEMIC_WORDS), "'high'"), (f"{page} <= 3 and {from_words(16)}", "'high'"), otherwise="'medium'")
    item = cases((f"not {from_words(3)}", "'low'"), (from_words(21), "'medium'"), (d.like(bare, r"^\s*\[?\d+\]?\s*[A-Z][^.]*\.\s*$"), "'low'"), otherwise="'medium'")
    return cases(
        (f"{kind} = 'image'", cases((from_words(5), "'medium'"), otherwise="'low'")), (f"{bare} = '' or {P.skip_content(d, bare, bare, low)}", "'skip'"), (f"{kind} = 'h1'", "'high'"), (f"{kind} = 'h2'", cases((f"length({bare}) > 20", "'high'"), otherwise="'medium'")),
        (f"{kind} = 'paragraph'", paragraph), (f"{kind} = 'list_item'", item), otherwise="'medium'",
    )


def routing_tool(d: Dialect, t: str, level: str, low: str | None = None) -> str:
    """markup for math and complex tables, strong for important texts, fast for the rest, skip for what isn't translated."""
    return cases((f"{level} = 'skip'", "'skip'"), (f"{P.math_content(d, t, low)} or {P.complex_table(d, t)}", "'markup'"), (f"{level} = 'high'", "'strong'"), otherwise="'fast'")


def profile_tool(d: Dialect, content_type: str, complexity: str, fallback: str) -> str:
    """Routing by page profile; where the profile doesn't decide, the content does."""
    return cases(
        (f"{content_type} in ('math_heavy', 'formula_dense', 'table_heavy', 'diagram_heavy')", "'markup'"), (f"{content_type} = 'image_dominant'", "'image'"), (f"{content_type} = 'mixed_content'", "'strong'"),
        (f"{complexity} > 0.7", "'markup'"), (f"{complexity} > 0.4", "'strong'"), otherwise=fallback,
    )


def argmax_words(d: Dialect, t: str, families: dict[str, tuple[str, ...]], default: str, occurrences: bool = False) -> str:
    """The family with most words present (or occurrences); the first family wins ties, none gives the default."""
    low = f"lower({t})"
    scores = {k: d.count(low, "|".join(w)) if occurrences else d.number_of(low, w) for k, w in families.items()}
    most = f"greatest({', '.join(scores.values())})"
    return cases((f"{most} = 0", f"'{default}'"), *[(f"{s} = {most}", f"'{k}'") for k, s in scores.items()], otherwise=f"'{default}'")


def markup_visual_type(d: Dialect, t: str) -> str:
    """Visual type by the markup engine's text: photograph, data_table, mathematical_formula, structured_diagram, complex_chart."""
    bare = d.strip(t)
    return cases(
        (f"length({bare}) < 10", "'photograph'"), (d.any_like(t, P.TABLE_MARKUP), "'data_table'"), (d.any_like(t, P.MATH_MARKUP), "'mathematical_formula'"), (P.diagram_words(d, t), "'structured_diagram'"),
        (P.chart_words(d, t), "'complex_chart'"), (f"length({bare}) > 50", "'structured_diagram'"), otherwise="'unknown'",
    )


def markdown_item(d: Dialect, t: str) -> str:
    """h1 to h6, list_item or paragraph by markdown marks."""
    return cases(*[(d.like(t, rf"^#{{{n}}}\s+"), f"'h{n}'") for n in range(6, 0, -1)], (d.any_like(t, (r"^\s*[-*+]\s+", r"^\s*\d+\.\s+")), "'list_item'"), otherwise="'paragraph'")


def validator_type(d: Dialect, t: str) -> str:
    """table, code, latex, list or unknown."""
    return cases((d.like(t, r"\|.*\|"), "'table'"), (d.like(t, r"```|^\s*(def|class|function)\s"), "'code'"), (d.like(t, r"\$[^$]+\$|\\[a-zA-Z]+\{"), "'latex'"), (d.any_like(t, (r"^\s*[-*+]\s+", r"^\s*\d+\.\s+")), "'list'"), otherwise="'unknown'")


def potential_heading(d: Dialect, t: str) -> str:
    """Bold lines, and short capitalised lines without a full stop, may be headings."""
    capitals, n = d.count(t, r"(^|\s)\p{Lu}"), d.words(t)
    titled = f"length({t}) < 100 and {d.like(t, '^' + chr(92) + 'p{Lu}')} and not {d.like(t, '[.]$')} and {n} >= 3 and {d.double(capitals)} / {n} >= 0.6"
    return cases((f"length({t}) > 150", "'none'"), (d.like(t, r"^\*\*.+\*\*$"), "'bold'"), (titled, "'title'"), otherwise="'none'")


def markup_confidence(d: Dialect, t: str) -> str:
    """0.3 for length, 0.2 each for equations, tables and figures, 0.1 for sections."""
    parts = ((f"length({t}) > 100", 3), (d.like(t, r"\$|\\begin"), 2), (d.like(t, r"\|.*\|"), 2), (d.like(t, r"(?i)figure|!\["), 2), (d.like(t, r"^#{1,6}\s"), 1))
    return "cast(" + " + ".join(cases((test, str(n)), otherwise="0") for test, n in parts) + " as double) / 10"


def role_priority(d: Dialect, role: str) -> str:
    return cases((d.like(role, "^h"), "1"), (f"{role} in ('paragraph', 'caption')", "2"), otherwise="3")


def extraction_type(d: Dialect, name: str) -> str:
    return cases(*[(d.has(name, f"_{k}_"), f"'{k}'") for k in ("visual", "table", "equation")], otherwise="'image'")


def detection_class(label: str) -> str:
    return cases((f"{label} in ('figure', 'table', 'equation')", "'visual'"), (f"{label} in ('text', 'title', 'list')", "'text'"), otherwise="'mixed'")


def relative_position(dx: str, dy: str) -> str:
    """Along the dominant axis of the centres' distance."""
    return cases((f"abs({dy}) > abs({dx})", cases((f"{dy} < 0", "'above'"), otherwise="'below'")), otherwise=cases((f"{dx} < 0", "'left'"), otherwise="'right'"))


def toc_level(d: Dialect, t: str) -> str:
    """Level by numbering depth, keyword or indentation."""
    indent = f"(length({t}) - length({d.replace(t, chr(94) + chr(92) + 's+', '')}))"
    return cases((d.like(t, r"^\s*\d+\.\d+\.\d+"), "3"), (d.like(t, r"^\s*\d+\.\d+"), "2"), (d.like(t, r"(?i)^\s*(chapter|part)\b"), "1"), (f"{indent} >= 8", "3"), (f"{indent} >= 4", "2"), otherwise="1")


def spatial_relation(position: str) -> str:
    """Order of an image and a text from the side the image lies on."""
    return cases((f"{position} = 'above'", "'before'"), (f"{position} = 'below'", "'after'"), otherwise="'alongside'")


def layout_complexity(tables: str, cover: str, reader: str) -> str:
    """Tiers of a page's image coverage and tables: the detailed reader has four, the basic one three at lower bounds."""
    if reader == "basic":
        return cases((f"{cover} > 0.4", "'complex'"), (f"{cover} > 0.2 or {tables} > 0", "'moderate'"), otherwise="'simple'")
    return cases((f"{tables} > 5 or {cover} > 0.7", "'very_complex'"), (f"{tables} > 2 or {cover} > 0.5", "'complex'"), (f"{tables} > 0 or {cover} > 0.3", "'moderate'"), otherwise="'simple'")


def text_type(kind: str) -> str:
    """The kind of chunking a block type asks for."""
    return cases((f"{kind} in ('h1', 'h2', 'h3', 'heading')", "'heading'"), (f"{kind} in ('list_item', 'caption')", kind), (f"{kind} = 'table'", "'table_content'"), (f"{kind} in ('equation', 'math')", "'mathematical'"), otherwise="'paragraph'")


# Words, batch multiplier and temperature of each content type.
CONTENT_TYPES = {
    "academic": (("abstract", "methodology", "conclusion", "hypothesis", "research"), 1.2, 0.05),
    "technical": (("specification", "procedure", "configuration", "system", "manual"), 1.1, 0.1),
    "legal": (("whereas", "hereby", "pursuant", "jurisdiction", "contract"), 0.8, 0.05),
    "narrative": (("story", "character", "dialogue", "chapter", "narrative"), 1.3, 0.15),
}


def content_type(low: Column) -> Column:
    """The type with most of its words in a lower-case text, the first of equals, with multiplier and temperature; general if none occurs."""
    kind = lambda name, multiplier, temperature: F.struct(F.lit(name).alias("kind"), F.lit(multiplier).alias("multiplier"), F.lit(temperature).alias("temperature"))
    scores = F.array(*[F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))) for words, *_ in CONTENT_TYPES.values()])
    most = F.array_max(scores)
    options = F.array(*[kind(name, m, t) for name, (_, m, t) in CONTENT_TYPES.items()])
    return F.when(most == 0, kind("general", 1.0, 0.1)).otherwise(F.get(options, F.array_position(scores, most).cast("int") - 1))
