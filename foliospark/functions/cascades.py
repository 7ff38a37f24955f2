"""Ordered heuristics over whole texts, as columns: features are made once, then a first-match choice reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Word lists that decide results.
LISTING = ("assessment", "evaluation", "point", "criteria", "first", "second", "third", "step", "phase", "stage", "level", "grade", "score", "rating", "following", "include", "such as", "for example", "namely")
BOOK_PARTS = ("contents", "chapter", "bibliography", "references", "index", "page", "introduction", "preface")
SCHOLARLY = ("according to", "research", "study", "analysis", "conclusion", "methodology", "results", "discussion", "however", "therefore", "furthermore", "moreover", "consequently", "in addition")
COMMON = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
PROSE_PHRASES = (
    "however", "therefore", "furthermore", "moreover", "consequently", "in addition", "on the other hand", "for example", "such as", "according to", "research shows", "studies indicate", "demonstrates", "analysis",
    "methodology", "implementation", "significant",
)
CONNECTING = ("and", "but", "or", "because", "since", "while", "although", "when", "where", "which", "that", "this", "these", "those")
FORMATTED = (
    "assessment", "evaluation", "point", "criteria", "first", "second", "third", "step", "phase", "stage", "level", "grade", "score", "rating", "following", "include", "such as", "for example", "namely",
    "according to", "research", "study", "analysis", "conclusion", "introduction", "methodology", "results", "discussion",
)
VISUAL = ("figure", "diagram", "chart", "graph", "illustration", "image", "picture", "schema", "model", "flowchart", "plot", "drawing", "sketch")
FIGURE_REFERENCE = (r"figure\s+\d+", r"fig\.\s*\d+", r"diagram\s+\d+", r"chart\s+\d+", r"see\s+figure", r"shown\s+in\s+figure", r"as\s+illustrated", r"as\s+shown")
TECHNICAL = ("equation", "formula", "algorithm", "method", "process", "system", "structure", "analysis", "result", "data", "experiment", "study")
TEXT_ONLY = ("table of contents", "bibliography", "references", "index", "acknowledgments", "preface", "introduction", "conclusion", "abstract", "summary", "appendix", "glossary", "notes")
ASSESSMENT = (
    "first point", "second point", "third point", "fourth point", "fifth point", "first assessment", "second assessment", "third assessment", "point of assessment", "assessment point", "evaluation point",
    "first criterion", "second criterion", "third criterion", "first step", "second step", "third step", "first stage", "second stage", "third stage",
)
EVALUATION = ("evaluation", "assessment", "criteria", "methodology", "analysis", "conclusion", "findings", "results", "discussion", "recommendation", "objective", "goal", "purpose", "approach", "strategy")
CHART = (
    "figure", "fig", "chart", "graph", "diagram", "table", "tab", "axis", "x-axis", "y-axis", "legend", "scale", "%", "percent", "data", "value", "min", "max", "avg", "mean", "total", "step", "process", "flow",
    "stage", "phase", "level", "category", "type", "section", "part", "component", "element", "item", "point",
)
MATH_SIGNS = ("=", "+", "-", "*", "/", "^", "√", "∑", "∫", "∆", "α", "β", "γ", "θ", "π", "σ", "μ", "°", "±")
ADDRESSES = ("http", "www.", "@", ".com", ".org", ".net", "id:", "ref:", "no.", "code")
COMPLEX_FILES = ("chart", "graph", "diagram", "figure", "fig", "table", "flow", "process", "schema", "map", "plan", "layout", "design", "model")
INTERFACE = ("click", "button", "menu", "tab", "link", "page", "next", "previous", "home", "back")
SENTENCE = ("the", "a", "an", "is", "are", "was", "were", "this", "that", "these", "those", "and", "or", "but")
DESCRIPTIVE = ("quick", "brown", "fox", "dog", "runs", "forest", "example", "sample", "test", "demo")
ACADEMIC = ("methodology", "research", "study", "analysis", "description", "explanation")
#: Words in title case: an upper-case letter begins each run of letters, and only there.
TITLE = r"^[^\p{L}]*\p{Lu}\p{Ll}*([^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$"


def first_of(*rules: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first rule whose test holds."""
    out = F.when(rules[0][0], rules[0][1])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def holds(col: str, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words."""
    out = F.contains(F.col(col), F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(F.col(col), F.lit(word))
    return out


def number_of(col: str, words: tuple[str, ...]) -> Column:
    """How many of the words a text holds."""
    out = F.lit(0)
    for word in words:
        out = out + F.contains(F.col(col), F.lit(word)).cast("int")
    return out


def share(array: str | Column, test: Callable[[Column], Column], of: Column | None = None) -> Column:
    """Share of an array's elements that pass a test; zero of an empty one."""
    return F.coalesce(F.try_divide(F.size(F.filter(array, test)), of if of is not None else F.size(array)), F.lit(0.0))


def _bare(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))


def with_text_features(df: DataFrame) -> DataFrame:
    """A table with a text column and what the cascades read: low, bare, words, lines, sentences, parts, paragraphs."""
    kept = lambda array: F.filter(array, lambda x: x != "")
    t = F.col("text")
    return df.select(
        "*", F.lower(t).alias("low"), _bare(t).alias("bare"), kept(F.split(t, r"\s+")).alias("words"), F.split(t, "\n").alias("lines"), kept(F.transform(F.split(t, r"\."), _bare)).alias("sentences"),
        F.size(F.split(t, r"\.")).alias("parts"), kept(F.transform(F.split(t, "\n\n"), _bare)).alias("paragraphs"),
    )


def _mean_sentence() -> Column:
    return F.length(F.array_join("sentences", "")) / F.greatest(F.lit(1), F.size("sentences"))


def _bulleted(x: Column) -> Column:
    return _bare(x).rlike(r"^[•\-*]\s+")


def plain_text() -> Column:
    """Whether a page is plain paragraphs: short, listing, book parts, many numbered lines, even sentences, scholarly, common or title-case words."""
    n, digits = F.size("words"), lambda x: x.rlike(r"[0-9]")
    return first_of(
        (F.length("text") < 50, True), (number_of("low", LISTING) >= 2, True), (holds("low", BOOK_PARTS), True), ((F.size("lines") > 3) & (share("lines", digits) + share("lines", _bulleted) > 0.3), True),
        ((F.size("lines") > 3) & (share("lines", digits) > 0.4), True), ((F.col("parts") > 5) & _mean_sentence().between(30, 300), True), (number_of("low", SCHOLARLY) >= 2, True),
        ((n > 50) & (share("words", lambda x: F.lower(x).isin(*COMMON)) > 0.15), True), ((n > 10) & (share("words", lambda x: (F.length(x) > 2) & x.rlike(TITLE)) > 0.3), True), otherwise=False,
    )


def continuous_prose() -> Column:
    """Whether a page is continuous prose: long sentences in paragraphs, scholarly phrases, or many connecting words."""
    return first_of(
        ((F.length("bare") < 150) | (F.size("sentences") < 3), False), ((_mean_sentence() > 40) & (share("sentences", lambda x: F.length(x) > 40) > 0.3) & (F.size("paragraphs") >= 2), True),
        ((number_of("low", PROSE_PHRASES) >= 2) & (F.size("sentences") > 5), True), ((F.size("words") > 50) & (F.try_divide(number_of("low", CONNECTING), F.size("words")) > 0.1), True), otherwise=False,
    )


def formatted_page() -> Column:
    """Whether a page is formatted text: three indicators, many list lines, or many short title-case words."""
    items = share("lines", lambda x: _bare(x).rlike(r"^[0-9]+[.)]\s+")) + share("lines", _bulleted)
    titles = share(F.slice("words", F.lit(1), F.greatest(F.lit(0), F.size("words") - 1)), lambda x: (F.length(x) < 15) & x.rlike(TITLE), F.size("words"))
    return first_of((F.length("bare") < 50, False), (number_of("low", FORMATTED) >= 3, True), ((F.size("lines") > 5) & (items > 0.3), True), ((F.size("words") > 20) & (titles > 0.2), True), otherwise=False)


def placement_context() -> Column:
    """Whether a page has a context that an image can stand in."""
    visual = number_of("low", VISUAL)
    return first_of(
        (F.length("bare") < 100, False), (F.col("low").rlike("|".join(FIGURE_REFERENCE)), True), (visual >= 2, True), ((number_of("low", TECHNICAL) >= 3) & (visual >= 1), True), (holds("low", TEXT_ONLY), False),
        (continuous_prose(), False), ((F.col("parts") > 20) & _mean_sentence().between(40, 150), False), otherwise=F.length("bare") >= 200,
    )


def assessment_text() -> Column:
    """Whether a table candidate is assessment text: phrases, numbered assessment lines, evaluation words, or prose."""
    n, ends = F.size("words"), F.length(F.regexp_replace("text", r"[^.!?]", ""))
    line = lambda x: F.lower(_bare(x)).rlike(r"^[0-9]+[.)]\s+.*(point|assessment|criterion|step|stage|evaluation)") | F.lower(_bare(x)).rlike(r"^(first|second|third|fourth|fifth).*(point|assessment|criterion)")
    prose = (n > 50) & (F.try_divide(F.length(F.array_join("words", "")), n) > 4) & (ends > 2) & (n / F.greatest(F.lit(1), ends) > 10)
    return first_of((F.length("bare") < 20, False), (holds("low", ASSESSMENT), True), ((F.size("lines") > 2) & (share("lines", line) > 0.3), True), ((number_of("low", EVALUATION) >= 3) & (n > 30), True), (prose, True), otherwise=False)


def ocr_skip(file: str) -> Column:
    """The first rule that keeps a recognised text from translation, or ``translate``; ``file`` is the image's name."""
    low, n = "lower(bare)", F.size("words")
    text, name = F.expr(low), F.lower(file)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    letters, signs = F.length(F.regexp_replace(text, r"\P{L}+", "")), F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return first_of(
        (F.col("bare") == "", "empty"), (n < 8, "few_words"), (has(CHART), "chart_word"), ((letters > 0) & (F.try_divide(signs, F.length("bare")) > 0.3), "symbols"), (share("words", lambda x: F.length(x) <= 3) > 0.5, "short_words"),
        (has(MATH_SIGNS), "math_sign"), (has(ADDRESSES), "address"), (F.exists(F.array(*[F.lit(w) for w in COMPLEX_FILES]), lambda w: F.contains(name, w)), "file_name"), (F.size("lines") > 2, "lines"), (has(INTERFACE), "interface"),
        (n < 10, "under_ten_words"), (~has(SENTENCE), "no_sentence"), (has(DESCRIPTIVE), "descriptive"), (F.size("sentences") != 1, "sentences"), (~has(ACADEMIC), "not_academic"), otherwise="translate",
    )


def embed_original(kind: Column, blocks: Column, total: Column) -> Column:
    """Whether a page's original is embedded: never a table of contents; after errors; with no, short, or mostly special text."""
    special = F.try_divide(F.length(F.regexp_replace(total, r"[\p{L}\p{N}_\s]+", "")), F.length(total))
    return first_of((kind == "toc_page", "regenerate"), (kind == "error", "embed_error"), (blocks == 0, "embed_empty"), (F.length(_bare(total)) < 50, "embed_short"), (special > 0.3, "embed_special"), otherwise="keep")


def image_prefilter(size: str, width: str, height: str, colours: str, dominant: str) -> Column:
    """Why an image isn't worth analysing, by its file's metadata, or ``analyse``."""
    w, h = F.expr(width), F.expr(height)
    return first_of(
        (F.expr(size) < 10_000, "small_file"), ((w < 50) | (h < 50), "small_side"), (F.expr(colours) <= 5, "few_colours"), (F.expr(dominant) > 0.9, "one_colour"), (F.try_divide(F.greatest(w, h), F.least(w, h)) > 10, "narrow"), otherwise="analyse",
    )


