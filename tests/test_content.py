"""Literal rows with answers written by hand for predicates, cascades, markdown and ordered operators."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import cascades as X
from foliospark.functions import classify as C
from foliospark.functions import predicates as P
from foliospark.functions import scores as S
from foliospark.functions.portable import CHECK, SPARK
from foliospark.operators import grouping as G
from foliospark.operators import layout as L
from foliospark.operators import markdown as M
from foliospark.sources import tables as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()

#: (test, text, answer)
PREDICATES = [
    (P.skip_content, "All rights reserved", True), (P.skip_content, "Copyright 2021 Someone", True), (P.skip_content, "Page 12", True), (P.skip_content, "xiv", True), (P.skip_content, "42", True), (P.skip_content, "x = 3", True),
    (P.skip_content, "import numpy", True), (P.skip_content, "ab", True), (P.skip_content, "12345 67890 a", True), (P.skip_content, "A normal sentence about birds.", False), (P.skip_content, "The copyright 2021 act", False),
    (P.page_number, "17", True), (P.page_number, "Page 3", True), (P.page_number, "p. 9", True), (P.page_number, "3 of 10", True), (P.page_number, "- 4 -", True), (P.page_number, "chapter 3", False),
    (P.processing_artifact, "x [MISSING_PAGE] y", True), (P.processing_artifact, "\\begin{table}", True), (P.processing_artifact, "```", True), (P.processing_artifact, "[missing_page]", True), (P.processing_artifact, "nothing here", False),
    (P.markdown, "# Title", True), (P.markdown, "some **bold** text", True), (P.markdown, "- item", True), (P.markdown, "3. item", True), (P.markdown, "plain words", False),
    (P.footnote, "[1] See there", True), (P.footnote, "(2) text", True), (P.footnote, "3. text", True), (P.footnote, "¹ text", True), (P.footnote, "** text", True), (P.footnote, "cf. Smith", True), (P.footnote, "x" * 400 + " cf. Smith", False), (P.footnote, "plain words", False),
    (P.table_line, "a | b\tc", True), (P.table_line, "a | b", False), (P.table_line, "a | b\nc | d", True), (P.table_line, "a | b\nc d\tx\n|", True), (P.table_line, "a | b\tc\nplain", False),
    (P.math_content, "where $a+b$ holds", True), (P.math_content, "a ≤ b", True), (P.math_content, "the Lemma of Zorn", True), (P.math_content, "\\frac{a}{b}", True), (P.math_content, "costs 5 dollars", False),
    (P.complex_table, "|a|b|", True), (P.complex_table, "\\begin{tabular}", True), (P.complex_table, "a|b", False),
    (P.equation, "$x$", True), (P.equation, "\\[ x \\]", True), (P.equation, "∑ x", True), (P.equation, "α", True), (P.equation, "x plus y", False),
    (P.code_block, "say ```x```", True), (P.code_block, "def run(x):", True), (P.code_block, "from a import b", True), (P.code_block, "f = function(x)", True), (P.code_block, "a definition", False),
    (P.likely_heading, "Summary of Work", True), (P.likely_heading, "the overview of it", True), (P.likely_heading, "what follows:", True), (P.likely_heading, "this is a plain line of nine words or more", False), (P.likely_heading, "plain words here", False),
    (P.heading_pattern, "1. Title", True), (P.heading_pattern, "2.3 more", True), (P.heading_pattern, "IV. Part", True), (P.heading_pattern, "Chapter 3 of it", True), (P.heading_pattern, "ALL CAPS", True), (P.heading_pattern, "plain words", False),
    (P.section_start, "Introduction to birds", True), (P.section_start, "1. Background", True), (P.section_start, "An introduction", False),
    (P.caption_mark, "Figure 3: Birds", True), (P.caption_mark, "  (a) first", True), (P.caption_mark, "Source: me", True), (P.caption_mark, "The figure 3", False),
    (P.likely_caption, "Figure 1: Test diagram showing the process", True), (P.likely_caption, "Chart 2.1 - Performance metrics", True), (P.likely_caption, "Source: Annual Report 2023", True), (P.likely_caption, "System architecture overview", True),
    (P.likely_caption, "(a) Initial configuration", True), (P.likely_caption, "This is a regular paragraph that should not be detected as a caption.", False), (P.likely_caption, "abc", False),
    (P.list_item, "• a", True), (P.list_item, "  - a", True), (P.list_item, "12) a", True), (P.list_item, "B. a", True), (P.list_item, "iv) a", True), (P.list_item, "-a", False),
    (P.toc_line, "1. Birds", True), (P.toc_line, "Chapter 2", True), (P.toc_line, "Birds .... 12", True), (P.toc_line, "short with 1 digit inside", True), (P.toc_line, "no digit at all", False),
    (P.content_start, "Chapter One", True), (P.content_start, "1. Introduction", True), (P.content_start, "Abstract", True), (P.content_start, "Chapter 2", False),
    (P.back_matter, "References", True), (P.back_matter, "Appendix B", True), (P.back_matter, "Acknowledgements", True), (P.back_matter, "The references", False),
    (P.markdown_syntax_only, "##", True), (P.markdown_syntax_only, "---", True), (P.markdown_syntax_only, "| - | - |", True), (P.markdown_syntax_only, "## a", False),
    (P.diagram_words, "a flow of boxes", True), (P.diagram_words, "a box", False), (P.chart_words, "axis and legend", True), (P.chart_words, "legend", False),
]

#: (value, text, answer)
VALUES = [
    (C.block_type, "[ERROR]", "metadata"), (C.block_type, "def f(x):", "code_block"), (C.block_type, "$x$", "equation"), (C.block_type, "# One", "h1"), (C.block_type, "## Two", "h2"), (C.block_type, "#### Four", "h3"), (C.block_type, "Summary Of Work", "h2"),
    (C.block_type, "- point", "list_item"), (C.block_type, "Table 3 birds", "caption"), (C.block_type, "plain words that go on", "paragraph"),
    (C.text_block_type, "# a", "header"), (C.text_block_type, "a|b|c|d", "table"), (C.text_block_type, "cost $", "math"), (C.text_block_type, "see the Figure", "reference"), (C.text_block_type, "few words", "short"), (C.text_block_type, " ".join(WORDS), "paragraph"),
    (C.markup_visual_type, "tiny", "photograph"), (C.markup_visual_type, "|a|b|c| rows", "data_table"), (C.markup_visual_type, "here $x$ and so", "mathematical_formula"), (C.markup_visual_type, "a flow chart of it", "structured_diagram"), (C.markup_visual_type, "axis and legend", "complex_chart"),
    (C.markup_visual_type, "nothing that is known", "unknown"), (C.markdown_item, "### x", "h3"), (C.markdown_item, "* x", "list_item"), (C.markdown_item, "1. x", "list_item"), (C.markdown_item, "x", "paragraph"),
    (C.validator_type, "|a|b|", "table"), (C.validator_type, "def f", "code"), (C.validator_type, "$x$", "latex"), (C.validator_type, "- x", "list"), (C.validator_type, "x", "unknown"),
    (C.potential_heading, "**Bold line**", "bold"), (C.potential_heading, "The Great Bird Book", "title"), (C.potential_heading, "The great bird book", "none"), (C.potential_heading, "The Great Bird Book.", "none"),
    (C.toc_level, "1.2.3 x", 3), (C.toc_level, "1.2 x", 2), (C.toc_level, "Chapter 1", 1), (C.toc_level, "         x", 3), (C.toc_level, "     x", 2), (C.toc_level, "x", 1),
    (C.markup_confidence, "x", 0.0), (C.markup_confidence, "# x $y$ |a| figure " + "z" * 100, 1.0), (S.token_estimate, "x" * 11, 2), (S.footnote_reference, "as [12] says (3)", "12"), (S.footnote_reference, "as (3) says", "3"), (S.footnote_reference, "none", ""),
    (S.toc_title, "1.2. Birds ..... 12", "Birds"), (S.toc_page, "Birds .... 12", 12), (S.toc_page, "Birds", None), (S.anchor, "Birds & Bees, 2nd", "birds-bees-2nd"), (S.clean_markup, "a [MISSING_PAGE_EMPTY:3] \\textbf{b}", "a b}"), (S.safe_filename, 'a<b>: "c"/d', "a_b_c_d"),
    (S.strip_control, "a\x07b\x1fc", "abc"), (P.toc_score, "Table of Contents", 5), (P.toc_score, "1 Birds ... 3", 3), (P.toc_score, "Index", 1), (S.ocr_quality, "word " * 30, 1.0), (S.ocr_quality, "12", 0.5),
]


def evaluate(spark, rule, text):
    import duckdb

    frame = spark.createDataFrame([(text,)], "text string")
    ours = frame.select(F.expr(rule(SPARK, "text")).alias("v")).first().v
    theirs = duckdb.execute(f"SELECT {rule(CHECK, 'text')} FROM (SELECT ? AS text)", [text]).fetchone()[0]
    return ours, theirs


@pytest.mark.parametrize("number", range(0, len(PREDICATES), 12))
def test_predicates_on_literal_rows(spark, number):
    for rule, text, answer in PREDICATES[number : number + 12]:
        assert evaluate(spark, rule, text) == (answer, answer), (rule.__name__, text)


@pytest.mark.parametrize("number", range(0, len(VALUES), 12))
def test_values_of_literal_rows(spark, number):
    for rule, text, answer in VALUES[number : number + 12]:
        ours, theirs = evaluate(spark, rule, text)
        assert (ours, float(theirs) if isinstance(answer, float) else theirs) == (answer, answer), (rule.__name__, text)


def test_importance_and_routing_on_literal_rows(spark):
    long = " ".join(["word"] * 60)
    rows = [
        ("Title", "h1", 9, "high", "strong"), ("A heading of some length", "h2", 9, "high", "strong"), ("Short one", "h2", 9, "medium", "fast"), ("Third level", "h3", 9, "medium", "fast"), ("four words are few", "paragraph", 9, "low", "fast"), (long, "paragraph", 9, "high", "strong"),
        ("we did research on some birds", "paragraph", 9, "high", "strong"), (" ".join(["bird"] * 16), "paragraph", 3, "high", "strong"), (" ".join(["bird"] * 16), "paragraph", 4, "medium", "fast"), ("two words", "list_item", 9, "low", "fast"), (long, "list_item", 9, "medium", "fast"),
        ("three plain words", "list_item", 9, "medium", "fast"), ("5 words of recognised text", "image", 9, "medium", "fast"), ("few", "image", 9, "low", "fast"), ("", "image", 9, "low", "fast"), ("  ", "paragraph", 1, "skip", "skip"), ("Page 3", "paragraph", 1, "skip", "skip"),
        ("the proof of this old lemma", "paragraph", 9, "medium", "markup"), ("so |a|b| is one row", "paragraph", 9, "medium", "markup"),
    ]
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, text string, block_type string, page_num long, want string, tool string")
    got = T.weighed(frame).withColumn("routed", F.expr(C.routing_tool(SPARK, "text", "importance", "low"))).collect()
    assert [(r.text, r.importance, r.routed) for r in got] == [(r.text, r.want, r.tool) for r in got]


def test_page_furniture_bands(spark):
    rows = [("A RUNNING HEAD", 750.0, 760.0, True), ("A Running Head", 750.0, 760.0, False), ("A RUNNING HEAD", 400.0, 410.0, False), ("X" * 60, 750.0, 760.0, False), ("chapter 3 of it", 750.0, 760.0, True), ("some short foot", 10.0, 20.0, True), ("page 3", 400.0, 410.0, True), ("Author: me", 400.0, 410.0, True)]
    frame = spark.createDataFrame(rows, "text string, y0 double, y1 double, want boolean")
    assert all(r.got == r.want for r in frame.withColumn("got", F.expr(P.page_furniture(SPARK, "text", "y0", "y1"))).collect())


def test_cascades_on_literal_pages(spark):
    plain = "Birds fly over hills and lakes near our town every spring"
    prose = "\n\n".join(f"The {w} bird flew far over the hills and rested near a lake that was calm." for w in WORDS)
    rows = [
        ("short", True, False, False, False, "few_words"), ("see figure 3. " + "zq " * 40, False, False, False, True, "chart_word"), (prose, True, True, False, False, "chart_word"), ("Our assessment has a first point and a second. " * 3, True, False, True, False, "chart_word"),
        ("zq vw " * 40, False, False, False, True, "short_words"), ("Zebra Quagga Vole Weasel Otter Badger Rabbit Hedgehog Lizard Gecko Newt Frog Toad " * 2, True, False, True, False, "chart_word"),
    ]
    frame = X.with_text_features(spark.createDataFrame([(n, t) for n, (t, *_) in enumerate(rows)], "n long, text string"))
    got = frame.select("n", X.plain_text().alias("a"), X.continuous_prose().alias("b"), X.formatted_page().alias("c"), X.placement_context().alias("d"), X.ocr_skip(F.lit("photo.png")).alias("e")).orderBy("n").collect()
    assert [tuple(r)[1:5] for r in got[:3]] == [r[1:5] for r in rows[:3]] and got[0].e == "few_words" and got[4].a is False and got[4].e == "short_words" and got[3].c and got[5].c and got[5].a
    skip = [
        ("", "empty"), ("one two three", "few_words"), ("this figure has seven more words in it now", "chart_word"), ("bird 1234 5678 9012 3456 7890 1234 5678 9012", "symbols"), ("we go to be at an old inn and eat", "short_words"), ("birds equal twice birds when one bird plus another = birds", "math_sign"),
        ("birds write letters using http protocols every other lovely morning", "address"), ("birds sing lovely songs every other morning while\nothers\nsleep inside nests", "lines"), ("birds should click these buttons every other lovely morning somewhere", "interface"),
        ("birds sing lovely songs every other morning somewhere", "under_ten_words"), ("birds sing lovely songs every other morning somewhere beyond hills, obviously forest", "descriptive"), ("birds sing lovely songs every other morning. Others sleep inside nests beyond hills", "sentences"),
        ("birds sing lovely songs every other morning while others sleep inside nests", "not_academic"), ("our research shows birds sing lovely songs every other morning beyond hills", "translate"),
    ]
    frame = X.with_text_features(spark.createDataFrame([(n, t) for n, (t, _) in enumerate(skip)], "n long, text string"))
    assert [r.e for r in frame.select("n", X.ocr_skip(F.lit("photo.png")).alias("e")).orderBy("n").collect()] == [e for _, e in skip]
    named = X.with_text_features(spark.createDataFrame([(skip[-1][0],)], "text string")).select(X.ocr_skip(F.lit("Flow_1.png")).alias("e")).first().e
    assert named == "file_name" and plain


MARKDOWN = ["# Title", "", "first line", "second line", "", "third line", "- item one", "  2. item two", "", "", "## Sub title", "closing", "####### seven", "```", "# no heading", "```", "* last"]


def test_markdown_items_nodes_and_types(spark):
    frame = spark.createDataFrame([(1, n, t) for n, t in enumerate(MARKDOWN)] + [(2, 0, ""), (2, 1, " ")], "doc_id long, seq long, text string")
    items = [(r.kind, r.text) for r in M.structured_items(frame).orderBy("doc_id", "seq").collect()]
    assert items == [("h1", "Title"), ("paragraph", "first line\nsecond line\n\nthird line"), ("list_item", "item one"), ("list_item", "item two"), ("h2", "Sub title"), ("paragraph", "closing\n####### seven\n```"), ("h1", "no heading"), ("paragraph", "```"), ("list_item", "last")]
    nodes = M.text_nodes(frame.where("doc_id = 1"))
    assert [(r.head, r.node_text) for r in nodes.where("is_node").orderBy("seq").collect()][:5] == [("# ", "Title"), ("", "first line"), ("", "second line"), ("", "third line"), ("- ", "item one")]
    again = nodes.orderBy("seq").select(M.rebuilt(F.col("node_text")).alias("t"), M.rebuilt(F.upper("node_text")).alias("u")).collect()
    assert [r.t for r in again] == MARKDOWN and [r.u for r in again][13:16] == ["```", "# no heading", "```"] and again[7].u == "  2. ITEM TWO"
    typed = ["### Deep", "[3] a note", "a | b\tc", "    - nested item", "vi) roman", "12) number", "$x$", "words only", "* * *", "¹ mark"]
    got = M.typed_blocks(spark.createDataFrame([(1, n, t) for n, t in enumerate(typed)], "doc_id long, seq long, text string")).orderBy("seq").collect()
    assert [(r.kind, r.level, r.list_level, r.ordered, r.item_number, r.reference) for r in got] == [
        ("heading", 3, None, None, None, None), ("footnote", None, None, None, None, "3"), ("table", None, None, None, None, None), ("list_item", None, 2, False, None, None), ("list_item", None, 1, True, None, None),
        ("list_item", None, 1, True, 12, None), ("formula", None, None, None, None, None), ("paragraph", None, None, None, None, None), ("footnote", None, None, None, None, "*"), ("footnote", None, None, None, None, "¹"),
    ]


def test_reading_order_of_known_pages(spark):
    rows = [("two", 0, "A", 50, 50, 250, 100), ("two", 1, "B", 300, 50, 500, 100), ("two", 2, "C", 50, 110, 250, 160), ("two", 3, "D", 300, 110, 500, 160), ("head", 0, "E", 50, 50, 500, 100), ("head", 1, "F", 50, 110, 500, 160), ("head", 2, "G", 50, 10, 500, 40), ("stack", 0, "1", 0, 100, 100, 120), ("stack", 1, "2", 0, 80, 100, 100), ("stack", 2, "3", 0, 60, 100, 80)]
    boxes = spark.createDataFrame([(p, s, e, *map(float, b)) for p, s, e, *b in rows], "page string, seq long, name string, x0 double, y0 double, x1 double, y1 double")
    order = lambda frame, page: "".join(r.name for r in frame.join(boxes, ["page", "seq"]).where(F.col("page") == page).orderBy("position").collect())
    single, several = L.reading_order(boxes), L.multi_column_order(boxes)
    assert order(several, "two") == "ACBD" and order(single, "head") == "GEF" and order(single, "stack") == "321"


def test_groups_follow_a_plain_loop_with_contents_lines(spark):
    import random

    rng = random.Random(4)
    rows = [(d, n, n // 4 + 1, rng.choice(["h1", "paragraph", "image", "list_item"]), rng.choice(["x" * 3000, "Birds .... 12" + "y" * 2500, "z" * 200])) for d in range(4) for n in range(120)]
    got = {(r.doc_id, r.seq): r.group_id for r in G.smart_groups(spark.createDataFrame(rows, "doc_id long, seq long, page_num long, block_type string, text string")).collect()}
    want = {}
    for d in range(4):
        group, items, size, last = 0, 0, 0, None
        for _, seq, page, kind, text in [r for r in rows if r[0] == d]:
            early = page <= 10
            limit = 18000 if early or "...." in text else 12000
            change = (last[0] in ("image", "table") or kind in ("image", "table")) if early and last else bool(last) and last[0] == "h1" and kind != "h1"
            if items and (items >= 8 or size + len(text) > limit or change or (items > (5 if early else 3) and last[1] != page)):
                group, items, size = group + 1, 0, 0
            items, size, last = items + 1, size + len(text) + 18, (kind, page)
            want[d, seq] = group
    assert got == want


def test_places_and_context(spark):
    slots = spark.createDataFrame([(1, s) for s in (2, 5, 9)], "doc_id long, seq long")
    results = spark.createDataFrame([(1, 1, "a"), (1, 3, "c")], "doc_id long, place long, translated string")
    assert [(r.seq, r.translated) for r in G.zip_by_place(slots, results).orderBy("seq").collect()] == [(2, "a"), (5, None), (9, "c")]
    chunks = G.chunk_context(spark.createDataFrame([(1, [f"s{n}" for n in range(10)]), (2, []), (3, ["only"])], "doc_id long, sentences array<string>")).orderBy("doc_id", "chunk").collect()
    assert [tuple(r) for r in chunks] == [(1, 0, "", "s4 s5"), (1, 1, "s2 s3", "s8 s9"), (1, 2, "s6 s7", ""), (3, 0, "", "")]
    text = spark.createDataFrame([("ab abc b",)], "t string").select(G.longest_first(F.col("t"), [("ab", "1"), ("abc", "2"), ("b", "3")]).alias("t")).first().t
    assert text == "1 2 3"


def test_caches_and_dead_letters_survive_a_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "cache_key string, original_text string")
    vectors = spark.createDataFrame([("a", [1.0]), ("c", [2.0]), ("d", [3.0])], "cache_key string, embedding array<float>")
    T.write_embedding_cache(entries, vectors, str(tmp_path / "cache"))
    assert sorted((r.cache_key, r.original_text, r.embedding) for r in T.read_embedding_cache(spark, str(tmp_path / "cache")).collect()) == [("a", "x", [1.0]), ("c", "z", [2.0])]
    failed = spark.createDataFrame([(1, 2, "late")] * 3 + [(1, 3, "late")] * 2 + [(7, 0, "lost")] * 4, "file long, batch long, error string")
    letters = T.quarantined(failed, most=3, batch_pages=5)
    T.write_quarantine(letters, str(tmp_path / "dead"))
    assert sorted(tuple(r) for r in T.read_quarantine(spark, str(tmp_path / "dead")).collect()) == [(1, 2, 3, 10, 14, "late", "1_batch_2_quarantine.json"), (7, 0, 4, 0, 4, "lost", "7_batch_0_quarantine.json")]
    boxes = lambda rows: spark.createDataFrame(rows, "doc_id long, page long, seq long, label string, confidence double")
    got = T.with_heuristics(boxes([(1, 1, 0, "table", 0.9)]), boxes([(1, 1, 5, "image", 0.1), (2, 4, 6, "image", 0.1)])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0, "table", 0.9, "model"), (2, 4, 6, "figure", 0.8, "heuristic")]
