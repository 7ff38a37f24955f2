"""Operators on marked-up documents given as lines (doc_id, seq, text): items, typed blocks, nodes, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import predicates as P
from foliospark.functions.portable import SPARK
from foliospark.operators.grouping import island, ordered_text

#: Marks before a line's text.
PREFIX = r"^(\s*(?:#{1,6}|[-*+]|\d+\.)\s+)"


def _bare(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))


def structured_items(lines: DataFrame) -> DataFrame:
    """Items (doc_id, seq, kind, text): headings h1 to h6, list items, and the paragraphs that run between them.

    Blank lines stay inside a paragraph and end none; a run of blank lines alone is no item.
    """
    t = _bare(F.col("text"))
    hashes = F.regexp_extract(t, r"^(#{1,6})\s+.+$", 1)
    mark = F.when(hashes != "", F.concat(F.lit("h"), F.length(hashes))).when(t.rlike(r"^([-*+]|\d+\.)\s+.+$"), "list_item")
    marked = lines.select("doc_id", "seq", t.alias("text"), mark.alias("mark"))
    runs = marked.withColumn("run", island(F.col("mark").isNotNull()))
    single = marked.where("mark is not null").select("doc_id", "seq", F.col("mark").alias("kind"), _bare(F.regexp_replace("text", r"^(#+|[-*+]|\d+\.)\s+", "")).alias("text"))
    joined = runs.where("mark is null").groupBy("doc_id", "run").agg(F.min("seq").alias("seq"), F.max("text").alias("most"), ordered_text("text", "\n").alias("text")).where("most <> ''")
    return single.unionByName(joined.select("doc_id", "seq", F.lit("paragraph").alias("kind"), _bare(F.col("text")).alias("text")))


def typed_blocks(lines: DataFrame) -> DataFrame:
    """Typed blocks of non-blank lines: kind, level of headings, level, order and number of list items, reference of footnotes.

    Precedence is heading, footnote, table, list item, formula, paragraph. List levels count four spaces of indentation each.
    """
    rows = lines.select("doc_id", "seq", F.col("text").alias("raw"), _bare(F.col("text")).alias("text")).where("text <> ''")
    rows = rows.withColumn("hashes", F.regexp_extract("raw", r"^(#+)\s", 1))
    kind = (
        F.when(F.col("hashes") != "", "heading").when(F.expr(P.footnote(SPARK, "text")), "footnote").when(F.expr(P.table_line(SPARK, "text")), "table")
        .when(F.expr(P.list_item(SPARK, "text")), "list_item").when(F.expr(P.equation(SPARK, "text")), "formula").otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    of = lambda name, value: F.when(F.col("kind") == name, value)
    found = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    marks = F.coalesce(*[found(p) for p in (r"^\[(\d+)\]", r"^\((\d+)\)", r"^(\d+)\.", r"^([¹²³⁴⁵⁶⁷⁸⁹⁰]+)", r"^(\*+)")], F.lit(""))
    lead = F.length("raw") - F.length(F.ltrim(F.col("raw"), F.lit(" \t\n\x0b\x0c\r")))
    return rows.select(
        "doc_id", "seq", "kind", of("heading", F.least(F.length("hashes"), F.lit(6)).cast("long")).alias("level"), of("list_item", (F.floor(lead / 4) + 1).cast("long")).alias("list_level"),
        of("list_item", F.col("text").rlike(r"(?i)^(\d+|[a-z]|[ivxlcdm]+)[.)]\s+")).alias("ordered"), of("list_item", F.expr(r"try_cast(regexp_extract(text, r'^(\d+)[.)]\s+', 1) as bigint)")).alias("item_number"),
        of("footnote", marks).alias("reference"),
    )


def text_nodes(lines: DataFrame) -> DataFrame:
    """Lines with is_node, head (its marks) and node_text; code between fences, fences and blank lines are no nodes."""
    fence = F.ltrim(F.col("text")).startswith("```")
    inside = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("fence", fence).withColumn("open", F.sum(F.col("fence").cast("int")).over(inside) % 2 == 1)
    rows = rows.withColumn("is_node", ~F.col("fence") & ~F.col("open") & (_bare(F.col("text")) != "")).withColumn("head", F.regexp_extract("text", PREFIX, 1))
    return rows.select("doc_id", "seq", "text", "is_node", "head", F.expr("substr(text, length(head) + 1)").alias("node_text"))


def rebuilt(node: Column) -> Column:
    """A line with its node replaced and its marks kept; what is no node stays."""
    return F.when(F.col("is_node"), F.concat("head", node)).otherwise(F.col("text"))


def bundle(lines: DataFrame) -> DataFrame:
    """Counts of a marked-up document's parts."""
    hit = lambda pattern: F.count_if(F.col("text").rlike(pattern))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return lines.groupBy("doc_id").agg(
        hit(r"^#{1,6}\s+\S").alias("sections"), hit(r"^\s*([-*+]|\d+\.)\s+").alias("items"), hit(r"\|.*\|").alias("table_rows"), hit(r"\$[^$]+\$").alias("equations"), hit(r"(?i)(figure|fig\.?)\s*\d+").alias("figures"),
        F.sum(words).alias("words"), (F.sum(F.length("text")) + F.count("*") - 1).alias("chars"),
    )


def reconcile(blocks: DataFrame, visuals: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_num, page_num, role) with the first visual (doc_id, page_num, seq) of their page where they hold its place.

    ``kind`` is image, heading, paragraph, or dropped: tables and unmatched places.
    """
    first = visuals.groupBy("doc_id", "page_num").agg(F.min("seq").alias("visual_seq")).withColumn("role", F.lit("placeholder"))
    joined = blocks.join(first, ["doc_id", "page_num", "role"], "left")
    kind = F.when(F.col("visual_seq").isNotNull(), "image").when(F.col("role").isin("heading", "paragraph"), F.col("role")).otherwise("dropped")
    return joined.withColumn("kind", kind)


def kept_blocks(reconciled: DataFrame) -> DataFrame:
    """The blocks of the reconciled document."""
    return reconciled.where("kind <> 'dropped'")


def correction_prompt(kind: str, original: Column, translation: Column, issues: str, language: str) -> Column:
    """A prompt that names the lost structure, its issues and fixes, and both texts."""
    fixes = F.when(F.col(kind) == "table", "keep all rows, columns and pipes").when(F.col(kind) == "code", "keep fences, names and indentation").when(F.col(kind) == "latex", "keep commands and delimiters")
    fixes = fixes.when(F.col(kind) == "list", "keep markers, order and levels").otherwise("keep paragraphs and headings")
    subject = F.when(F.col(kind) == "general", "text").otherwise(F.col(kind))
    head = F.concat(F.lit("The "), subject, F.lit(" below lost its structure in translation."))
    return F.concat_ws("\n", head, F.lit(f"Issues: {issues}"), F.concat(F.lit("Fixes: "), fixes), F.concat(F.lit("Original: "), original), F.concat(F.lit("Translation: "), translation), F.lit(f"Language: {language}"))


def visual_markup(kind: str, text: str) -> Column:
    """A table as HTML, a formula as LaTeX, other kinds as they are."""
    t = F.col(text)
    row = F.concat(F.lit("<table><tr><td>"), F.replace(t, F.lit(" "), F.lit("</td><td>")), F.lit("</td></tr></table>"))
    return F.when(F.col(kind) == "table", row).when(F.col(kind) == "title", F.concat(F.lit("$$"), t, F.lit("$$"))).otherwise(t)
