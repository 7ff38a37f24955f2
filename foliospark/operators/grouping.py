"""Order-dependent operators: folds that reset, islands, context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foliospark.functions.portable import SPARK
from foliospark.functions.predicates import toc_line

#: Fixed value: what stands between the items of a group.
SEPARATOR = 18


def _doc() -> WindowSpec:
    """Rows of a document in order."""
    return Window.partitionBy("doc_id").orderBy("seq")


def _fold(df: DataFrame, cut: str, size: str, out: str) -> DataFrame:
    """Group numbers by a fold over each document's sorted items.

    The fold emits only the places where a group begins, so its state grows with the groups and not with the items. ``cut``
    tells whether an item ``i`` (seq, n, page_num, block_type, toc) begins a new group after state ``s`` (k items of size z, page p, type t),
    ``size`` what the item adds. A document bounds the arrays.
    """
    packed = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "page_num", "block_type", "toc"))).alias("items"))
    begun = f"named_struct('at', s.at + 1, 'k', 1L, 'z', {size}, 'p', i.page_num, 't', i.block_type, 'b', concat(s.b, array(s.at)))"
    grown = f"named_struct('at', s.at + 1, 'k', s.k + 1, 'z', s.z + {size}, 'p', i.page_num, 't', i.block_type, 'b', s.b)"
    start = "named_struct('at', 0, 'k', 0L, 'z', 0L, 'p', cast(null as bigint), 't', cast(null as string), 'b', array(0))"
    ends = packed.select("doc_id", "items", F.expr(f"aggregate(items, {start}, (s, i) -> if(s.k > 0 and ({cut}), {begun}, {grown}), s -> concat(s.b, array(s.at)))").alias("b"))
    groups = ends.select("doc_id", F.posexplode(F.expr("transform(sequence(0, size(b) - 2), g -> slice(items.seq, b[g] + 1, b[g + 1] - b[g]))")).alias("g", "members"))
    inside = groups.select("doc_id", "g", F.explode("members").alias("seq"))
    return inside.select("doc_id", "seq", F.col("g").cast("long").alias(out))


def smart_groups(lines: DataFrame, max_items: int = 8, max_size: int = 12000) -> DataFrame:
    """Group consecutive lines.

    A new group begins at ``max_items``, above the size limit (1.5 times that on the first ten pages and for lines of a table of
    contents), at headings' ends (on the first ten pages at images and tables), and at a new page above five (later three) items.
    """
    items = lines.withColumn("n", F.length("text").cast("long")).withColumn("toc", F.expr(toc_line(SPARK, "text")))
    early = "i.page_num <= 10"
    full = f"s.z + i.n > if({early} or i.toc, {min(int(max_size * 1.5), 18000)}L, {max_size}L)"
    kind = f"if({early}, s.t in ('image', 'table') or i.block_type in ('image', 'table'), s.t in ('h1', 'h2', 'h3') and i.block_type not in ('h1', 'h2', 'h3'))"
    page = f"(s.k > if({early}, 5, 3) and s.p <> i.page_num)"
    return _fold(items, f"s.k >= {max_items} or {full} or {kind} or {page}", f"i.n + {SEPARATOR}", "group_id")


def batches(lines: DataFrame, limit: int = 15000) -> DataFrame:
    """Next-fit batches: a new one when the next line would pass the limit."""
    items = lines.withColumn("n", F.length("text").cast("long")).withColumn("toc", F.lit(False))
    return _fold(items, f"s.z + i.n > {limit}", "i.n", "batch_id")


def neighbour_context(lines: DataFrame) -> DataFrame:
    """The line before (last 100 characters) and after (first 100)."""
    return lines.select("doc_id", "seq", F.coalesce(F.expr("right(lag(text) over (partition by doc_id order by seq), 100)"), F.lit("")).alias("before"), F.coalesce(F.expr("left(lead(text) over (partition by doc_id order by seq), 100)"), F.lit("")).alias("after"))


def two_sided_context(lines: DataFrame) -> DataFrame:
    """Up to two lines on both sides, 200 characters each, nearest first."""
    cut = lambda side, f, n: F.expr(f"{side}({f}(text, {n}) over (partition by doc_id order by seq), 200)")
    return lines.select("doc_id", "seq", F.concat_ws("|", cut("right", "lag", 1), cut("right", "lag", 2)).alias("before"), F.concat_ws("|", cut("left", "lead", 1), cut("left", "lead", 2)).alias("after"))


def island(flag: Column) -> Column:
    """Number of flagged rows up to each row of a document."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(_doc().rowsBetween(Window.unboundedPreceding, 0))


def paragraph_runs(lines: DataFrame) -> DataFrame:
    """Runs of consecutive paragraphs as one block each, joined by a break mark; attributes of the first."""
    flagged = lines.withColumn("run", island(F.col("block_type") != "paragraph"))
    runs = flagged.where("block_type = 'paragraph'").groupBy("doc_id", "run")
    return runs.agg(F.min("seq").alias("seq"), F.count("*").alias("members"), F.min("page_num").alias("page_num"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "[PARAGRAPH_BREAK]")).alias("text_md5")).drop("run")


def theme_sessions(lines: DataFrame, themes: Column, most: int = 10) -> DataFrame:
    """A new group at each change of theme or after ``most`` items; the first item's theme counts as general."""
    first = F.row_number().over(_doc()) == 1
    named = lines.withColumn("theme", F.when(first, "general").otherwise(themes))
    named = named.withColumn("run", F.sum(F.when(F.lag("theme").over(_doc()) != F.col("theme"), 1).otherwise(0)).over(_doc().rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("seq")) - 1
    return named.select("doc_id", "seq", "theme", F.col("run").cast("long").alias("run"), F.floor(inside / most).cast("long").alias("part"))


def section_bounds(lines: DataFrame) -> DataFrame:
    """Each heading's section ends on the page before the next heading; the last ends with the document."""
    last = lines.groupBy("doc_id").agg(F.max("page_num").alias("pages"))
    heads = lines.where("block_type in ('h1', 'h2', 'h3')").withColumn("next", F.lead("page_num").over(_doc()))
    return heads.join(last, "doc_id").select("doc_id", "seq", F.col("page_num").alias("start_page"), F.coalesce(F.col("next") - 1, F.col("pages")).alias("end_page"))


def join_lines(lines: DataFrame) -> DataFrame:
    """A document's lines as one text: a trailing hyphen is closed up, else lines are joined by a space."""
    packed = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("t"))
    return packed.select("doc_id", F.md5(F.expr("regexp_replace(regexp_replace(array_join(t, '\\n'), '-\\n', ''), '\\n', ' ')")).alias("joined_md5"))


def sentence_chunks(docs: DataFrame, sentences: Column, limit: int = 2000) -> DataFrame:
    """Greedy chunks of sentences up to ``limit`` characters; the next chunk starts with the last sentence."""
    step = f"if(s.k > 0 and s.z + length(x) > {limit}, named_struct('k', 2L, 'z', cast(length(s.l) + length(x) as bigint), 'l', x, 'o', concat(s.o, array(s.z))), named_struct('k', s.k + 1, 'z', s.z + length(x), 'l', x, 'o', s.o))"
    fold = f"aggregate(ss, named_struct('k', 0L, 'z', 0L, 'l', '', 'o', cast(array() as array<bigint>)), (s, x) -> {step}, s -> if(s.k > 0, concat(s.o, array(s.z)), s.o))"
    return docs.select("doc_id", sentences.alias("ss")).select("doc_id", F.posexplode(F.expr(fold)).alias("chunk", "size")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "size")


def fill_pages(lines: DataFrame, known: Column) -> DataFrame:
    """Missing page numbers continue from the last known one, one page a row."""
    rows = lines.withColumn("known", known).withColumn("run", island(F.col("known").isNotNull()))
    part = Window.partitionBy("doc_id", "run").orderBy("seq")
    base = F.first("known").over(part)
    return rows.select("doc_id", "seq", F.coalesce(base + F.row_number().over(part) - 1, F.row_number().over(_doc()).cast("long")).cast("long").alias("page"))


def ordered_text(column: str, sep: str) -> Column:
    """A group's texts as one, in order of seq; null ones are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", column))), lambda x: x[column]), sep)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their place in the document, by the given order (seq if none)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("doc_id").orderBy(*(order or (F.col("seq"),)))).cast("long"))


def zip_by_place(slots: DataFrame, results: DataFrame) -> DataFrame:
    """Results (doc_id, place, ...) put into a document's slots by place; a key join, so a missing result shifts nothing."""
    return numbered(slots, "place").join(results, ["doc_id", "place"], "left")


def chunk_context(docs: DataFrame, size: int = 4, width: int = 200) -> DataFrame:
    """Chunks of ``size`` sentences with up to two sentences, ``width`` characters, before and after each."""
    starts = docs.where(F.size("sentences") > 0).select("doc_id", "sentences", F.explode(F.expr(f"sequence(0, size(sentences) - 1, {size})")).alias("at"))
    before = F.expr(f"if(at = 0, '', right(array_join(slice(sentences, greatest(at - 1, 1), least(2, greatest(at, 1))), ' '), {width}))")
    after = F.expr(f"left(array_join(slice(sentences, at + {size} + 1, 2), ' '), {width})")
    return starts.select("doc_id", F.expr(f"cast(at div {size} as bigint)").alias("chunk"), before.alias("before"), after.alias("after"))


def longest_first(text: Column, terms: list[tuple[str, str]]) -> Column:
    """A text with each term of a small glossary replaced, longest term first, ties by the term."""
    for term, by in sorted(terms, key=lambda t: (-len(t[0]), t[0])):
        text = F.replace(text, F.lit(term), F.lit(by))
    return text
