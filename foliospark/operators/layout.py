"""Layout operators on boxes: reading order, nearest neighbours, captions, overlaps, greedy suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def area(p: str = "") -> Column:
    return (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))


def centers(df: DataFrame) -> DataFrame:
    return df.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


def reading_order(boxes: DataFrame) -> DataFrame:
    """Single-column order: rows are bands of half the mean height (10 to 30 points), half-even rounding, then left to right."""
    page = Window.partitionBy("page")
    tall = F.greatest(F.lit(10.0), F.least(F.lit(30.0), F.avg(F.col("y1") - F.col("y0")).over(page) * 0.5))
    banded = boxes.withColumn("tol", tall).withColumn("band", F.expr("rint(y0 / tol)") * F.col("tol"))
    return banded.withColumn("position", F.row_number().over(page.orderBy("band", "x0", "seq")).cast("long")).select("page", "seq", "position")


def column_gaps(boxes: DataFrame, gap: float = 40.0) -> DataFrame:
    """Gaps wider than ``gap`` between a page's sorted horizontal edges, and whether the page has several columns."""
    edges = boxes.select("page", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    step = edges.withColumn("width", F.col("x") - F.lag("x").over(Window.partitionBy("page").orderBy("x")))
    return step.groupBy("page").agg(F.count_if(F.col("width") > gap / 2).alias("gaps"), F.coalesce(F.max("width"), F.lit(0.0)).alias("widest"), F.coalesce(F.max("width") > gap, F.lit(False)).alias("multi_column"))


def multi_column_order(boxes: DataFrame, split: float = 250.0) -> DataFrame:
    """Order by column of the centre, then top to bottom, left to right."""
    ranked = centers(boxes).withColumn("col", (F.col("cx") >= split).cast("long"))
    return ranked.select("page", "seq", "col", F.row_number().over(Window.partitionBy("page").orderBy("col", "y0", "x0", "seq")).cast("long").alias("position"))


def nearest_text(boxes: DataFrame, reach: float = 200.0) -> DataFrame:
    """Each figure with the page's nearest text by vertical centre distance below ``reach``; the first wins ties. An equi-join on page."""
    c = centers(boxes)
    figure = c.where("label = 'figure'").select("page", F.col("seq").alias("figure_seq"), F.col("cy").alias("fy"))
    text = c.where("label = 'text'").select("page", F.col("seq").alias("text_seq"), F.col("cy").alias("ty"))
    near = figure.join(text, "page").withColumn("distance", F.abs(F.col("fy") - F.col("ty"))).where(F.col("distance") < reach)
    best = near.groupBy("page", "figure_seq").agg(F.min(F.struct("distance", "text_seq")).alias("b"))
    return figure.select("page", "figure_seq").join(best, ["page", "figure_seq"], "left").select("page", "figure_seq", F.col("b.text_seq").alias("text_seq"), F.col("b.distance").alias("distance"))


def nearest_text_2d(boxes: DataFrame) -> DataFrame:
    """Each figure with its page's nearest other block by centre distance, and the side it lies on."""
    c = centers(boxes)
    figure = c.where("label = 'figure'").select("page", F.col("seq").alias("figure_seq"), F.col("cx").alias("fx"), F.col("cy").alias("fy"))
    text = c.where("label <> 'figure'").select("page", F.col("seq").alias("text_seq"), "cx", "cy")
    far = figure.join(text, "page").withColumn("d2", F.pow(F.col("cx") - F.col("fx"), 2) + F.pow(F.col("cy") - F.col("fy"), 2))
    best = far.groupBy("page", "figure_seq").agg(F.min(F.struct("d2", "text_seq", F.expr("cx - fx").alias("dx"), F.expr("cy - fy").alias("dy"))).alias("b"))
    side = F.when(F.abs("b.dy") > F.abs("b.dx"), F.when(F.col("b.dy") > 0, "below").otherwise("above")).otherwise(F.when(F.col("b.dx") > 0, "right").otherwise("left"))
    return best.select("page", "figure_seq", F.col("b.text_seq").alias("text_seq"), side.alias("position"))


def captions(boxes: DataFrame) -> DataFrame:
    """Each figure's caption: a text under it within half its height (50 to 100), overlapping a fifth of its width, nearest first."""
    figure = boxes.where("label = 'figure'").select("page", F.col("seq").alias("figure_seq"), F.col("x0").alias("fx0"), F.col("x1").alias("fx1"), F.col("y0").alias("fy0"), F.col("y1").alias("fy1"))
    text = boxes.where("label in ('text', 'title')").select("page", F.col("seq").alias("text_seq"), "x0", "x1", "y0")
    reach = F.greatest(F.lit(50.0), F.least(F.lit(100.0), (F.col("fy1") - F.col("fy0")) / 2))
    overlap = (F.least("fx1", "x1") - F.greatest("fx0", "x0")) / (F.col("fx1") - F.col("fx0"))
    near = figure.join(text, "page").withColumn("gap", F.col("y0") - F.col("fy1")).where((F.col("gap") >= 0) & (F.col("gap") <= reach) & (overlap > 0.2))
    return near.groupBy("page", "figure_seq").agg(F.min(F.struct("gap", "text_seq")).alias("b")).select("page", "figure_seq", F.col("b.text_seq").alias("text_seq"), F.col("b.gap").alias("gap"))


def overlaps(boxes: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Pairs of a page's boxes that touch within a tolerance, with their common box. Pages bound the pairs."""
    a = boxes.select("page", F.col("seq").alias("a"), *[F.col(c).alias("a" + c) for c in ("x0", "y0", "x1", "y1")])
    b = boxes.select("page", F.col("seq").alias("b"), *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    t = F.lit(tolerance)
    hit = (F.col("ax0") <= F.col("bx1") + t) & (F.col("bx0") <= F.col("ax1") + t) & (F.col("ay0") <= F.col("by1") + t) & (F.col("by0") <= F.col("ay1") + t)
    return a.join(b, "page").where((F.col("a") < F.col("b")) & hit).select("page", "a", "b", F.least("ax0", "bx0").alias("x0"), F.least("ay0", "by0").alias("y0"), F.greatest("ax1", "bx1").alias("x1"), F.greatest("ay1", "by1").alias("y1"))


def outside_visuals(boxes: DataFrame) -> DataFrame:
    """Texts that overlap no figure or table of their page (anti-join)."""
    t = boxes.where("label not in ('figure', 'table')").alias("t")
    v = boxes.where("label in ('figure', 'table')").alias("v")
    on = (F.col("t.page") == F.col("v.page")) & (F.col("t.x0") < F.col("v.x1")) & (F.col("v.x0") < F.col("t.x1")) & (F.col("t.y0") < F.col("v.y1")) & (F.col("v.y0") < F.col("t.y1"))
    return t.join(v, on, "left_anti").select("page", "seq")


def suppress(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Greedy suppression by page: by falling confidence, a box stays if it covers no kept box by ``share`` of the smaller area.

    A fold over the page's sorted boxes; a page bounds the array.
    """
    box = F.struct((-F.col("confidence")).alias("rank"), "seq", "x0", "y0", "x1", "y1")
    inter = lambda k, b: f"greatest(0D, least({k}.x1, {b}.x1) - greatest({k}.x0, {b}.x0)) * greatest(0D, least({k}.y1, {b}.y1) - greatest({k}.y0, {b}.y0))"
    size = lambda b: f"({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0)"
    fold = f"aggregate(sorted, filter(sorted, x -> false), (kept, b) -> if(exists(kept, k -> {inter('k', 'b')} >= {share} * least({size('k')}, {size('b')})), kept, concat(kept, array(b))))"
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(box)).alias("sorted"))
    return pages.select("page", F.explode(F.expr(fold)).alias("b")).select("page", F.col("b.seq").alias("seq"))
