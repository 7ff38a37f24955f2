"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import checkpoint, only, sized

#: Largest mean of one Poisson draw; a larger mean is a sum of draws.
PART = 16.0
#: Terms of the inverted distribution; at a mean of ``PART`` the rest is below 1e-16.
TERMS = 80


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of a seed and keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_terms(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... at a mean of at most ``PART``."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["c"])


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, epochs: float) -> DataFrame:
    """One row per source: its mean number of copies and the terms to invert.

    Target weights are shares of all characters after mixing, relative to each other over the sources present; the
    output has ``epochs`` times the input's characters on average. A source of empty texts only is kept as it is.
    """
    sizes = only(docs, "source", "text").groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    weight = F.lit(float(default_weight))
    for name, value in sorted(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = checkpoint(sizes.withColumn("weight", weight))
    total = sizes.where(F.col("chars") > 0).agg(F.sum("chars"), F.sum("weight")).first()
    chars, mass = int(total[0] or 0), float(total[1] or 0.0)
    mean = F.when(F.col("chars") > 0, F.col("weight") * (epochs * chars) / (F.col("chars") * F.lit(mass or 1.0))).otherwise(F.lit(1.0))
    out = sizes.withColumn("rate", mean).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    return out.withColumn("terms", poisson_terms(F.col("rate") / F.col("parts"))).select("source", "rate", "parts", "terms")


def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Repeat each document a Poisson number of times and shuffle globally; adds copy and shuffle_key.

    A document's number of copies inverts the Poisson distribution of its source's mean at a number hashed
    from the seed, doc_id and draw, so any rerun gives the same rows. The output is dealt and sorted
    by a hash of (doc_id, copy). A null source is a source of its own with the default weight; null and empty texts
    are kept with their source's rate. Rows that repeat a doc_id get equal numbers of copies. Other columns, whatever their names, are
    passed through, but for own columns named copy or shuffle_key, which are replaced. An empty table gives no rows.

    A hot source needs no shuffle of its own: sizes are pre-aggregated, and the table of rates is broadcast while
    it is counted to be small; else adaptive execution splits the join's hot partitions.
    """
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rates = checkpoint(source_rates(docs, weights, default_weight, epochs))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = kept.join(sized(rates, 10_000), F.col("row.source").eqNullSafe(F.col("source")))
    hashed = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda k: uniform(seed, F.col("row.doc_id"), k))
    draws = F.transform(hashed, lambda u: F.size(F.filter("terms", lambda c: c <= u)))
    copies = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    many = joined.select("row", copies.alias("copies")).where(F.col("copies") > 0)
    many = many.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"s{seed}"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    keyed = many.select("row", "copy", key.alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("row.*", "copy", "shuffle_key")
