"""Nearest vectors within a group, block against block."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a block of vectors; a task holds a block of queries and one of candidates.
BLOCK_ROWS, BLOCK_BYTES = 4096, 2 << 20
#: Pairs that are scored at once.
_PAIRS = 1 << 20

_FOUND_SQL = "vec_id long, match_id long, sim double"
_FOUND = pa.schema([("vec_id", pa.int64()), ("match_id", pa.int64()), ("sim", pa.float64())])


def nearest_of_label(vectors: DataFrame, every: int = 20, rows: int = BLOCK_ROWS) -> DataFrame:
    """The nearest other vector (vec_id, match_id) of the same label for every vec_id divisible by ``every``.

    Vectors are (vec_id, label, v). The largest inner product wins, rounded to nine places; ties go to the smaller match_id.
    A null vector, a null component or unequal lengths give no product, which is below all others.

    All pairs of a query and a row of its label are scored, so the work is quadratic within a label. Its queries and its rows are dealt
    into blocks of at most about ``rows``, each pair of blocks is a cell, and cells are dealt over as many tasks as their rows fill:
    no task's memory grows with a label, and no pair becomes a row. Of a cell only those rows are handed on that can be a query's best.
    """
    given = vectors.where(F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<double>").alias("v"))
    ask = F.col("vec_id") % every == 0
    labels = given.groupBy("label").agg(F.count("*").alias("n"), F.count_if(ask).alias("m"), F.max(F.size("v")).alias("width"))
    labels = labels.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(rows), F.expr(f"{BLOCK_BYTES} div (8 * greatest(width, 1))"))).cast("long"))
    labels = labels.withColumns({"row_parts": F.ceil(F.col("n") / F.col("block")), "query_parts": F.greatest(F.lit(1), F.ceil(F.col("m") / F.col("block")))})
    filled = labels.agg(F.sum((F.col("row_parts") * F.col("m") + F.col("query_parts") * F.col("n")) / F.col("block"))).first()[0]
    large = labels.where("row_parts > 1").select("label", "row_parts", "query_parts")  # one for each block's worth of rows at most
    known = given.join(F.broadcast(large), "label", "left").withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("row_parts", "query_parts")})

    def dealt(side: DataFrame, query: bool) -> DataFrame:
        own, other = ("query_part", "row_part") if query else ("row_part", "query_part")
        placed = side.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.col(f"{own}s")))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1))).select("label", "query_part", "row_part", F.lit(0 if query else 1).alias("kind"), "vec_id", "v")

    cells = dealt(known.where(ask), True).union(dealt(known.where("vec_id is not null"), False))
    cells = cells.repartition(max(1, int(np.ceil(filled or 0))), "label", "query_part", "row_part").sortWithinPartitions("label", "query_part", "row_part", "kind")
    near = cells.mapInArrow(_search, _FOUND_SQL).withColumn("sim", F.round("sim", 9))
    return near.groupBy("vec_id").agg(F.max_by("match_id", F.struct("sim", -F.col("match_id"))).alias("match_id"))


class _Block:
    """Vectors of one side of a cell: ids, lengths (-1: without products), all components one after the other."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, ids: pa.Array, vectors: pa.ListArray) -> None:
        flat = vectors.flatten()
        held = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fit = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, held)
        if flat.null_count:
            fit[np.repeat(np.arange(len(held)), held)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        self.parts.append((ids.to_numpy(zero_copy_only=False), fit, held, flat.to_numpy(zero_copy_only=False)))
        self.rows += len(held)

    def gathered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, fit, held, flat = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        return ids, fit, np.cumsum(held) - held, flat


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that can be a query's best in its cell; rows come sorted by cell, its queries first."""
    cell, asked, met = None, _Block(), _Block()
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("label", "query_part", "row_part", "kind")), strict=True)
        at = 0
        for (*here, kind), run in groupby(keys):
            n = sum(1 for _ in run)
            if here != cell:
                yield from _met(asked, met)
                cell, asked, met = here, _Block(), _Block()
            (met if kind else asked).add(batch.column("vec_id").slice(at, n), batch.column("v").slice(at, n))
            at += n
            if met.rows >= 2 * BLOCK_ROWS:
                yield from _met(asked, met)
                met = _Block()
    yield from _met(asked, met)


def _met(asked: _Block, met: _Block) -> Iterator[pa.RecordBatch]:
    if not asked.rows or not met.rows:
        return
    ask_ids, ask_fit, ask_at, ask_flat = asked.gathered()
    ids, fit, at, flat = met.gathered()
    for width in np.unique(ask_fit):
        queries, rows = np.flatnonzero(ask_fit == width), np.flatnonzero((fit == width) & (width >= 0))
        apart = np.unique(np.delete(ids, rows))[:2]  # without products; the smallest other id stands for all
        if len(apart):
            own = ask_ids[queries]
            other = np.where(apart[0] != own, apart[0], apart[-1])
            own, other = own[other != own], other[other != own]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.nulls(len(own), pa.float64())], schema=_FOUND)
        if len(rows):
            a, b = ask_flat[ask_at[queries][:, None] + np.arange(width)], flat[at[rows][:, None] + np.arange(width)]
            yield from _scored(ask_ids[queries], a, ids[rows], b)


def _scored(ask_ids: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs whose product, rounded to nine places, can be the query's largest, one for each product.

    A matrix product, whose order of addition is not fixed, rules pairs out within its error bound; the others' products
    are added up from the first component to the last.
    """
    eps, step = np.finfo(float).eps, max(1, _PAIRS // len(b))
    with np.errstate(all="ignore"):
        longest = np.sqrt((b * b).sum(1)).max()
        for i in range(0, len(a), step):
            own, mine = ask_ids[i : i + step], a[i : i + step]
            rough, same = mine @ b.T, own[:, None] == ids
            if np.isfinite(rough).all():
                slack = 4e-9 + 8 * eps * (b.shape[1] + 1) * np.sqrt((mine * mine).sum(1)) * longest
                rough[same] = -np.inf
                q, r = np.nonzero((rough >= (rough.max(1) - slack)[:, None]) & ~same)
            else:
                q, r = np.nonzero(~same)
            if not len(q):
                continue
            sim = np.zeros(len(q))
            for x, y in zip(mine.T, b.T, strict=True):
                sim += x[q] * y[r]
            starts = np.flatnonzero(np.diff(q, prepend=-1))
            most = np.repeat(np.maximum.reduceat(sim, starts), np.diff(starts, append=len(q)))
            good = np.where(np.isnan(most), np.isnan(sim), sim >= np.where(np.isfinite(most), most - 4e-9 - 8 * eps * np.abs(most), most))
            q, match, sim = q[good], ids[r[good]], np.where(np.isnan(sim[good]), np.nan, sim[good] + 0.0)
            order = np.lexsort((match, sim.view(np.int64), q))
            q, match, sim = q[order], match[order], sim[order]
            bits = sim.view(np.int64)
            first = np.concatenate([[True], (q[1:] != q[:-1]) | (bits[1:] != bits[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(own[q[first]]), pa.array(match[first]), pa.array(sim[first])], schema=_FOUND)
