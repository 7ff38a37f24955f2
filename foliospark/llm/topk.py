"""Exact top-k inner-product search with dual cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import checkpoint, only

#: Vectors, and bytes of vectors, of one data part; queries searched at once; points of a leaf of data and of queries.
PART_ROWS, PART_BYTES, QUERY_BLOCK, LEAF, QUERY_LEAF = 4_000, 32 << 20, 2_000, 64, 8
#: Vectors of the bounded, hash-ordered sample whose cover tree gives the cells; every vector goes to a cell.
CELL_SAMPLE = 1_024
#: Points of a node that show whether its net is worth while.
PROBE = 256
#: Below the first product of norms float64 sums of whole numbers are exact, below the second those of int64.
FLOAT_EXACT, INT_EXACT = 2.0**52, 2.0**62
#: Vectors of this norm or more have a cell of their own, as their scores may need whole numbers of any size.
WIDE = 2.0**26
LEAST, MOST = -(2**63), 2**63 - 1


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        gap = points - center
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _net(points: np.ndarray, first: int, gap: np.ndarray, radius: float, most: int) -> tuple[list[int], np.ndarray]:
    """Centres, farthest first, until all points are within ``radius`` of one or there are ``most``; and each point's centre."""
    centers, nearest, gap = [first], np.zeros(len(points), np.int64), gap.copy()
    while len(centers) < most:
        pick = int(np.argmax(gap))
        if gap[pick] <= radius:
            break
        new = _distances(points, points[pick])
        nearest[new < gap], gap = len(centers), np.minimum(gap, new)
        centers.append(pick)
    return centers, nearest


class CoverTree:
    """A cover tree of levels: a node is a point that covers its points within 2**level.

    Nesting: the first child of a node has the node's own point. Covering: every point of a node is within
    ``radius`` <= 2**level of its point. Separation: points of siblings are more than 2**(level - 1) apart, so that
    children, on lower levels, cover at most half as far. Levels with one child are left out. A node of at most ``leaf``
    points, of equal points, or whose net would have over half as many points as itself (where no radius
    can tell points apart) is a leaf. ``rows`` are the node's points, a slice of ``order``.
    """

    __slots__ = ("at", "center", "radius", "level", "kids", "rows", "norm", "most", "below")

    def __init__(self, points: np.ndarray, norms: np.ndarray, rows: np.ndarray, at: int, leaf: int) -> None:
        away = _distances(points[rows], points[at])
        widest = float(away.max())
        self.at, self.center, self.rows, self.kids, self.below = at, points[at], rows, [], None
        self.radius, self.norm, self.most = widest * (1 + 1e-9), float(norms[at]), float(norms[rows].max())
        self.level = math.ceil(math.log2(widest)) if 0 < widest < math.inf else -1_100
        if len(rows) <= leaf or not 0 < widest < math.inf:
            return
        radius = 2.0 ** (self.level - 1)
        own = points[rows]
        if len(rows) > 2 * PROBE:
            some = np.linspace(0, len(rows) - 1, PROBE).astype(np.int64)
            if len(_net(own[some], 0, _distances(own[some], own[some[0]]), radius, PROBE // 2 + 1)[0]) > PROBE // 2:
                return
        centers, nearest = _net(own, int(np.flatnonzero(rows == at)[0]), away, radius, len(rows) // 2 + 1)
        if len(centers) > len(rows) // 2:
            return
        order = np.argsort(nearest, kind="stable")
        for kid, part in zip(centers, np.split(order, np.cumsum(np.bincount(nearest, minlength=len(centers)))[:-1]), strict=True):
            self.kids.append(CoverTree(points, norms, rows[part], int(rows[kid]), leaf))
        self.below = (np.array([n.center for n in self.kids]), *(np.array([getattr(n, x) for n in self.kids]) for x in ("norm", "radius", "most")))

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        """The tree of all rows; the root is the point next to their mean."""
        norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        with np.errstate(all="ignore"):
            middle = _distances(points, points.mean(axis=0))
        return cls(points, norms, np.arange(len(points)), int(np.argmin(middle)), leaf)


def pair_bound(dot: np.ndarray | float, norm: np.ndarray | float, radius: np.ndarray | float, most: np.ndarray | float, center: np.ndarray | float, cover: np.ndarray | float, far: np.ndarray | float) -> np.ndarray:
    """No inner product of a query group and a data node exceeds this.

    The group's point has norm ``norm`` and covers ``radius``, its longest query is ``most``; the node's point has norm ``center`` and covers
    ``cover``, its longest vector is ``far``; ``dot`` is the product of both points. The bound is the least of the
    expanded product, of what the points' distance leaves, and of the product of norms.
    """
    with np.errstate(all="ignore"):
        one = dot + norm * cover + center * radius + radius * cover
        apart = np.maximum(0.0, np.sqrt(np.maximum(0.0, norm * norm + center * center - 2 * dot)) * (1 - 1e-7) - radius - cover)
        two = (most * most + far * far - apart * apart) / 2
        return np.minimum(np.minimum(one, two), most * far) + 1e-7 * (1 + most * far)


class Top:
    """The best ``k`` scores of each query with their ids, ties to the smaller id, as whole numbers."""

    def __init__(self, queries: int, k: int, floor: np.ndarray, wide: bool) -> None:
        kind = object if wide else np.int64
        self.k, self.wide, self.floor, self.scored = k, wide, floor, np.zeros(queries, np.int64)
        self.score, self.ids = np.full((queries, k), -MOST, kind), np.full((queries, k), MOST, np.int64)
        self.worst = np.array(floor, np.float64)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of ``rows`` against points named ``ids``; ``own`` marks the query's own rows."""
        self.scored[rows] += score.shape[1]
        if self.wide:
            for n, row in enumerate(rows.tolist()):
                mine = [(s, i) for s, i in zip(self.score[row], self.ids[row].tolist(), strict=True) if i != MOST]
                mine += [(max(LEAST, min(MOST, int(s))), int(i)) for s, i, o in zip(score[n], ids, own[n], strict=True) if not o]
                for at, (s, i) in enumerate(sorted(mine, key=lambda x: (-x[0], x[1]))[: self.k]):
                    self.score[row, at], self.ids[row, at] = s, i
        else:
            score[own] = -MOST
            wide = np.concatenate([self.score[rows], score], 1)
            near = np.concatenate([self.ids[rows], np.where(own, MOST, ids[None, :])], 1)
            if wide.shape[1] > 4 * self.k:
                least = np.partition(wide, wide.shape[1] - self.k, axis=1)[:, [wide.shape[1] - self.k]]
                keep = int((wide >= least).sum(axis=1).max())
                picked = np.argpartition(-wide, min(keep, wide.shape[1] - 1), axis=1)[:, :keep] if keep < wide.shape[1] else None
                if picked is not None:
                    wide, near = np.take_along_axis(wide, picked, 1), np.take_along_axis(near, picked, 1)
            order = np.lexsort((near, -wide), axis=-1)[:, : self.k]
            self.score[rows], self.ids[rows] = np.take_along_axis(wide, order, 1), np.take_along_axis(near, order, 1)
        full = self.ids[rows, self.k - 1] != MOST
        last = np.where(full, self.score[rows, self.k - 1].astype(np.float64), -np.inf)
        self.worst[rows] = np.maximum(self.worst[rows], last)


def _products(q: np.ndarray, p: np.ndarray, size: float, q_raw: np.ndarray, p_raw: np.ndarray, scale: int) -> np.ndarray:
    """Exact inner products of scaled vectors as whole numbers."""
    if size < FLOAT_EXACT:
        return (q @ p.T).astype(np.int64)
    if size < INT_EXACT:
        return q.astype(np.int64) @ p.astype(np.int64).T
    whole = lambda v, raw: int(v) if math.isfinite(v) else scale * int(raw)
    exact = lambda m, raw: np.array([[whole(v, r) for v, r in zip(a, b, strict=True)] for a, b in zip(m.tolist(), raw.tolist(), strict=True)], object).reshape(m.shape)
    return exact(q, q_raw) @ exact(p, p_raw).T


class Part:
    """The vectors of one data part and their cover tree, which is built once."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, scale: int) -> None:
        with np.errstate(over="ignore"):
            self.ids, self.raw, self.scale, self.points = ids, raw, scale, np.floor(scale * raw)
        self.tree = CoverTree.of(self.points)

    def search(self, ids: np.ndarray, raw: np.ndarray, floor: np.ndarray, k: int) -> Top:
        """The best ``k`` of the part for each query, its own id left out; ``floor`` holds known lower bounds of kth scores.

        Each query first meets the data leaf next to it. Then pairs of nodes of both trees are taken best bound first. A pair is let go
        if its bound lies below the worst kth score of its group of queries; else the wider node is replaced by its
        children. Of a pair of leaves the queries are scored that the leaf's bound doesn't rule out one by one.
        """
        width = max(raw.shape[1], self.raw.shape[1])
        q_raw, p_raw = _widened(raw, width), _widened(self.raw, width)
        with np.errstate(over="ignore"):
            q, p = np.floor(self.scale * q_raw), _widened(self.points, width)
        queries, data = CoverTree.of(q, QUERY_LEAF), self.tree if width == self.points.shape[1] else CoverTree.of(p)
        size = queries.most * data.most
        top = Top(len(ids), k, floor, not size < INT_EXACT)

        norm = np.sqrt(np.einsum("ij,ij->i", q, q))
        home = np.zeros(len(ids), np.int64)

        def score(rows: np.ndarray, b: CoverTree) -> None:
            for part in range(0, len(b.rows), 2_048):
                some = b.rows[part : part + 2_048]
                for block in range(0, len(rows), 512):
                    mine = rows[block : block + 512]
                    top.add(mine, _products(q[mine], p[some], size, q_raw[mine], p_raw[some], self.scale), self.ids[some], ids[mine][:, None] == self.ids[some][None, :])

        def seed(rows: np.ndarray, node: CoverTree) -> None:
            """Each query meets the leaf that it reaches by the best product with a child's point."""
            if node.kids:
                best = np.argmax(q[rows] @ node.below[0].T, axis=1)
                for n in np.unique(best):
                    seed(rows[best == n], node.kids[n])
            else:
                home[rows] = id(node)
                score(rows, node)

        def bounds(node: CoverTree, other: CoverTree) -> np.ndarray:
            """Bounds of the children of ``node`` with ``other``."""
            centers, norms, radius, most = node.below
            return pair_bound(centers @ other.center, norms, radius, most, other.norm, other.radius, other.most)

        with np.errstate(invalid="ignore"):
            seed(np.arange(len(ids)), data)
        stack = [(math.inf, queries, data)]
        while stack:
            most, a, b = stack.pop()
            if most < float(top.worst[a.rows].min()):
                continue
            if b.kids and (b.radius >= a.radius or not a.kids):
                made = bounds(b, a)
                stack += [(float(made[n]), a, b.kids[n]) for n in np.argsort(made, kind="stable")]
            elif a.kids:
                made = bounds(a, b)
                stack += [(float(made[n]), a.kids[n], b) for n in np.argsort(made, kind="stable")]
            else:
                single = pair_bound(q[a.rows] @ b.center, norm[a.rows], 0.0, norm[a.rows], b.norm, b.radius, b.most)
                score(a.rows[(home[a.rows] != id(b)) & ~(single < top.worst[a.rows])], b)
        return top


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of doubles as a matrix, short ones filled with zeros."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width))
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[row, : b - a] = values[a:b]
    return out


def _scaled(raw: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore", invalid="ignore"):
        points = np.floor(scale * raw)
        return points, np.sqrt(np.einsum("ij,ij->i", points, points))


def _route(batches: Iterator[pa.RecordBatch], centers: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    """Each vector with its nearest cell, its distance from the cell's point, and its norm."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = _matrix(batch.column(1))
        points, norm = _scaled(raw, scale)
        width = max(points.shape[1], centers.shape[1])
        points, known = _widened(points, width), _widened(centers, width)
        cell, away = np.full(len(points), len(centers), np.int32), np.zeros(len(points))
        for at in np.array_split(np.flatnonzero(norm < WIDE), len(points) // 1_000 + 1) if len(centers) else ():
            square = norm[at][:, None] ** 2 + (known**2).sum(axis=1)[None, :] - 2 * points[at] @ known.T
            cell[at] = np.argmin(square, axis=1)
            away[at] = np.sqrt(((points[at] - known[cell[at]]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(away), pa.array(norm)], names=["vec_id", "vec", "cell", "away", "norm"])


class Cells:
    """What the driver knows of the cells: their points, and radius, longest vector and number of vectors of each."""

    def __init__(self, centers: np.ndarray, stats: list) -> None:
        self.centers, n = centers, len(centers) + 1
        self.rows, self.radius, self.most = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for r in stats:
            self.rows[r.cell], self.radius[r.cell], self.most[r.cell] = r.n, r.away * (1 + 1e-9), r.norm
        self.norm = np.sqrt((centers**2).sum(axis=1))

    def bounds(self, points: np.ndarray, norm: np.ndarray, radius: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bounds of groups of queries around ``points`` with each cell; the cell of wide vectors is never ruled out."""
        width = max(points.shape[1], self.centers.shape[1])
        dot = _widened(points, width) @ _widened(self.centers, width).T
        made = pair_bound(dot, norm[:, None], radius[:, None], most[:, None], self.norm[None, :], self.radius[None, :-1], self.most[None, :-1])
        return np.concatenate([made, np.full((len(points), 1), np.inf)], 1)


def _send(batches: Iterator[pa.RecordBatch], cells: Cells, groups: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    """Each query for each other cell that its group and its own kth score don't rule out."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1_000):
            some = batch.slice(start, 1_000)
            points, norm = _scaled(_matrix(some.column(1)), scale)
            home, floor = some.column(2).to_numpy(), some.column(3).to_numpy(zero_copy_only=False)
            alive = groups[home] & (cells.rows > 0)[None, :]
            alive[np.arange(len(home)), home] = False
            with np.errstate(all="ignore"):
                alive &= ~(cells.bounds(points, norm, np.zeros(len(norm)), norm) < floor[:, None])
            row, cell = np.nonzero(alive)
            for at in range(0, len(row), 5_000):
                take = pa.array(row[at : at + 5_000])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 5_000], pa.int32()), some.column(0).take(take), some.column(1).take(take), some.column(3).take(take)], names=["cell", "vec_id", "vec", "floor"])


def _search(batches: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, data before queries: one tree for each part, queries in blocks as they arrive.

    A row without vec_id holds the number of vectors scored for its query.
    """
    now, held, part = None, [], None
    for batch in batches:
        key = np.stack([batch.column(n).to_numpy() for n in range(3)], 1)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = batch.slice(a, b - a)
            if now != (key[a, 0], key[a, 1]):
                now, held, part = (key[a, 0], key[a, 1]), [], None
            if key[a, 2] == 0:
                held.append((some.column(3).to_numpy(), _matrix(some.column(4))))
                continue
            if not held and part is None:
                continue
            if part is None:
                width = max(m.shape[1] for _, m in held)
                part = Part(np.concatenate([i for i, _ in held]), np.concatenate([_widened(m, width) for _, m in held]), scale)
                held = []
            for start in range(0, some.num_rows, QUERY_BLOCK):
                block = some.slice(start, QUERY_BLOCK)
                ids, raw, floor = block.column(3).to_numpy(), _matrix(block.column(4)), block.column(5).to_numpy(zero_copy_only=False)
                wide = _scaled(raw, scale)[1] >= WIDE
                for mine in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                    if len(mine):
                        yield _found(ids[mine], part.search(ids[mine], raw[mine], floor[mine], k))


def _found(ids: np.ndarray, top: Top) -> pa.RecordBatch:
    row, rank = np.nonzero(top.ids != MOST)
    score = top.score[row, rank].tolist()
    query, near = [*ids[row].tolist(), *ids.tolist()], [*top.ids[row, rank].tolist(), *[None] * len(ids)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (query, near, [*score, *top.scored.tolist()])], names=["query_id", "vec_id", "score"])


def _cells(seeds: list, want: int, scale: int) -> np.ndarray:
    """Points of about ``want`` nodes of the sample's cover tree, the largest replaced by their children first."""
    raw = _matrix(pa.array([r.vec for r in seeds], pa.list_(pa.float64())))
    points, norm = _scaled(raw, scale)
    points = points[norm < WIDE]
    if not len(points):
        return np.zeros((0, raw.shape[1]))
    done, open_ = [], [CoverTree.of(points)]
    while open_ and len(done) + len(open_) < want:
        open_.sort(key=lambda n: len(n.rows))
        node = open_.pop()
        if node.kids:
            open_ += node.kids
        else:
            done.append(node)
    return np.array([n.center for n in (*done, *open_)])


def scored_pairs(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """For each query_id the number of vectors that were scored for it; the rest were let go with their nodes."""
    return _work(vectors, k, every, scale).where("vec_id is null").groupBy("query_id").agg(F.sum("score").alias("scored"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """Each query's ``k`` best other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller
    vec_id. Queries are the rows whose vec_id is divisible by ``every``; all rows are candidates. Null vectors, null
    ids, and vectors with null or non-finite components take no part. Components of any size are scored in exact whole
    numbers; a score beyond the range of a long counts as its limit. Vectors of unequal length are compared over the
    shorter one's length. Rows that repeat a vec_id are never each other's candidates; a query_id's list is the best of all its
    rows' pairs, with a pair for each repeated row. Extra columns are ignored; an empty table gives no rows.

    The cover tree of a bounded sample gives cells, and every vector goes to the nearest cell. A query first searches its own
    cell, which gives a lower bound of its kth score; it is sent on only to the cells that this bound doesn't rule
    out, first by the cell of queries it belongs to, then by itself. Vectors are shuffled once for each of the two steps,
    however many queries there are. A cell is split into parts of at most ``PART_ROWS``; a task builds a part's tree once and
    takes queries in blocks, so no task's memory grows with the input.
    """
    found = _work(vectors, k, every, scale).where("vec_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _work(vectors: DataFrame, k: int, every: int, scale: int) -> DataFrame:
    """All parts' best rows (query_id, vec_id, score), and the numbers of scored vectors in rows without vec_id."""
    spark = vectors.sparkSession
    fine: Column = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    rows = only(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(CELL_SAMPLE).collect()
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not about.n:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    most = max(1, min(PART_ROWS, PART_BYTES // (8 * max(1, about.width))))
    centers = _cells(seeds, -(-about.n // most), scale)
    data = checkpoint(rows.mapInArrow(lambda it: _route(it, centers, scale), "vec_id long, vec array<double>, cell int, away double, norm double"))
    ask = F.col("vec_id") % every == 0
    stats = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("norm").alias("norm")).collect()
    cells = Cells(centers, stats)
    parts = spark.createDataFrame([(int(c), max(1, -(-int(n) // most))) for c, n in enumerate(cells.rows)], "cell int, parts int")
    tasks = max(1, -(-about.n // most))
    dealt = data.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "vec", F.lit(None).cast("double").alias("floor"))

    def searched(asked: DataFrame) -> DataFrame:
        copies = asked.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "vec_id", "vec", "floor")
        both = dealt.union(copies).repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "kind")
        return both.mapInArrow(lambda it: _search(it, k, scale), "query_id long, vec_id long, score long")

    queries = data.where(ask)
    at_home = searched(queries.select("cell", "vec_id", "vec", F.lit(-math.inf).alias("floor")))
    if (cells.rows > 0).sum() == 1:
        return at_home
    at_home = checkpoint(at_home)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = at_home.where("vec_id is not null").withColumn("r", F.row_number().over(last)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    queries = checkpoint(queries.join(floors, "vec_id", "left").select("vec_id", "vec", "cell", F.coalesce("floor", F.lit(-math.inf)).alias("floor"), "away", "norm"))
    asked_by = queries.groupBy("cell").agg(F.max("away").alias("away"), F.max("norm").alias("norm"), F.min("floor").alias("floor")).collect()
    groups = np.ones((len(centers) + 1, len(centers) + 1), bool)
    for r in asked_by:
        if r.cell < len(centers):
            at = slice(r.cell, r.cell + 1)
            groups[r.cell] = ~(cells.bounds(centers[at], cells.norm[at], np.array([r.away * (1 + 1e-9)]), np.array([r.norm]))[0] < r.floor)
    sent = queries.select("vec_id", "vec", "cell", "floor").mapInArrow(lambda it: _send(it, cells, groups, scale), "cell int, vec_id long, vec array<double>, floor double")
    return at_home.unionByName(searched(sent))
