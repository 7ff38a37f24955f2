"""Exact n-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import checkpoint, only, shuffle_partitions, sized
from foliospark.llm.components import connected_components

#: Documents, and tokens on average, that one exact search takes; larger candidate groups are searched as pairs of blocks.
BLOCK, BLOCK_TOKENS = 400, 1_500_000
#: Tokens of one shuffled bucket, and those that a task holds before it sends them on.
BUCKET_TOKENS, FLUSH_TOKENS = 1_000_000, 1_500_000
#: Bytes of text hashed at once.
CHUNK = 2 << 20
#: Of a prefix, the share of tokens beyond the one that must meet which a document must have in common with others.
EXTRA = 0.15
#: A token is hot if this share of all sets, and so many sets of a task, hold it; there are at most 1 / HOT_SHARE times as many as a set has tokens.
HOT_SHARE, HOT_LEAST = 0.005, 50

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _tables or len(_tables[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _tables[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(max(n, 1 << 16) - 1, b, _U)]), dtype=_U) for b in (_BASE, inverse)]
    return _tables[0][:n], _tables[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z folded."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.diff(np.concatenate([[0], (~_SPACE[raw]).astype(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[_U(0)], np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * power[: len(raw)], dtype=_U)])
            found.append(_mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(_U) * _U(0xD6E8FEB86659FD93)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, _U)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.

    A text of fewer words than a shingle gives its whole word sequence as one; no words give no shingle.
    """
    h = _word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        x = h[:n] + _U(k)
        for j in range(1, k):
            x = _mix(x * _U(0xA24BAED4963EE407) + h[j : j + n])
    return np.unique(x)


def _set_id(x: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    with np.errstate(over="ignore"):
        y = _mix(np.array([np.sum(_mix(x + _U(0x632BE59BD9B4E019)), dtype=_U) ^ _U(len(x))], _U))
    return int(y.view(np.int64)[0])


def least_overlap(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Shingles that a set of ``n`` must share at least with any set it links with."""
    return (n * num + den - 1) // den


def prefix_lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """Length of the extended prefix, and how many of its tokens must meet those of others."""
    short = n - least_overlap(n, num, den)
    need = max(1, min(int(EXTRA * n), n - short))
    return short + need, need


def _profiles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Size and id of each text's set; rows of a negative size name a token that so many different sets of the task hold."""
    seen: set[int] = set()
    sets: list[np.ndarray] = []
    held = 0

    def heavy() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, _U), np.zeros(0, np.int64))
        often = counts >= max(HOT_LEAST, HOT_SHARE * len(sets))
        return _profile_rows(pa.nulls(int(often.sum()), pa.int64()), (-counts[often]).tolist(), tokens[often].view(np.int64).tolist())

    for batch in batches:
        sizes, ids = [], []
        for text in batch.column(1):
            x = shingle_set(text.as_py(), words)
            sizes.append(len(x))
            ids.append(_set_id(x) if len(x) else None)
            if len(x) and ids[-1] not in seen:
                seen.add(ids[-1])
                sets.append(x)
                held += len(x)
                if held > FLUSH_TOKENS:
                    yield heavy()
                    seen, sets, held = set(), [], 0
        yield _profile_rows(batch.column(0), sizes, ids)
    yield heavy()


def _profile_rows(doc_id: pa.Array, sizes: list[int], ids: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "n", "cls"])


def hot_tokens(profiles: DataFrame) -> np.ndarray:
    """Tokens (sorted) that a share of all sets hold, with the sets counted, as two columns.

    A token that a task's heavy hitters name is held by two sets or more. The numbers need not be exact: they only put hot tokens
    behind all others in the order of rarity, in the same way for all sets.
    """
    total = profiles.where("n > 0").agg(F.approx_count_distinct("cls")).first()[0]
    found = profiles.where("n < 0").groupBy("cls").agg(F.sum(-F.col("n")).alias("sets")).where(F.col("sets") >= HOT_SHARE * total)
    rows = sorted((int(np.int64(r.cls).view(np.uint64)), r.sets) for r in found.collect())
    return np.array(rows, np.uint64).reshape(-1, 2)


_BUCKETS = pa.schema([("bucket", pa.int32()), ("cls", pa.binary()), ("size", pa.binary()), ("run", pa.binary()), ("tok", pa.binary()), ("df", pa.binary())])
_BUCKET_SQL = "bucket int, cls binary, size binary, run binary, tok binary, df binary"


def _packed(bucket: np.ndarray, cls: np.ndarray, size: np.ndarray, tok: np.ndarray, df: np.ndarray | None = None) -> pa.Table:
    """Tokens as packed arrays, a row for each bucket: classes, their sizes and numbers of tokens, then the tokens."""
    order = np.argsort(bucket, kind="stable")
    bucket, cls, size, tok = bucket[order], cls[order], size[order], tok[order]
    df = np.zeros(0, np.int32) if df is None else df[order]
    borders = np.flatnonzero(np.diff(bucket)) + 1
    out: list[list] = [[] for _ in _BUCKETS]
    for start, stop in zip(np.r_[0, borders], np.r_[borders, len(tok)], strict=True) if len(tok) else ():
        mine = cls[start:stop]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        run = np.diff(np.r_[first, len(mine)]).astype(np.int32)
        values = (int(bucket[start]), mine[first].tobytes(), size[start:stop][first].tobytes(), run.tobytes(), tok[start:stop].tobytes(), df[start:stop].tobytes())
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _BUCKETS, strict=True)], schema=_BUCKETS)


def _is_hot(tok: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Place of each token among the hot ones, or -1."""
    if not len(hot):
        return np.full(len(tok), -1)
    at = np.minimum(np.searchsorted(hot[:, 0], tok), len(hot) - 1)
    return np.where(hot[at, 0] == tok, at, -1)


def _by_token(cls: list[int], sets: list[np.ndarray], sizes: list[int], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Tokens by token bucket. Hot ones need not meet: they go by class, to buckets of negative number, with their count."""
    tok, counts = np.concatenate(sets), np.array([len(s) for s in sets])
    cls_of, size_of = np.repeat(np.array(cls, np.int64), counts), np.repeat(np.array(sizes, np.int64), counts)
    at = _is_hot(tok, hot)
    cold, warm = at < 0, at >= 0
    yield from _packed((tok[cold] % _U(buckets)).astype(np.int64), cls_of[cold], size_of[cold], tok[cold]).to_batches()
    if warm.any():
        number = np.minimum(hot[at[warm], 1], _U(2**31 - 1)).astype(np.int32)
        yield from _packed(-1 - (cls_of[warm].view(_U) % _U(buckets)).astype(np.int64), cls_of[warm], size_of[warm], tok[warm], number).to_batches()


def _sent(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, buckets: int, whole: bool, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole sets or their extended prefixes by token bucket, once for each distinct set of the task."""
    seen: set[int] = set()
    cls, sets, sizes, held = [], [], [], 0
    for batch in batches:
        for text in batch.column(1):
            x = shingle_set(text.as_py(), words)
            if not len(x):
                continue
            c = _set_id(x)
            if c in seen:
                continue
            if len(seen) < 500_000:
                seen.add(c)
            take = len(x) if whole else prefix_lengths(len(x), num, den)[0]
            cls.append(c)
            sizes.append(len(x))
            sets.append(x[:take])
            held += take
            if held > FLUSH_TOKENS:
                yield from _by_token(cls, sets, sizes, buckets, hot)
                cls, sets, sizes, held = [], [], [], 0
    if cls:
        yield from _by_token(cls, sets, sizes, buckets, hot)


def _flat(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, class, size, number of classes with the token) of one bucket, sorted by token and class.

    Each pair comes once, and tokens of a single class are left out.
    """
    run = _flat(table, "run", np.int32)
    tok, cls, size = _flat(table, "tok", _U), np.repeat(_flat(table, "cls", np.int64), run), np.repeat(_flat(table, "size", np.int64), run)
    order = np.lexsort((cls, tok))
    tok, cls, size = tok[order], cls[order], size[order]
    if len(tok):
        fresh = np.r_[True, (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])]
        tok, cls, size = tok[fresh], cls[fresh], size[fresh]
    first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
    many = np.diff(np.r_[first, len(tok)])
    df = np.repeat(many, many).astype(np.int32)
    shared = df > 1
    return tok[shared], cls[shared], size[shared], df[shared]


def _hot_bucket(table: pa.Table) -> bool:
    return table.column("bucket")[0].as_py() < 0


def _classes_of(table: pa.Table) -> np.ndarray:
    """The class of each token of packed rows, every token of a class once."""
    cls, tok = np.repeat(_flat(table, "cls", np.int64), _flat(table, "run", np.int32)), _flat(table, "tok", _U)
    order = np.lexsort((tok, cls))
    cls, tok = cls[order], tok[order]
    return cls[np.r_[True, (cls[1:] != cls[:-1]) | (tok[1:] != tok[:-1])]] if len(cls) else cls


def _shared_counts(table: pa.Table) -> pa.Table:
    """How many tokens of each class others have too, by this bucket."""
    ids, counts = np.unique(_classes_of(table) if _hot_bucket(table) else _gather(table)[1], return_counts=True)
    return pa.table({"cls": pa.array(ids, pa.int64()), "met": pa.array(counts, pa.int64())})


def _weighed(table: pa.Table, buckets: int) -> pa.Table:
    """The shared tokens of one token bucket with their numbers of classes, by class bucket."""
    if _hot_bucket(table):
        return table.set_column(0, "bucket", pa.array(-1 - table.column("bucket").to_numpy(), pa.int32()))
    tok, cls, size, df = _gather(table)
    order = np.lexsort((tok, cls))
    tok, cls, size, df = tok[order], cls[order], size[order], df[order]
    return _packed((cls.view(_U) % _U(buckets)).astype(np.int64), cls, size, tok, df)


def _rare_prefixes(table: pa.Table, num: int, den: int, buckets: int) -> pa.Table:
    """Prefixes in order of rarity of the sets that share enough tokens with others at all, by token bucket.

    Tokens that no other set has come first in that order, so of the n - T + 1 tokens of a prefix only what
    those leave over is taken from the shared ones, rarest first.
    """
    run = _flat(table, "run", np.int32)
    tok, df = _flat(table, "tok", _U), _flat(table, "df", np.int32)
    cls, size = np.repeat(_flat(table, "cls", np.int64), run), np.repeat(_flat(table, "size", np.int64), run)
    order = np.lexsort((tok, df, cls))
    tok, cls, size = tok[order], cls[order], size[order]
    if len(cls):
        fresh = np.r_[True, (cls[1:] != cls[:-1]) | (tok[1:] != tok[:-1])]
        tok, cls, size = tok[fresh], cls[fresh], size[fresh]
    first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, np.int64)
    shared = np.diff(np.r_[first, len(cls)])
    place = np.arange(len(cls)) - np.repeat(first, shared)
    keep = place < np.repeat(shared, shared) - least_overlap(size, num, den) + 1
    tok, cls, size = tok[keep], cls[keep], size[keep]
    return _packed((tok % _U(buckets)).astype(np.int64), cls, size, tok)


class _Forest:
    """Union-find that keeps the smallest id as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def edges(self) -> pa.Table:
        pairs = [(x, self.root(x)) for x in self.up if self.root(x) != x]
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _candidates(table: pa.Table, num: int, den: int) -> pa.Table:
    """Spanning edges of the classes that share a prefix token and have fitting sizes.

    Sorted by size, any two of a list that fit each other have only fitting neighbours between them, so
    linking neighbours keeps their connection without a pair for each two.
    """
    tok, cls, size, _ = _gather(table)
    order = np.lexsort((size, tok))
    tok, cls, size = tok[order], cls[order], size[order]
    near = np.flatnonzero((tok[1:] == tok[:-1]) & (size[:-1] * den >= size[1:] * num))
    pairs = np.unique(np.stack([np.minimum(cls[near], cls[near + 1]), np.maximum(cls[near], cls[near + 1])], 1), axis=0)
    forest = _Forest()
    for a, b in pairs.tolist():
        forest.link(a, b)
    return forest.edges()


def search_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> Iterator[tuple[int, list[int]]]:
    """For each query its partners in ``left`` with Jaccard of at least num/den, by index.

    Queries are the sets of ``right``, or of ``left`` itself, where a partner's index is the smaller.

    T-occurrence search: the sets of ``left`` are an inverted index. A query must meet a set in at least T lists.
    DivideSkip sets the longest L lists aside; the short ones are merged by counting; only sets that
    reach T - L are then probed by binary search in the long lists.
    """
    lengths = np.array([len(s) for s in left])
    if not len(left) or not lengths.sum():
        return
    tok = np.concatenate(left)
    owner = np.repeat(np.arange(len(left), dtype=np.int32), lengths)
    order = np.argsort(tok, kind="stable")
    tok, owner = tok[order], owner[order]
    first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    keys, stop = tok[first], np.r_[first[1:], len(tok)]
    for q, query in enumerate(left if right is None else right):
        n = len(query)
        if not n:
            continue
        at = np.searchsorted(keys, query)
        at[at == len(keys)] = 0
        at = at[keys[at] == query]
        need = int(least_overlap(n, num, den))
        if len(at) < need:
            continue
        lo, hi = first[at], stop[at]
        df = hi - lo
        aside = min(need - 1, int(need / (math.log2(max(2, int(df.max()))) + 1)))
        rank = np.argsort(df, kind="stable")
        short, long = rank[: len(rank) - aside], rank[len(rank) - aside :]
        width = df[short]
        where = np.repeat(lo[short] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(int(width.sum()))
        count = np.bincount(owner[where], minlength=len(left))
        hit = np.flatnonzero(count >= need - aside)
        hit = hit[(lengths[hit] * den >= n * num) & (n * den >= lengths[hit] * num)]
        if right is None:
            hit = hit[hit < q]
        if not len(hit):
            continue
        total = count[hit]
        for k in long:
            members = owner[lo[k] : hi[k]]
            spot = np.searchsorted(members, hit)
            spot[spot == len(members)] = 0
            total = total + (members[spot] == hit)
        good = total * den >= (lengths[hit] + n - total) * num
        yield q, hit[good].tolist()


def _exact(table: pa.Table, words: int, num: int, den: int) -> pa.Table:
    """Spanning edges of the links inside a block, or between two blocks, of a candidate group."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block, cls = table.column("block").to_pylist(), table.column("cls").to_pylist()
    sets = [np.frombuffer(b, _U) for b in table.column("tokens").to_pylist()]
    mine = [r for r, b in enumerate(block) if b == i]
    other = mine if i == j else [r for r, b in enumerate(block) if b == j]
    forest = _Forest()
    for q, partners in search_links([sets[r] for r in mine], None if i == j else [sets[r] for r in other], num, den):
        for p in partners:
            forest.link(cls[mine[p]], cls[other[q]])
    return forest.edges()


def _tokens(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            sets = [shingle_set(t.as_py(), words) for t in some.column(1)]
            ids = [_set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "cls", "tokens"])


def set_classes(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n, cls): size of the shingle set and its id; cls is null for empty sets. Rows of negative n are heavy tokens."""
    return only(docs, "doc_id", "text").mapInArrow(lambda it: _profiles(it, words), "doc_id long, n long, cls long")


def class_links(docs: DataFrame, classes: DataFrame, words: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """Edges (u, v) that connect exactly what links between different shingle sets connect.

    ``classes`` has one row (cls, n, rep) for each distinct set. A set can only link with sets of which it shares
    T = num/den of its tokens, so most sets are ruled out by counting. First only the tokens with the smallest hashes of
    each set travel, packed by bucket: of two linked sets' extended prefixes at least the number that
    :func:`prefix_lengths` gives for the smaller one meet. Of the sets left whole sets travel, and those that share
    fewer than T tokens with all others together go. What is left is ordered by rarity, and sets that share a
    token of their n - T + 1 rarest are joined to candidate groups, by spanning edges only. ``hot`` tokens are known to be
    shared and are not gathered for counting and ranking; only where prefixes meet does each list share a bucket. Each group's sets then meet once for the exact search. A group of over ``BLOCK`` sets is
    searched block by block, then by one set of each piece that this leaves; only groups still in several pieces meet in
    pairs of blocks.
    """
    parts = shuffle_partitions(docs.sparkSession)

    def dealt(source: DataFrame, whole: bool, tokens: float) -> tuple[DataFrame, int]:
        buckets = max(parts, int(tokens / BUCKET_TOKENS))
        return source.mapInArrow(lambda it: _sent(it, words, num, den, buckets, whole, hot), _BUCKET_SQL), buckets

    narrow = only(docs, "doc_id", "text")
    total = classes.agg(F.sum("n")).first()[0] or 0
    sent, _ = dealt(narrow, False, 0.3 * total)
    met = sent.groupBy("bucket").applyInArrow(_shared_counts, "cls long, met long").groupBy("cls").agg(F.sum("met").alias("met"))
    smallest = F.floor((F.col("n") * num + den - 1) / den)
    need = F.greatest(F.lit(1), F.floor(smallest * EXTRA))
    alive = checkpoint(classes.join(met, "cls").where(F.col("met") >= need).select("cls", "n", F.col("rep").alias("doc_id")))
    living = _texts_of(narrow, alive)
    left = alive.agg(F.sum("n")).first()[0] or 0
    whole, buckets = dealt(living, True, left)
    weighed = whole.groupBy("bucket").applyInArrow(lambda t: _weighed(t, buckets), _BUCKET_SQL)
    rare = weighed.groupBy("bucket").applyInArrow(lambda t: _rare_prefixes(t, num, den, buckets), _BUCKET_SQL)
    candidates = rare.groupBy("bucket").applyInArrow(lambda t: _candidates(t, num, den), "u long, v long")
    groups = connected_components(candidates)
    groups = groups.join(alive, groups.node == alive.cls).select("cls", "n", "doc_id", "component")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("tokens_in"))
    placed = groups.join(sizes, "component").withColumn("blocks", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("tokens_in") / BLOCK_TOKENS)).cast("int"))
    placed = checkpoint(placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))

    def searched(sets: DataFrame) -> DataFrame:
        """Links among the sets (cls, n, doc_id, component, i, j, block) of each pair of blocks."""
        near = _texts_of(narrow, sets)
        made = near.mapInArrow(lambda it: _tokens(it, words), "doc_id long, cls long, tokens binary").withColumnsRenamed({"doc_id": "of_doc", "cls": "of_cls"})
        full = made.join(sized(sets), (F.col("of_cls") == F.col("cls")) & F.col("of_doc").eqNullSafe(F.col("doc_id")))
        return full.select("component", "cls", "block", "tokens", "i", "j").groupBy("component", "i", "j").applyInArrow(lambda t: _exact(t, words, num, den), "u long, v long")

    columns = ("cls", "n", "doc_id", "component", "block")
    inside = searched(placed.select(*columns, F.col("block").alias("i"), F.col("block").alias("j")))
    if placed.where("blocks > 1").isEmpty():
        return inside
    inside = checkpoint(inside)
    large = placed.where("blocks > 1")
    pieces = checkpoint(_with_pieces(large, inside))
    few = pieces.groupBy("component").agg(F.countDistinct("piece").alias("pieces")).where(F.col("pieces").between(2, BLOCK)).select("component")
    stand_in = pieces.where("piece = cls").join(few, "component", "left_semi")
    across = checkpoint(searched(stand_in.select(*columns[:4], F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))))
    linked = inside.union(across)
    pieces = checkpoint(_with_pieces(large, linked))
    apart = pieces.groupBy("component").agg(F.countDistinct("piece").alias("pieces")).where("pieces > 1").select("component")
    open_ = pieces.join(apart, "component", "left_semi")
    met_blocks = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j"))))
    pairs = open_.select(*columns, met_blocks.alias("at")).select(*columns, "at.i", "at.j").where("i <> j")
    return linked.union(searched(pairs))


def _with_pieces(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Members with ``piece``, the smallest class that links already join them to; links of other groups are left aside."""
    mine = links.join(placed.select(F.col("cls").alias("u")), "u", "left_semi")
    joined = connected_components(mine).select(F.col("node").alias("cls"), F.col("component").alias("joined"))
    return placed.join(joined, "cls", "left").withColumn("piece", F.coalesce("joined", "cls")).drop("joined")


def _texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stand for the classes; texts without doc_id come all, if they stand for any."""
    ids = sized(classes.select(F.col("doc_id").alias("of_doc")).distinct())
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left_semi")


def ngram_jaccard(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and class_id, which equal sets share (null for empty ones).

    Sets are distinct ``words``-word shingles of the whole text, A-Z folded. Two documents link when
    ``den * intersection >= num * union``; the component is the smallest doc_id reachable by links. A text with
    fewer words is one shingle; null, empty and blank texts have no shingle and link with nothing. Equal sets
    are one class before anything is joined, so copies are never paired. Rows with null doc_id link like all others
    and come back with the component of their set, null where no row of it has an id. Shingles are 64-bit hashes. Extra columns are ignored; an empty
    table gives no rows.
    """
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    profiles = checkpoint(set_classes(docs, words))
    hot, members = hot_tokens(profiles), profiles.where("n >= 0")
    classes = checkpoint(members.where(F.col("cls").isNotNull()).groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    joined = connected_components(class_links(docs, classes, words, num, den, hot))
    label = joined.join(classes, joined.node == classes.cls).select("node", "component", "rep")
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = classes.join(label.join(least, "component").select(F.col("node").alias("cls"), "component_id"), "cls", "left")
    of_class = of_class.select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    return _labelled(members, classes, of_class).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id"))


def _labelled(members: DataFrame, classes: DataFrame, of_class: DataFrame) -> DataFrame:
    """Members with their class's component; classes with many copies are dealt over several partitions.

    A class is hot above a fixed share of all rows, so there is a bounded number of them; only these are broadcast.
    """
    share = 4 * shuffle_partitions(members.sparkSession)
    most = max(100, -(-(members.count()) // share))
    hot = checkpoint(classes.where(F.col("copies") > most).select("cls", F.ceil(F.col("copies") / most).cast("int").alias("deals")))
    deal = F.when(F.col("deals").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("deals"))).cast("int")
    dealt = members.join(F.broadcast(hot), "cls", "left").withColumn("deal", deal)
    labels = of_class.join(F.broadcast(hot), "cls", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("deals") - 1, F.lit(0)))))
    return dealt.select("cls", "deal", "doc_id", "n").join(labels.select("cls", "deal", "component_id"), ["cls", "deal"], "left")
