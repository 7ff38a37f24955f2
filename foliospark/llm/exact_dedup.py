"""Exact deduplication with Patricia tries that own each distinct text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import only

#: Bytes of text that one task's trie may hold before it spills its largest subtrees.
TRIE_BYTES = 48 << 20
#: A trie of the owners covers one of 4,096 ranges of the hashes of one length.
RANGE_SHIFT = 52


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z alone lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class _Node:
    __slots__ = ("label", "kids", "count", "owner")

    def __init__(self, label: bytes) -> None:
        self.label, self.kids, self.count, self.owner = label, {}, 0, None


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over whole byte strings; terminals keep an owner id and a count."""

    def __init__(self, largest: bool = True) -> None:
        self.root, self.bytes, self.largest = _Node(b""), 0, largest
        self.sizes: dict[int, int] = {}

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> int:
        """Add ``count`` copies of ``key``; of all owners the best one stays, and any id beats null. Returns the bytes it took."""
        node, at, before = self.root, 0, self.bytes
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = _Node(key[at:])
                self.bytes += len(kid.label)
            elif not key.startswith(kid.label, at):
                n = _shared(kid.label, key[at : at + len(kid.label)])
                upper = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                upper.kids[kid.label[0]] = kid
                node.kids[key[at]] = kid = upper
            node, at = kid, at + len(kid.label)
        node.count += count
        if owner is not None and (node.owner is None or (owner > node.owner) == self.largest):
            node.owner = owner
        grown = self.bytes - before
        if grown:
            self.sizes[key[0]] = self.sizes.get(key[0], 0) + grown
        return grown

    def cut(self, first: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Take the subtree of strings that begin with a byte out of the trie; gives its strings."""
        kid = self.root.kids.pop(first)
        self.bytes -= self.sizes.pop(first)
        return self.terminals([(kid, kid.label)])

    def terminals(self, stack: list[tuple[_Node, bytes]] | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """Every stored string with its owner and count, of the whole trie or below the given nodes."""
        stack = [(self.root, b"")] if stack is None else stack
        while stack:
            node, head = stack.pop()
            if node.count:
                yield head, node.owner, node.count
            stack.extend((kid, head + kid.label) for kid in node.kids.values())


def _local(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Collapse one task's copies: a trie for each length, whose largest subtrees are spilled above ``TRIE_BYTES``."""
    tries: dict[int, PatriciaTrie] = {}
    held = 0

    def rows(terminals: Iterator[tuple[bytes, int | None, int]]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        size = 0
        for key, owner, count in terminals:
            for column, value in zip(out, (len(key), xxhash.xxh64_intdigest(key) - (1 << 63), key, owner, count), strict=True):
                column.append(value)
            size += len(key)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PART.types, strict=True)], schema=_PART)
                out, size = [[], [], [], [], []], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PART.types, strict=True)], schema=_PART)

    def spilled() -> Iterator[tuple[bytes, int | None, int]]:
        """Terminals of the largest subtrees of all tries, until half the room is free."""
        nonlocal held
        for size, n, first in sorted(((size, n, first) for n, trie in tries.items() for first, size in trie.sizes.items()), reverse=True):
            if held <= TRIE_BYTES // 2:
                break
            yield from tries[n].cut(first)
            held -= size

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            key = normalise(text.as_py())
            trie = tries.get(len(key))
            if trie is None:
                trie = tries[len(key)] = PatriciaTrie(largest)
            held += trie.insert(key, i)
            if held > TRIE_BYTES:
                yield from rows(spilled())
                tries = {n: t for n, t in tries.items() if t.sizes or t.root.count}
    for trie in tries.values():
        yield from rows(trie.terminals())


def _owners(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length and hash: one trie for each length and range of hashes.

    A trie is let go when its range is over. If it would outgrow ``TRIE_BYTES`` before, its subtrees are spilled as soon as
    a new hash begins, for then all its strings are complete.
    """
    trie, now, last = PatriciaTrie(largest), None, None
    out: list[list] = [[], [], []]

    def put(terminals: Iterator[tuple[bytes, int | None, int]]) -> None:
        for text, owner, count in terminals:
            out[0].append(hashlib.sha256(text).digest())
            out[1].append(owner)
            out[2].append(count)

    for batch in batches:
        for n, h, key, owner, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (n, h >> RANGE_SHIFT) != now:
                put(trie.terminals())
                trie, now = PatriciaTrie(largest), (n, h >> RANGE_SHIFT)
            if trie.bytes + n > TRIE_BYTES and h != last:
                for first in list(trie.sizes):
                    put(trie.cut(first))
            trie.insert(key, owner, count)
            last = h
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _OWNER.types, strict=True)], schema=_OWNER)
            out = [[], [], []]
    put(trie.terminals())
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _OWNER.types, strict=True)], schema=_OWNER)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(normalise(t.as_py())).digest() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary())], names=["doc_id", "sha"])


_PART = pa.schema([("n", pa.int64()), ("h", pa.int64()), ("key", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
_OWNER = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def text_owners(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row for each distinct text: ``sha`` (of the normalised bytes), ``keep_id``, ``group_size``.

    Each input task first collapses its own copies in tries, so of a group with a third of all rows only
    one string for each task is shuffled. Those go to partitions of (length, range of content hashes), where the full
    byte strings meet in one trie: equality is decided by bytes, never by the hash. Rows arrive sorted by length and
    hash, so a finished range is let go, and a large one spills its subtrees; the sort spills to disk by itself.
    """
    largest = keep == "largest"
    parts = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(lambda it: _local(it, largest), "n long, h long, key binary, owner long, copies long")
    dealt = parts.repartition("n", F.shiftright("h", RANGE_SHIFT)).sortWithinPartitions("n", "h")
    return dealt.mapInArrow(lambda it: _owners(it, largest), "sha binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z; one row per document.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty text. Of equal texts the
    row with the largest (or ``keep="smallest"``) doc_id stays; rows that repeat one doc_id share its fate;
    a null doc_id loses to any id. Extra columns are ignored; an empty table gives no rows.
    """
    members = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_digests, "doc_id long, sha binary")
    return members.join(text_owners(docs, keep), "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
