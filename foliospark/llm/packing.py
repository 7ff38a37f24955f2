"""Best-fit packing of token sequences with certified bin counts."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import checkpoint, only, remember

#: Distinct words whose ids one worker remembers.
CACHE_WORDS = 500_000
#: Two spaces of any kind side by side; a single space between two other characters.
DOUBLE, SINGLE = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
#: Items one packing task takes.
TASK_ITEMS = 20_000
#: Bins filled at least this far in a round are final; the items of the others are exchanged.
#: A task that met its lower bound gives back no more than its emptiest ``GIVE_BACK`` of bins.
GIVE_BACK = 0.02
FULL = 0.998


#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies. Code points from ``FOREIGN`` on go through the tokenizer itself,
#: so that no engine's newer Unicode tables matter.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
FOREIGN = "\u0250"


def byte_pair_core(path: str) -> Callable[[str], bytes] | None:
    """A compiled encoder to little-endian ids for a byte-level BPE file whose merges make ids in order; else None."""
    spec = json.loads(Path(path).read_text())
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type"), before.get("type"), before.get("use_regex", True), before.get("add_prefix_space")) != ("BPE", "ByteLevel", True, False) or spec.get("normalizer") or model.get("dropout"):
        return None
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab, added = model["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = {bytes(map(byte_of.__getitem__, token)): n for token, n in vocab.items() if token not in added}
    if any(vocab.get(a + b) != 256 + n for n, (a, b) in enumerate(merges)) or any(n >= 256 for token, n in ranks.items() if len(token) == 1):
        return None
    encode, none = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer, frozenset()
    return lambda text: bytes(encode(text, none))


class WordCache:
    """Token ids of a text through a byte-level BPE, word by word, remembering words.

    The pre-tokenizer never joins what stands before and after a single space between two non-space
    characters, so a text may be cut at such spaces, and each word after one is encoded with its space.
    Words that aren't remembered go through a compiled encoder of the same vocabulary, words with code points from ``FOREIGN`` on and
    texts that hold an added token (``<|endoftext|>``) through the tokenizer itself.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.core = Tokenizer.from_file(path), byte_pair_core(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.most = words

    def encode(self, piece: str) -> bytes:
        """Ids of a piece that starts and ends at a border of the pre-tokenizer and holds no added token."""
        if self.core and (piece.isascii() or max(piece) < FOREIGN):
            return self.core(piece)
        return np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(token in text for token in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        odd = DOUBLE.search(text) or text[0].isspace() or text[-1].isspace()
        words = SINGLE.split(text) if odd else text.split(" ")
        made = [self.encode(words[0]), *map(self.words.get, words[1:])]
        at, missing = -1, made.count(None)
        for _ in range(missing):
            at = made.index(None, at + 1)
            word = words[at]
            made[at] = done = self.encode(" " + word)
            if len(self.words) < self.most and len(word) <= 40:
                self.words[word] = done
        return b"".join(made)


def word_cache(path: str) -> WordCache:
    """The tokenizer's cache of this worker process, kept from task to task."""
    return remember(("words", path), lambda: WordCache(path))


def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    cache = word_cache(path)
    tail = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            made = cache.ids(text.as_py() or "") + tail
            n = len(made) // 4
            pieces, start = -(-n // size), 0
            for piece in range(pieces):
                length = n - (pieces - 1) * size if piece == 0 else size
                rows.append((key, piece, start, length, zlib.crc32(made[4 * start : 4 * (start + length)])))
                start += length
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize whole texts, append ``end_id``, and cut what is longer than ``size``.

    The first piece takes the remainder, all others are full. Rows are (doc_id, piece, start, length,
    ids_crc32); the ids themselves stay in the task.
    """
    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        lambda it: _cut(it, tokenizer, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def dual_feasible_bound(lengths: np.ndarray, size: int) -> int:
    """A lower bound of the number of bins, by the dual-feasible functions of Martello and Toth.

    For each threshold ``t`` up to half the size, items above ``size - t`` count as whole bins, items from
    ``t`` on by their length, shorter ones as nothing; the largest sum over all thresholds is a bound.
    """
    count = np.bincount(lengths, minlength=size + 1)
    total = np.cumsum(count * np.arange(size + 1))
    number = np.cumsum(count)
    best = -(-int(total[-1]) // size)
    for t in range(1, size // 2 + 1):
        whole = number[size] - number[size - t]
        part = total[size - t] - total[t - 1]
        best = max(best, int(whole) + -(-int(part) // size))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin.

    Items are taken from long to short; a bit set over the free space finds the fullest bin that holds one.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(size + 1)]
    present = 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = present >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                present &= ~(1 << space)
        else:
            b, space = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        space -= n
        if space:
            by_space[space].append(b)
            present |= 1 << space
    return bins, offsets, np.array(fill, np.int64)


def _pack(batches: Iterator[pa.RecordBatch], size: int, last: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    lengths = table.column("length").to_numpy()
    bins, offsets, fill = best_fit_decreasing(lengths, size)
    certified = len(fill) == dual_feasible_bound(lengths, size)
    final = np.ones(len(fill), bool) if last else fill >= FULL * size
    if certified and not last:
        final[np.argsort(fill, kind="stable")[max(1, int(GIVE_BACK * len(fill))) :]] = True
    base = TaskContext.get().partitionId() << 32
    out = table.append_column("bin", pa.array(base + bins)).append_column("offset", pa.array(offsets))
    out = out.append_column("final", pa.array(final[bins])).append_column("certified", pa.array(np.full(len(bins), certified)))
    yield from out.to_batches(max_chunksize=50_000)


def pack(pieces: DataFrame, size: int = 2048, max_rounds: int = 12) -> DataFrame:
    """Pack pieces of at most ``size`` tokens into sequences; adds sequence_id, offset and certified.

    Full pieces are sequences of their own. The others are dealt by hash to tasks of about ``TASK_ITEMS``
    items. Each task runs best-fit decreasing and compares its bin count with a dual-feasible lower bound.
    Bins that have gaps give their pieces back (of a task that met its bound only the emptiest); those are
    exchanged and packed again in fewer tasks, until one task of at most ``TASK_ITEMS`` items holds what is
    left, or a round gives back over nine tenths, or ``max_rounds`` are over; then all bins are final.
    Only the short rows of pieces are shuffled, never texts or ids. ``certified`` says that the task of the
    last round met its lower bound.
    """
    full = pieces.where(F.col("length") >= size).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    pool = pieces.where(F.col("length") < size)
    left = pool.count()
    kept = [full]
    columns = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", bin long, offset long, final boolean, certified boolean"
    before = 2 * left
    for turn in range(max_rounds):
        if not left:
            break
        tasks = -(-left // TASK_ITEMS)
        last = tasks == 1 or turn == max_rounds - 1 or left > 0.9 * before
        dealt = pool.repartition(tasks, F.xxhash64(*columns, F.lit(turn)))
        packed = checkpoint(dealt.mapInArrow(lambda it, last=last: _pack(it, size, last), schema))
        kept.append(packed.where("final").select(*columns, (F.lit((turn + 1) << 58) + F.col("bin")).alias("sequence_id"), "offset", "certified"))
        if last:
            break
        pool = packed.where(~F.col("final")).select(*columns)
        before, left = left, pool.count()
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize and pack whole documents into as few sequences of ``size`` tokens as found.

    Null and empty texts are documents of the end id alone. Rows that repeat a doc_id are packed each. Extra
    columns are ignored; an empty table gives no rows. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, certified.
    """
    return pack(checkpoint(token_pieces(docs, tokenizer, size, end_id)), size)
