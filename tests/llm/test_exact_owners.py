import hashlib

import pyarrow as pa
import pytest
import xxhash

from foliospark.llm import exact_dedup


def test_subtrees_are_cut_whole():
    trie = exact_dedup.PatriciaTrie()
    keys = [b"abc", b"abd", b"a", b"xyz", b"xy", b"", b"abc"]
    for n, key in enumerate(keys):
        trie.insert(key, n)
    assert sum(trie.sizes.values()) == trie.bytes
    assert {k: (o, n) for k, o, n in trie.cut(ord("a"))} == {b"abc": (6, 2), b"abd": (1, 1), b"a": (2, 1)}
    assert {k for k, *_ in trie.terminals()} == {b"xyz", b"xy", b""} and sum(trie.sizes.values()) == trie.bytes


@pytest.mark.parametrize("room", [50, 10_000_000])
def test_owners_of_sorted_parts(monkeypatch, room):
    """Parts of many strings of one length, and of one hash, with and without spills."""
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", room)
    texts = [b"%05d" % (n % 97) * (1 + n % 3) for n in range(600)]
    parts = sorted((len(t), xxhash.xxh64_intdigest(t) - (1 << 63), t, n, 2) for n, t in enumerate(texts))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts[a : a + 70], strict=True), exact_dedup._PART.types, strict=True)], schema=exact_dedup._PART) for a in range(0, 600, 70)]
    got = [r for b in exact_dedup._owners(iter(batches), True) for r in b.to_pylist()]
    want = {hashlib.sha256(t).digest(): (max(n for n in range(600) if texts[n] == t), 2 * texts.count(t)) for t in set(texts)}
    assert {r["sha"]: (r["keep_id"], r["group_size"]) for r in got} == want and len(got) == len(want)
