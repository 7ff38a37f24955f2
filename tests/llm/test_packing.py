import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliospark.llm import packing, queries

PARTS = ["<|endoftext|>", " ", "the", "  ", "'ll", "---", "aaaaa", "\n", "\t", "²", "½x", "1,", "é", "日", "\x85", "\x1c", "\xa0", "<|", "|>"]


def test_word_cache_equals_the_tokenizer():
    whole, cache = Tokenizer.from_file(queries.tokenizer_path()), packing.WordCache(queries.tokenizer_path(), words=20)
    assert cache.core is not None
    of = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @settings(max_examples=500, deadline=None)
    @given(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
    def same(text):
        assert cache.ids(text) == of(text)

    same()
    every = "".join(map(chr, range(0x250)))
    assert all(cache.ids(t) == of(t) for t in (every, *every, *(f"a {c} b{c}" for c in every), *(c + c + " " + c for c in every)))


def test_pieces_and_sequences_equal_plain_packing(spark, sf_dir):
    """All documents against the tokenizer called on each text, cut and packed best-fit decreasing in one go."""
    whole, want, lengths = Tokenizer.from_file(queries.tokenizer_path()), {}, []
    for r in queries.table(spark, sf_dir, "documents").collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *(len(ids) - 2048 * k for k in range(-(-len(ids) // 2048) - 1, -1, -1))]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, piece] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
            lengths.append(b - a)
    got = queries.QUERIES["op6_best_fit_packing"](spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    plain = len(packing.best_fit_decreasing(np.array(lengths), 2048)[2])
    assert packing.dual_feasible_bound(np.array(lengths), 2048) <= len({r.sequence_id for r in got}) <= 1.01 * plain + 1
