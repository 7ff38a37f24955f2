import random

import pytest

from foliospark.llm import jaccard
from test_llm import brute_components, docs_of


def crowd(seed, size):
    """One very large group of near copies in a chain, a common passage in most documents, and one large group of copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4_000)]
    passage = [rng.choice(vocabulary) for _ in range(12)]
    base, rows = [rng.choice(vocabulary) for _ in range(80)], []
    for n in range(size):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = rng.choice(vocabulary)
        if n % 40 == 39:
            base[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    rows += [" ".join([rng.choice(vocabulary) for _ in range(30)] + passage) for _ in range(size)] + ["the same text over and over again here"] * size
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [8, 60])
def test_hot_tokens_and_large_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 10)
    rows = crowd(3, 170)
    frame = docs_of(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    profiles = jaccard.set_classes(frame.select("doc_id", "text"), 4)
    assert profiles.where("n >= 0").count() == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(frame, 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_hot_tokens_are_found(spark):
    frame = docs_of(spark, [(i, f"x{i} y{i} z{i} common words of all texts", "en", "a") for i in range(300)]).select("doc_id", "text").repartition(2)
    hot = jaccard.hot_tokens(jaccard.set_classes(frame, 4))
    shared = set(map(int, jaccard.shingle_set("common words of all texts", 4)))
    assert set(map(int, hot[:, 0])) == shared and set(map(int, hot[:, 1])) == {300}
