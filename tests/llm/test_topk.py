import math

import numpy as np
import pytest

from foliospark.llm import topk


def nodes(tree):
    yield tree
    for kid in tree.kids:
        yield from nodes(kid)


def clustered(seed, clusters, each, width, spread=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (clusters, width))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return np.concatenate([m + rng.normal(0, spread, (each, width)) for m in middle])[rng.permutation(clusters * each)]


def brute(rows, k, every, scale=64):
    """Each query_id's best pairs by exact whole numbers."""
    whole = [(i, [math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in whole:
        if q % every == 0:
            out.setdefault(q, []).extend((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for i, b in whole if i != q)
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])] for q, found in out.items()}


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, score string, cell string")


def lists(frame):
    got = {}
    for r in frame.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_cover_tree_keeps_its_invariants():
    points = np.floor(64 * clustered(1, 30, 60, 12))
    points = np.concatenate([points, points[:100], points[[0] * 50]])
    tree = topk.CoverTree.of(points)
    assert len(list(nodes(tree))) > 30
    seen = []
    for node in nodes(tree):
        gap = np.sqrt(((points[node.rows] - node.center) ** 2).sum(axis=1))
        assert gap.max() <= node.radius * (1 + 1e-12) and (gap.max() == 0 or gap.max() <= 2.0**node.level) and node.at in node.rows
        if node.kids:
            assert node.kids[0].at == node.at and all(kid.level < node.level for kid in node.kids)
            centers = np.array([kid.center for kid in node.kids])
            apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2))[~np.eye(len(centers), dtype=bool)]
            assert not len(apart) or apart.min() > 2.0 ** (node.level - 1)
            assert sorted(np.concatenate([kid.rows for kid in node.kids])) == sorted(node.rows)
        else:
            seen += node.rows.tolist()
    assert sorted(seen) == list(range(len(points)))


def test_bounds_hold_for_all_pairs():
    rng = np.random.default_rng(2)
    for spread in (0.1, 1.0, 20.0):
        q, p = (np.floor(rng.normal(rng.normal(0, 10, 6), spread, (40, 6))) for _ in range(2))
        a, b = topk.CoverTree.of(q), topk.CoverTree.of(p)
        assert (q @ p.T).max() <= topk.pair_bound(float(a.center @ b.center), a.norm, a.radius, a.most, b.norm, b.radius, b.most)


@pytest.mark.parametrize("parts", [50, 4000])
def test_clustered_vectors_are_pruned(spark, monkeypatch, parts):
    monkeypatch.setattr(topk, "PART_ROWS", parts)
    rows = [(n, v.tolist()) for n, v in enumerate(clustered(3, 40, 60, 16))]
    frame = table(spark, rows)
    assert lists(topk.top_k(frame, k=10)) == brute(rows, 10, 20)
    scored = topk.scored_pairs(frame, k=10).collect()
    assert len(scored) == 120 and sum(r.scored for r in scored) < 0.25 * 120 * len(rows)


def test_components_of_any_size_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(n, rng.normal(0, 0.3, 5).tolist()) for n in range(200)]
    rows += [(200, [1e9, -0.25, 3.0, 0.0, 1e-9]), (201, [1e9, 1e9, 0.5, -1e9, 2.0]), (220, [1e9, 1.0, 1e9, 1.0, 1e9]), (221, [123456789.125, -98765.5, 1e6, 1.0, 0.1]), (240, [3e17, -1e17, 1.0, 0.0, 5.0]), (241, [1e300, 1.0, 0.0, 0.0, 0.0]), (260, [1e308, -1e308, 1e308, 0.0, 0.0])]
    assert lists(topk.top_k(table(spark, rows), k=7)) == brute(rows, 7, 20)


def test_edges_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 30)
    rng = np.random.default_rng(5)
    rows = [(n, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for n in range(150)]
    rows += [(300 + n, rows[20][1]) for n in range(90)]
    rows += [(20, rows[20][1]), (40, rows[41][1]), (40, rows[42][1]), (1000, None), (1020, [1.0, None]), (1040, [math.nan] * 8), (1060, [math.inf] * 8), (None, [0.1] * 8), (1080, [0.5] * 3), (1100, []), (1120, [0.0] * 8)]
    frame = table(spark, rows, "float")
    assert lists(topk.top_k(frame, k=20)) == brute(rows, 20, 20)
    assert topk.top_k(frame.limit(0)).count() == 0 and topk.top_k(frame.where("vec_id = 100")).count() == 0
    few = lists(topk.top_k(frame.where("vec_id in (100, 101, 102)"), k=20))
    assert few == brute([r for r in rows if r[0] in (100, 101, 102)], 20, 20) and len(few[100]) == 2
