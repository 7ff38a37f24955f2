"""Nearest vectors of a label, block against block: the same rows as all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators.vectors import nearest_of_label
from foliospark.plans import catalog

SCHEMA = "vec_id long, label int, v array<double>"


def _all_pairs(e):
    a, b = e.where("vec_id % 20 = 0"), e.select(F.col("vec_id").alias("match_id"), "label", F.col("v").alias("w"))
    sim = F.round(F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y), 9)
    near = a.join(b, "label").where("vec_id <> match_id").select("vec_id", "match_id", sim.alias("sim"))
    return near.groupBy("vec_id").agg(F.max_by("match_id", F.struct("sim", -F.col("match_id"))).alias("match_id"))


def _same(spark, given, rows):
    frame = spark.createDataFrame(given, SCHEMA).repartition(3)
    want = sorted(map(tuple, _all_pairs(frame).collect()))
    assert sorted(map(tuple, nearest_of_label(frame, rows=rows).collect())) == want
    return want


@pytest.mark.parametrize("rows", [4, 4096])
def test_ties_and_close_products(spark, rows):
    rng = random.Random(4)
    base = [rng.uniform(-1, 1) for _ in range(7)]
    near = [[x + rng.choice([0, 1e-10, 4e-10, -6e-10, 1e-9]) for x in base] for _ in range(300)]
    far = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(200)]
    large = [[x * 1e9 for x in rng.choice(near)] for _ in range(100)]
    given = [(n, n % 3 if n < 400 else 3, v) for n, v in enumerate(near + far + large)]
    assert _same(spark, given + given[:50] + [(20, 1, far[0]), (600, 9, base), (620, None, base)], rows=rows)


@pytest.mark.parametrize("rows", [4, 4096])
def test_vectors_without_products(spark, rows):
    rng = random.Random(9)
    odd = [None, [], [1.0], [None, 1.0], [math.nan, 1.0], [math.inf, 1.0], [-math.inf, 1.0], [0.0, -0.0], [1e200, 1e200], [-1.5, 2.5], [0.5, 0.25]]
    rows_of = lambda n, pick, label: [(label * 1000 + i, label, rng.choice(pick)) for i in range(n)]
    given = rows_of(90, odd, 1) + rows_of(60, [None], 2) + rows_of(60, [[1.0], [1.0, 2.0]], 3) + rows_of(80, odd[7:], 4) + rows_of(60, odd[4:7], 5) + rows_of(41, [[]], 6) + rows_of(1, odd, 7)
    assert _same(spark, given, rows=rows)
    assert _same(spark, [], rows=rows) == []


def test_pairs_are_not_rows(spark, sf_dir):
    plan = catalog.QUERIES["j16_vector_top1"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
