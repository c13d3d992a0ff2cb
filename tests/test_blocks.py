"""Blocks with halos: extrema against every pixel's neighbours, one shuffle; interpolation of repeated keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.operators import blocks, graph, maps

R = np.random.default_rng(4)


@pytest.mark.parametrize(("nside", "nest", "order"), [(16, False, 2), (8, True, 6), (1, False, 6), (6, False, 6)])
def test_extrema(spark, monkeypatch, nside, nest, order):
    monkeypatch.setattr(blocks, "ORDER", order)
    values = {i: float(np.float32(R.integers(0, 30))) + (1e-9 if i % 5 == 0 else 0) for i in range(12 * nside * nside) if R.random() < 0.8}
    bad = {i for i in values if R.random() < 0.05}
    rows = [(i, P.UNSEEN if i in bad else v) for i, v in values.items()] + [(12 * nside * nside - 1, None)] * ((12 * nside * nside - 1) not in values)
    sky = spark.createDataFrame(rows, "ipix long, value double").repartition(3)
    around = {r.ipix: r.n for r in sky.select("ipix", P.neighbours(nside, "ipix", nest).alias("n")).collect()}
    good = {i: v for i, v in values.items() if i not in bad}
    want = set()
    for i, v in good.items():
        near = [float(np.float32(good[n])) for n in around[i] if n in good]
        low, high = all(v < o for o in near), all(v > o for o in near)
        if low or high:
            want.add((i, v, low, high))
    assert {tuple(r) for r in graph.hotspots(sky, nside, nest).collect()} == want


def test_one_shuffle_of_the_map(spark):
    sky = spark.range(3072).select(F.col("id").alias("ipix"), F.rand(1).alias("value"))
    plan = graph.hotspots(sky, 16, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    dealt = blocks.with_halo(sky.select("ipix", "value"), 256, ["value"])
    assert dealt.where("own").count() == 3072 and dealt.where("not own").count() < 3 * 4 * 64  # three neighbours beyond each pixel of a block's edge


def test_points_with_one_key(spark):
    sky = spark.range(48).select(F.col("id").alias("ipix"), F.col("id").cast("double").alias("value"))
    points = spark.createDataFrame([(1, 1.0, 0.3), (1, 1.0, 0.3), (1, 2.0, 0.3), (None, 0.0, 0.0), (2, None, 0.1)], "k int, theta double, phi double")
    got = maps.interpolate(points, sky, 2, "k", "theta", "phi").collect()
    assert sorted(r.k for r in got if r.k == 1) == [1, 1, 1] and len({round(r.value, 9) for r in got if r.k == 1}) == 2
    assert [r.value for r in got if r.k is None] == [1.5]
    holed = maps.interpolate(points.where("k = 1"), sky.where("ipix > 40"), 2, "k", "theta", "phi").collect()
    assert [r.value for r in holed] == [None] * 3


@pytest.mark.parametrize(("nside", "nest", "order"), [(1, False, 6), (2, True, 6), (8, False, 2), (16, True, 3), (32, False, 6)])
def test_interpolation_against_four_pixels_a_point(spark, monkeypatch, nside, nest, order):
    """Every point's four pixels lie about the one it meets, at poles, faces' corners and blocks' edges too."""
    monkeypatch.setattr(blocks, "ORDER", order)
    sky = spark.range(12 * nside * nside).where("id % 17 <> 5").select(F.col("id").alias("ipix"), F.when(F.col("id") % 13 != 4, F.rand(3)).alias("value")).cache()
    n = 3000
    theta = np.concatenate([np.arccos(R.uniform(-1, 1, n)), R.uniform(0, 0.5, 500), np.pi - R.uniform(0, 0.5, 500), [0, np.pi], np.full(500, np.arccos(2 / 3))])
    phi = np.concatenate([R.uniform(0, 7, n + 500), R.integers(0, 9, 500) * np.pi / 4, [0, 1], R.integers(0, 9, 500) * np.pi / 4 + 1e-9])
    points = spark.createDataFrame([(i, float(t), float(p)) for i, (t, p) in enumerate(zip(theta, phi, strict=True))], "k long, theta double, phi double")
    got = {r.k: r.value for r in maps.interpolate(points, sky, nside, "k", "theta", "phi", nest).collect()}
    value = {r.ipix: r.value for r in sky.collect()}
    wrong = 0
    for r in points.select("k", P.interp_weights(nside, "theta", "phi", nest).alias("w")).collect():
        parts = [0.0 if w.weight == 0 else None if value.get(w.pix) is None else w.weight * value[w.pix] for w in r.w]
        want = None if None in parts else sum(parts)
        wrong += (got[r.k] is None) != (want is None) or (want is not None and abs(want - got[r.k]) > 1e-12)
    assert len(got) == len(theta) and wrong == 0
