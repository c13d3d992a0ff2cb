"""Line integral convolution against lines traced over the whole map, and by its invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.operators import blocks, lines

R = np.random.default_rng(8)


def whole_map(spark, nside, q, u, t, k, step):
    """Means along all pixels' lines, the map in one array, pixels and weights by the column functions."""
    weights = lines.kernel(k)
    centres = np.array([tuple(r.v) for r in spark.range(len(q)).select("id", P.pix2vec(nside, "id").alias("v")).orderBy("id").collect()])

    def at(v):
        rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "i long, x double, y double, z double").coalesce(8)
        angles = rows.select("i", P.vec2pix(nside, "x", "y", "z").alias("p"), P.interp_weights(nside, P.vec2theta("x", "y", "z"), P.vec2phi("x", "y")).alias("w")).orderBy("i").collect()
        pix, w = np.array([[a.pix for a in r.w] for r in angles]), np.array([[a.weight for a in r.w] for r in angles])
        w = np.where(w < 1e-12, 0, w)
        with np.errstate(invalid="ignore"):
            qq, uu = ((np.where(w == 0, 0, w * m[pix])).sum(1) for m in (q, u))
        psi = np.arctan2(uu, qq) / 2
        theta, phi = np.arccos(v[:, 2]), np.arctan2(v[:, 1], v[:, 0])
        south = np.stack([np.cos(theta) * np.cos(phi), np.cos(theta) * np.sin(phi), -np.sin(theta)], 1)
        east = np.stack([-np.sin(phi), np.cos(phi), 0 * phi], 1)
        return np.array([r.p for r in angles]), south * np.cos(psi)[:, None] + east * np.sin(psi)[:, None]

    def go(v, d, h):
        d = d - v * (v * d).sum(1, keepdims=True)
        return v * math.cos(h) + d / np.linalg.norm(d, axis=1, keepdims=True) * math.sin(h)

    total, weight = np.zeros(len(q)), np.zeros(len(q))
    for way in (1, -1):
        v, d, going, place = centres.copy(), None, ~(np.isnan(q) | np.isnan(t)), k // 2
        while 0 <= place < k:
            pix, now = at(v)
            if way > 0 or place != k // 2:
                use = going & ~np.isnan(t[pix])
                total[use] += weights[place] * t[pix][use]
                weight[use] += weights[place]
            now = now * (way if d is None else np.where((now * d).sum(1) < 0, -1, 1)[:, None])
            going &= ~np.isnan(now).any(1)
            now[~going] = [1, 2, 3]
            _, mid = at(go(v, now, step / 2))
            mid = mid * np.where((mid * now).sum(1) < 0, -1, 1)[:, None]
            going &= ~np.isnan(mid).any(1)
            mid[~going] = [1, 2, 3]
            v, d, place = go(v, mid, step), mid, place + way
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


@pytest.mark.parametrize("nest", [False, True])
def test_against_the_whole_map(spark, monkeypatch, nest):
    monkeypatch.setattr(blocks, "ORDER", 2)  # blocks of 16 pixels, so lines are handed on
    nside, k, step = 16, 6, 0.07
    n = 12 * nside * nside
    z, phi = (np.array(c, float) for c in zip(*[(r.a.z, r.a.phi) for r in spark.range(n).select("id", P.pix2zphi(nside, "id").alias("a")).orderBy("id").collect()], strict=True))
    q, u, t = np.cos(2 * phi) + z + 0.2, np.sin(3 * phi) + z * z - 0.4, R.uniform(size=n)
    q[[5, 700]] = np.nan
    t[900] = np.nan
    none = lambda x: None if np.isnan(x) else float(x)
    both = spark.createDataFrame([(i, none(q[i]), none(u[i]), none(t[i])) for i in range(n)], "ipix long, q double, u double, t double").repartition(5)
    both = both.withColumn("ipix", P.ring2nest(nside, "ipix")) if nest else both
    got = lines.line_integral_convolution(both.select("ipix", "q", "u"), nside, both.select("ipix", F.col("t").alias("value")), kernel_steps=k, step_radian=step, nest=nest)
    got = (got.select(P.nest2ring(nside, "ipix").alias("ipix"), "value") if nest else got).orderBy("ipix").collect()
    want = whole_map(spark, nside, q, u, t, k, step)
    want = 1 - 0.95 * (want - np.nanmin(want)) / (np.nanmax(want) - np.nanmin(want))
    assert [r.ipix for r in got] == list(range(n)) and [r.ipix for r in got if r.value is None] == [5, 700, 900]
    off = np.abs(np.array([np.nan if r.value is None else r.value for r in got]) - want)
    # A line's point on the very border of two pixels may fall to either.
    assert np.sum(off > 1e-6) <= 3


def test_a_field_along_meridians(spark):
    """With q alone lines go south to north: a texture by longitude alone stays as it is, one by height is its running mean."""
    nside, k, step = 32, 5, 0.02
    grid = spark.range(12 * nside * nside).select(F.col("id").alias("ipix"), F.lit(1.0).alias("q"), F.lit(0.0).alias("u"), P.pix2zphi(nside, "id").alias("a"))
    grid = grid.select("ipix", "q", "u", F.acos("a.z").alias("theta")).cache()
    rows = lines.line_integral_convolution(grid, nside, grid.select("ipix", F.col("theta").alias("value")), kernel_steps=k, step_radian=step).join(grid, "ipix").where("theta > 0.3 and theta < 2.8").collect()
    theta, value = np.array([r.theta for r in rows]), np.array([r.value for r in rows])
    fit = np.polyfit(theta, value, 1)
    assert np.abs(np.polyval(fit, theta) - value).max() < 0.012 and fit[0] < 0


def test_arguments(spark):
    sky = spark.range(12).select(F.col("id").alias("ipix"), F.lit(1.0).alias("q"), F.lit(0.5).alias("u"))
    with pytest.raises(ValueError, match="kernel"):
        lines.line_integral_convolution(sky, 1, steps=50, kernel_steps=51)
    with pytest.raises(ValueError):
        lines.line_integral_convolution(sky, 3)
    for options in ({}, {"ell": 3}, {"modulate": True}):
        values = [r.value for r in lines.line_integral_convolution(sky, 1, kernel_steps=4, step_radian=0.3, **options).collect()]
        assert len(values) == 12 and all(0 <= v <= 1 for v in values)
    assert lines.line_integral_convolution(sky.where("false"), 1, kernel_steps=4).count() == 0
