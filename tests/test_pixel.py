"""Golden values and invariants of the pixel functions."""

import math

import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P

PI = math.pi


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_positions_to_pixels(spark):
    ang = [(16, PI / 2, 0.0), (16, PI / 4, PI / 4), (16, PI / 2, PI / 2 + 1e-15), (16, 0.0, 0.0), (16, PI, 0.0), (1, PI / 2, 0.0), (2, PI / 2, 0.0), (4, PI / 2, 0.0), (8, PI / 2, 0.0)]
    assert list(one(spark, *[P.ang2pix(n, F.lit(t), F.lit(p)) for n, t, p in ang])) == [1440, 427, 1520, 0, 3068, 4, 12, 72, 336]
    vec = [(1, 1, 0, 0), (2, 1, 0, 0), (4, 1, 0, 0), (8, 1, 0, 0), (16, 1, 0, 0), (16, 0, 1, 0)]
    assert list(one(spark, *[P.vec2pix(*v) for v in vec])) == [4, 20, 88, 368, 1504, 1520]


def test_pixels_to_positions(spark):
    row = one(spark, *[P.pix2ang(16, p) for p in (1440, 427, 1520, 0, 3068)])
    assert [r.theta for r in row] == pytest.approx([1.52911759, 0.78550497, 1.57079633, 0.05103658, 3.09055608])
    row = one(spark, P.pix2vec(16, 1440), P.pix2vec(16, 427), P.pix2ang(1, 11))
    assert tuple(row[0]) == pytest.approx((0.99913157, 0, 0.04166667)) and tuple(row[1]) == pytest.approx((0.5000534, 0.5000534, 0.70703125))
    assert tuple(row[2]) == pytest.approx((2.30052398, 5.49778714))


def test_schemes(spark):
    assert [tuple(r) for r in one(spark, *[P.pix2xyf(16, p) for p in (1440, 427, 1520, 0, 3068)])] == [(8, 8, 4), (8, 8, 0), (8, 7, 5), (15, 15, 0), (0, 0, 8)]
    assert list(one(spark, *[P.ring2nest(2, p) for p in range(10)])) == [3, 7, 11, 15, 2, 1, 6, 5, 10, 9]
    assert list(one(spark, *[P.nest2ring(2, p) for p in range(10)])) == [13, 5, 4, 0, 15, 7, 6, 1, 17, 9]
    assert one(spark, P.ring2nest(16, 1504))[0] == 1130
    info = [one(spark, P.ringinfo(2, i))[0] for i in range(1, 8)]
    assert [(r.startpix, r.ringpix, r.shifted) for r in info] == [(0, 4, True), (4, 8, True), (12, 8, False), (20, 8, True), (28, 8, False), (36, 8, True), (44, 4, True)]


@pytest.mark.parametrize("nside", [1, 2, 4, 8, 16])
def test_every_pixel_comes_back(spark, nside):
    df = spark.range(12 * nside * nside).select("id", P.pix2ang(nside, "id").alias("a"), P.pix2vec(nside, "id").alias("v"), P.ring2nest(nside, "id").alias("n"))
    df = df.select("id", P.ang2pix(nside, F.col("a.theta"), F.col("a.phi")).alias("r"), P.vec2pix(nside, F.col("v.x"), F.col("v.y"), F.col("v.z"), nest=True).alias("m"), "n", P.nest2ring(nside, "n").alias("b"))
    assert df.where("id <> r or n <> m or id <> b").count() == 0 and df.select("n").distinct().count() == 12 * nside * nside


def test_large_nside(spark):
    n = 2**29
    df = spark.range(1000).select(((F.col("id") * 3_221_225_471_000_000 + 12345) % (12 * n * n)).alias("p"))
    assert df.where(P.nest2ring(n, P.ring2nest(n, "p")) != F.col("p")).count() == 0


def test_neighbours(spark):
    assert one(spark, P.neighbours(1, 4), P.neighbours(1, P.ang2pix(1, F.lit(PI / 2), F.lit(PI / 2)))) == ([11, 7, 3, -1, 0, 5, 8, -1], [8, 4, 0, -1, 1, 6, 9, -1])
    for nside in (1, 2, 4, 8):
        pairs = spark.range(12 * nside * nside).select("id", F.explode(P.neighbours(nside, "id")).alias("n")).where("n >= 0")
        back = pairs.select(F.col("n").alias("id"), F.col("id").alias("n"))
        assert pairs.exceptAll(back).count() == 0 and pairs.where("id = n").count() == 0
        close = pairs.select(P.angdist(P.pix2vec(nside, "id"), P.pix2vec(nside, "n")).alias("d"))
        assert close.agg(F.max("d")).first()[0] < 2.1 * one(spark, P.max_pixrad(nside))[0]


def test_interpolation(spark):
    got = one(spark, P.interp_weights(1, F.lit(0.0), F.lit(0.0)))[0]
    assert [(r.pix, r.weight) for r in got] == [(1, 0.25), (2, 0.25), (3, 0.25), (0, 0.25)]
    want = [1.5, 1.5, 1.5, 2.20618428, 3.40206143, 5.31546486, 7.94639458, 9.5, 9.5, 9.5]
    for i, w in enumerate(want):
        found = one(spark, P.interp_weights(1, F.lit(PI * i / 9), F.lit(0.0)))[0]
        assert sum(r.pix * r.weight for r in found) == pytest.approx(w)


def test_resolution(spark):
    row = one(spark, P.max_pixrad(512), P.nside2resol(512, arcmin=True), P.nside2pixarea(512), P.npix2nside(768), P.npix2nside(769), P.nside2order(16), P.nside2order(12), P.order2nside(3), P.min_valid_nside(355))
    assert list(row[:3]) == pytest.approx([2.0870552355e-03, 6.87097282363, 3.9947416351188569e-06])
    assert list(row[3:]) == [8, None, 4, None, 8, 8]


def test_boundaries_surround_the_centre(spark):
    df = spark.range(768).select(P.pix2vec(8, "id").alias("c"), F.explode(P.boundaries(8, "id", step=2)).alias("b"))
    far = df.agg(F.max(P.angdist(F.col("c"), F.col("b"))), F.min(P.angdist(F.col("c"), F.col("b")))).first()
    assert far[0] == pytest.approx(one(spark, P.max_pixrad(8))[0]) and far[1] > 0.02
    north = one(spark, P.boundaries(1, 0))[0][0]
    assert north.z == pytest.approx(1)
