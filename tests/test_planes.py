"""Forward projections against the inverse ones, hole thresholds and small pixel functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.functions.projection import PLANES, TO_PLANE, image_cell, image_pixels, symexp, symlog
from skyframe.functions.rotation import Rotator
from skyframe.operators import graph


@pytest.mark.parametrize("plane", list(PLANES))
def test_to_the_plane_and_back(spark, plane):
    sky = spark.range(768).select(P.pix2vec(8, "id").alias("v"))
    back = sky.select("v", TO_PLANE[plane](F.col("v")).alias("p")).where("p is not null").select("v", PLANES[plane][0](F.col("p.x"), F.col("p.y")).alias("w"))
    row = back.agg(F.count("*").alias("n"), F.max(sum(F.abs(F.col(f"v.{c}") - F.col(f"w.{c}")) for c in "xyz")).alias("off")).first()
    assert row.n >= 352 and row.off < 1e-6


def test_cells_are_where_the_image_shows_the_pixel(spark):
    turn = Rotator(rot=(40, 25, 10))
    for plane in PLANES:
        grid = image_pixels(spark, 64, plane, 60, 30, turn).where("ipix is not null").select("i", "j", P.pix2vec(64, "ipix").alias("v"))
        got = grid.select("i", "j", image_cell(F.col("v"), plane, 60, 30, turn).alias("c")).where("c is not null")
        # A pixel's centre is not the cell's: it may lie in the next cell, and at an edge on the other side of the sky.
        near = got.where("abs(i - c.i) <= 1 and abs(j - c.j) <= 1").count()
        assert near >= 0.9 * grid.count()


def test_hole_thresholds(spark):
    """A lone masked pixel is smaller than one and a half pixels, so only the pair counts as a hole."""
    mask = spark.range(12).select(F.col("id").alias("ipix"), F.col("id").isin(0, 6, 10).alias("masked"))
    v = np.array([tuple(r.v) for r in spark.range(12).select("id", P.pix2vec(1, "id").alias("v")).orderBy("id").collect()])
    area = 4 * math.pi / 12 * (180 * 60 / math.pi) ** 2
    got = graph.dist2holes(mask, 1, min_area_arcmin2=1.5 * area).orderBy("ipix").collect()
    assert [r.distance for r in got] == pytest.approx(np.arccos(np.clip(v @ v[[6, 10]].T, -1, 1)).min(axis=1), abs=1e-7)


def test_small_functions(spark):
    row = spark.range(1).select(
        P.order2npix(3).alias("npix"), P.npix2order(768).alias("order"), P.npix2order(12 * 9).alias("none"), P.theta_ok(F.lit(3.2)).alias("far"), P.theta_ok(F.lit(math.pi)).alias("ok"),
        P.unit(P.record(x=0.0, y=3.0, z=4.0)).alias("u"), P.unit(P.record(x=0.0, y=0.0, z=0.0)).alias("zero"), P.let(P.lonlat2vec(250.0, -35.0), lambda v: P.vec2lonlat(v["x"], v["y"], v["z"])).alias("a"), symexp(symlog(F.lit(-7.5))).alias("s"),
    ).first()
    assert (row.npix, row.order, row.none, row.far, row.ok) == (768, 3, None, False, True)
    assert tuple(row.u) == pytest.approx((0, 0.6, 0.8)) and row.zero.x is None and tuple(row.a) == pytest.approx((250, -35)) and row.s == pytest.approx(-7.5)
