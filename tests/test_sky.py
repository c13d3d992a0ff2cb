"""Regions, maps, graph, harmonics, rotation, projection and FITS."""

import glob
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.functions.projection import PLANES, project_map
from skyframe.functions.rotation import Rotator, frame_matrix
from skyframe.operators import graph, harmonic, maps, regions
from skyframe.sources import fits

V = (0.17101007, 0.03015369, 0.98480775)


def ids(df):
    return sorted(r.ipix for r in df.collect())


def ramp(spark, nside):
    return spark.range(12 * nside * nside).select(F.col("id").alias("ipix"), F.col("id").cast("double").alias("value"))


def vectors(spark, nside):
    return spark.range(12 * nside * nside).select(F.col("id").alias("ipix"), P.pix2vec(nside, "id").alias("v")).select("ipix", "v.*").toPandas()


def test_disc(spark):
    assert ids(regions.query_disc(spark, 8, V, math.radians(6))) == [4] and ids(regions.query_disc(spark, 8, V, math.radians(6), inclusive=True)) == [0, 3, 4, 5, 11, 12, 13, 23]
    assert regions.query_disc(spark, 3518, (0, 0, 1), math.radians(1)).count() == 11400
    p = vectors(spark, 8)
    for vec, r in (((1, 0, 0), 0.7), ((0.3, -0.4, -0.8), 1.9), ((0, 0, -1), 0.5), ((0.1, 0.1, 0.99), 0.6), ((0, 1, 0.2), 3.1)):
        u = np.array(vec) / np.linalg.norm(vec)
        want = p.ipix[p[["x", "y", "z"]].to_numpy() @ u >= math.cos(r)].tolist()
        assert ids(regions.query_disc(spark, 8, vec, r)) == want
        assert len(ids(regions.query_disc(spark, 8, vec, r, nest=True))) == len(want)


def test_strip_polygon_and_ranges(spark):
    p = vectors(spark, 8)
    theta = np.arccos(p.z)
    assert ids(regions.query_strip(spark, 8, 0.5, 1.0)) == p.ipix[(theta >= 0.5) & (theta <= 1.0)].tolist()
    assert ids(regions.query_strip(spark, 8, 2.0, 1.0)) == p.ipix[(theta >= 2.0) | (theta <= 1.0)].tolist()
    assert ids(regions.query_polygon(spark, 8, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])) == p.ipix[(p.x >= -1e-12) & (p.y >= -1e-12) & (p.z >= -1e-12)].tolist()
    got = regions.ranges_of(spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 9, 10)], "ipix long")).collect()
    assert sorted(map(tuple, got)) == [(1, 3), (7, 7), (9, 10)]
    disc = regions.disc_ranges(spark, 8, V, 0.5)
    assert ids(regions.in_ranges(ramp(spark, 8), disc, 8)) == ids(regions.pixels_of(disc))


def test_grades(spark):
    got = {r.ipix: r.value for r in maps.ud_grade(ramp(spark, 2), 2, 1).collect()}
    assert [got[i] for i in range(12)] == [5.5, 7.25, 9, 10.75, 21.75, 21.75, 23.75, 25.75, 36.5, 38.25, 40, 41.75]
    assert maps.ud_grade(maps.ud_grade(ramp(spark, 2), 2, 8), 8, 2).join(ramp(spark, 2).withColumnRenamed("value", "w"), "ipix").where("value <> w").count() == 0
    holed = ramp(spark, 2).withColumn("value", F.when(F.col("ipix") == 0, P.UNSEEN).otherwise(F.col("value")))
    assert maps.ud_grade(holed, 2, 1, pessimistic=True).where("value is null").count() == 1
    assert maps.ud_grade(holed, 2, 1).where("value is null").count() == 0


def test_interpolation_and_dipole(spark):
    points = spark.range(10).select("id", (F.col("id") * math.pi / 9).alias("theta"), F.lit(0.0).alias("phi"))
    got = [r.value for r in maps.interpolate(points, ramp(spark, 1), 1, "id", "theta", "phi").orderBy("id").collect()]
    assert got == pytest.approx([1.5, 1.5, 1.5, 2.20618428, 3.40206143, 5.31546486, 7.94639458, 9.5, 9.5, 9.5])
    sky = spark.range(768).select(F.col("id").alias("ipix"), P.pix2vec(8, "id").alias("v")).select("ipix", (F.col("v.x") * 0.3 + F.col("v.y") * 0.5 + F.col("v.z") * 0.2 + 1.5).alias("value"))
    mono, dipole = maps.fit_dipole(sky, 8)
    assert mono == pytest.approx(1.5) and dipole == pytest.approx([0.3, 0.5, 0.2])
    assert maps.remove_dipole(sky, 8).agg(F.max(F.abs("value"))).first()[0] < 1e-12


def test_graph(spark):
    p = vectors(spark, 4)
    peak = spark.createDataFrame([(int(i), float(z)) for i, z in zip(p.ipix, p.z + 0.01 * p.x, strict=True)], "ipix long, value double")
    ends = graph.hotspots(peak, 4).collect()
    assert any(r.is_max and r.ipix < 4 for r in ends) and any(r.is_min and r.ipix >= 188 for r in ends)
    near = ids(regions.query_disc(spark, 4, (0, 0.5, -0.5), 0.5))
    mask = spark.range(192).select(F.col("id").alias("ipix"), (F.col("id").isin(near) | (F.col("id") == 0)).alias("masked"))
    filled = graph.fill_small_holes(mask, 4, min_size=2)
    assert ids(filled.where("masked")) == near
    u = p[["x", "y", "z"]].to_numpy()
    want = np.arccos(np.clip(u @ u[[*near, 0]].T, -1, 1)).min(axis=1)
    got = np.array([r.distance for r in graph.dist2holes(mask, 4).orderBy("ipix").collect()])
    assert np.abs(got - want).max() < 1e-7


def test_harmonics(spark):
    alm = spark.createDataFrame([(l, m, 1.0 / (l + 1), 0.0 if m == 0 else 0.3 / (m + l)) for l in range(9) for m in range(l + 1)], harmonic.ALM)
    sky = harmonic.alm2map(alm, 8)
    back = harmonic.map2alm(sky, 8, lmax=8).join(alm.withColumnsRenamed({"re": "a", "im": "b"}), ["l", "m"])
    assert back.agg(F.max(F.abs(F.col("re") - F.col("a")) + F.abs(F.col("im") - F.col("b")))).first()[0] < 1e-5
    theta, phi = 1.1, 0.4
    y11 = -math.sqrt(3 / (8 * math.pi)) * math.sin(theta)
    assert harmonic.legendre(1, 1, np.array([math.cos(theta)]), np.array([math.sin(theta)]))[0, 0] == pytest.approx(y11)
    cl = {r.l: r.cl for r in harmonic.alm2cl(alm).collect()}
    own = {r.l: r.cl for r in harmonic.anafast(sky, 8, lmax=8).collect()}
    assert all(own[l] == pytest.approx(cl[l], rel=1e-4) for l in range(9))
    z, weight = np.polynomial.legendre.leggauss(1400)  # started far below the smallest double near the poles
    high = harmonic.legendre(900, 1300, z, np.sqrt(1 - z * z))
    assert 2 * math.pi * (high[-1] ** 2) @ weight == pytest.approx(1) and abs((high[-1] * high[-3]) @ weight) < 1e-9
    beam = {r.l: r.t for r in harmonic.gauss_beam(spark, math.radians(10), 32).collect()}
    assert beam[0] == 1 and beam[20] == pytest.approx(math.exp(-0.5 * 420 * (math.radians(10) / math.sqrt(8 * math.log(2))) ** 2))
    assert harmonic.resize_alm(alm, 3).count() == 10 and harmonic.alm_lmax(harmonic.alm_size(8)) == 8
    index = alm.select("l", "m", harmonic.alm_lm(harmonic.alm_index("l", "m", 8), 8).alias("x"))
    assert index.where("l <> x.l or m <> x.m").count() == 0


def test_rotations(spark):
    assert frame_matrix("G", "E") @ [1, 0, 0] == pytest.approx([-0.05487563, -0.99382135, -0.09647686], abs=1e-5)
    r = Rotator(rot=(30, 20, 10), coord="GC")
    assert (r * r.inverse).does_rotate is False and Rotator(rot=(0, 0, 0)).does_rotate is False
    lon, lat = math.radians(30), math.radians(20)
    v = Rotator(rot=(30, 20)).matrix @ [math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)]
    assert v == pytest.approx([1, 0, 0])


def test_projection_and_fits(spark, tmp_path):
    for plane in PLANES:
        image = project_map(ramp(spark, 4), 4, plane, 40, 20)
        assert image.count() == 800 and image.where("value is null").count() == 0
    for nest, partial, name in ((False, False, "a.fits"), (True, False, "b.fits.gz"), (False, True, "c.fits")):
        path = str(tmp_path / name)
        sky = ramp(spark, 4).withColumn("value", F.when(F.col("ipix") != 3, F.col("value")))
        fits.write_map(sky, path, 4, nest, partial)
        back = fits.read_map(spark, path, nest=nest)
        assert back.count() == 192 - partial and back.join(ramp(spark, 4).withColumnRenamed("value", "w"), "ipix").where("value <> w or (value is null and ipix <> 3)").count() == 0
    alm = spark.createDataFrame([(2, 1, 0.5, -0.25), (3, 0, 1.0, 0.0)], harmonic.ALM)
    fits.write_alm(alm, str(tmp_path / "alm.fits"))
    assert fits.read_alm(spark, str(tmp_path / "alm.fits")).exceptAll(alm).count() == 0
