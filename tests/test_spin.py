"""Spin transforms, rotation of coefficients, beams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.functions.rotation import Rotator
from skyframe.operators import harmonic, maps, spin

X = np.array([0.3, 1.1, 2.0, 2.9])


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_spin_harmonics():
    for m in range(6):
        assert np.allclose(spin.spin_harmonics(0, m, 9, X)[m:], harmonic.legendre(m, 9, np.cos(X), np.sin(X)))
    k = math.sqrt(5 / (64 * math.pi))
    assert np.allclose(spin.spin_harmonics(2, 2, 2, X)[2], k * (1 - np.cos(X)) ** 2)
    assert np.allclose(spin.spin_harmonics(2, -2, 2, X)[2], k * (1 + np.cos(X)) ** 2)
    z, w = np.polynomial.legendre.leggauss(700)  # started far below the smallest double near the poles
    for s, m in ((2, 500), (2, -500), (1, 0), (3, 1), (3, -2)):
        y = spin.spin_harmonics(s, m, 620, np.arccos(z))
        assert 2 * math.pi * (y[-1] ** 2) @ w == pytest.approx(1) and abs((y[-1] * y[-2]) @ w) < 1e-9


def pair(spark, lmax=6, low=3):
    r = np.random.default_rng(1)
    rows = [(l, m, *map(float, r.normal(size=4) * ([1, m > 0] * 2))) for l in range(low, lmax + 1) for m in range(l + 1)]
    return spark.createDataFrame(rows, spin.PAIR)


@pytest.mark.parametrize("s", [1, 2, 3])
def test_there_and_back(spark, s):
    one = pair(spark)
    back = spin.map2alm_spin(spin.alm2map_spin(one, 16, s), 16, s, 6).withColumnsRenamed({c: c + "2" for c in one.columns[2:]})
    worst = one.join(back, ["l", "m"]).agg(*[F.max(F.abs(F.col(c) - F.col(c + "2"))) for c in one.columns[2:]]).first()
    assert max(worst) < 1e-2 and back.count() == 28


def test_polarised_iterations(spark):
    one = pair(spark, 5)
    alm = one.select("l", "m", F.col("g_re").alias("re"), F.col("g_im").alias("im"))
    t, p = spin.map2alm_pol(spin.alm2map_pol(alm, one, 8), 8, 5, iter=2)
    p = p.withColumnsRenamed({c: c + "2" for c in one.columns[2:]})
    assert max(one.join(p, ["l", "m"]).agg(*[F.max(F.abs(F.col(c) - F.col(c + "2"))) for c in one.columns[2:]]).first()) < 1e-3
    assert t.count() == 21


def test_rotation_of_coefficients(spark):
    r = Rotator(rot=(40, 25, 70))
    for matrix in (r.matrix, np.eye(3), np.diag([-1.0, -1, 1]), np.diag([1.0, -1, -1])):
        psi, theta, phi = spin.zyz_of(matrix)
        about = lambda a: np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
        y = np.array([[math.cos(theta), 0, math.sin(theta)], [0, 1, 0], [-math.sin(theta), 0, math.cos(theta)]])
        assert np.allclose(about(phi) @ y @ about(psi), matrix)
    axis = np.array([0.3, -0.5, 0.81])  # a field (axis . n)^2 + axis . n goes with its axis
    field = lambda u: spark.range(768).select(F.col("id").alias("ipix"), P.pix2vec(8, "id").alias("v")).select("ipix", (F.col("v.x") * float(u[0]) + F.col("v.y") * float(u[1]) + F.col("v.z") * float(u[2])).alias("d")).select("ipix", (F.col("d") * F.col("d") + F.col("d")).alias("value"))
    got = spin.rotate_map_alms(field(axis), 8, r, lmax=4, iter=3)
    assert got.join(field(r.matrix @ axis).withColumnRenamed("value", "w"), "ipix").agg(F.max(F.abs(F.col("value") - F.col("w")))).first()[0] < 1e-4


def test_turned_polarisation(spark):
    sky = spark.range(192).select(F.col("id").alias("ipix"), F.lit(1.0).alias("q"), F.lit(0.0).alias("u"))
    same = spin.rotate_map_polarised(sky, 4, Rotator(rot=(50, 0, 0))).agg(F.max(F.abs(F.col("q") - 1) + F.abs("u"))).first()[0]
    power = spin.rotate_map_polarised(sky, 4, Rotator(rot=(10, 30, 0))).agg(F.max(F.abs(F.col("q") ** 2 + F.col("u") ** 2 - 1)), F.count("*")).first()
    assert same < 1e-12 and power[0] < 1e-12 and power[1] == 192


def test_beams_and_orders(spark):
    sigma = math.radians(10 / 60) / math.sqrt(8 * math.log(2))
    theta = np.linspace(0, math.radians(1), 1000)
    rows = spark.createDataFrame([(float(t), float(math.exp(-0.5 * (t / sigma) ** 2) / (2 * math.pi * sigma**2))) for t in theta], "theta double, beam double")
    got = {r.l: r.bl for r in spin.beam2bl(rows, 64).collect()}
    assert all(got[l] == pytest.approx(math.exp(-0.5 * l * (l + 1) * sigma**2), rel=1e-4) for l in range(65))
    wide = math.radians(5) / math.sqrt(8 * math.log(2))
    window = harmonic.gauss_beam(spark, math.radians(5), 400).select("l", F.col("t").alias("bl"))
    near = spin.bl2beam(window, spark.createDataFrame([(0.0,), (0.03,)], "theta double")).orderBy("theta").collect()
    assert [r.beam for r in near] == pytest.approx([math.exp(-0.5 * (r.theta / wide) ** 2) / (2 * math.pi * wide**2) for r in near], rel=5e-3)
    assert spin.blm_gauss(spark, 0.1, 5, pol=True).groupBy("comp").count().orderBy("comp").collect() == [(0, 6), (1, 4), (2, 4)]
    assert [("TT", "EE", "BB", "TE", "EB", "TB")[k] for k in spin.by_rows(6)] == ["TT", "TE", "TB", "EE", "EB", "BB"]
    with pytest.raises(ValueError):
        spin.by_rows(5)


def test_random_coefficients(spark):
    cl = spark.range(60, 64).select(F.col("id").cast("int").alias("l"), F.lit(4.0).alias("tt"), F.lit(2.0).alias("ee"), F.lit(0.0).alias("bb"), F.lit(1.0).alias("te"))
    t, p = spin.synalm_pol(cl, seed=3)
    assert t.where("m = 0 and im <> 0").count() == 0 and p.where("c_re <> 0 or c_im <> 0").count() == 0
    e = p.select("l", "m", F.col("g_re").alias("re"), F.col("g_im").alias("im"))
    mean = lambda a, b=None: harmonic.alm2cl(a, b).agg(F.avg("cl")).first()[0]
    assert mean(t) == pytest.approx(4, rel=0.3) and mean(e) == pytest.approx(2, rel=0.3) and mean(t, e) == pytest.approx(1, abs=0.5)


def test_least_squares_weights_and_windows(spark):
    alm = spark.createDataFrame([(l, m, 1.0 / (l + 1), 0.0 if m == 0 else 0.3 / (m + l)) for l in range(6) for m in range(l + 1)], harmonic.ALM)
    sky = harmonic.alm2map(alm, 4).cache()
    got, rest, steps = harmonic.map2alm_lsq(sky, 4, 5, tol=1e-8)
    worst = got.join(alm.withColumnsRenamed({"re": "a", "im": "b"}), ["l", "m"]).agg(F.max(F.abs(F.col("re") - F.col("a")) + F.abs(F.col("im") - F.col("b"))), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == 21 and rest < 1e-6 and 0 < steps <= 20
    rings = spark.createDataFrame([(1, 0.5)], "ring int, w double")
    pixels = spark.createDataFrame([(7, 2.0)], "ipix long, weight double")
    heavy = harmonic.weighted(sky, 4, pixels, rings).withColumnRenamed("value", "w").join(sky, "ipix")
    assert [(r.ipix, round(r.w / r.value, 9)) for r in heavy.where("abs(w - value) > 1e-12").orderBy("ipix").collect()] == [(i, 1.5) for i in range(4)] + [(7, 2.0)] + [(i, 1.5) for i in range(188, 192)]
    old = spark.createDataFrame([(0, 2.0), (1, 0.0), (2, 4.0)], "l int, fl double")
    new = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)], "l int, fl double")
    assert sorted(map(tuple, harmonic.window_ratio(new, old).collect())) == [(0, 0.5), (1, 0.0), (2, 0.25)]


def test_equalised(spark):
    sky = spark.range(100).select(F.col("id").alias("ipix"), F.when(F.col("id") == 9, P.UNSEEN).when(F.col("id") == 8, float("nan")).otherwise(F.exp(F.col("id") / 20)).alias("value"))
    rows = maps.equalised(sky).orderBy("ipix").collect()
    assert rows[9].level is None and rows[8].level is None and rows[99].level == 1.0
    good = [r.level for r in rows if r.level is not None]
    assert len(good) == 98 and good == sorted(good)
