"""Beams, windows and changes of resolution, polarised or not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.operators import harmonic, maps, spin

R = np.random.default_rng(6)
LMAX = 7


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(l, m, *[float(x) for x in R.normal(size=6) * ([1, m > 0] * 3)]) for l in range(2, LMAX + 1) for m in range(l + 1)]
    both = spark.createDataFrame(rows, "l int, m int, re double, im double, g_re double, g_im double, c_re double, c_im double").cache()
    return both.select("l", "m", "re", "im"), both.drop("re", "im")


def window(spark, columns, f):
    return spark.createDataFrame([(l, *f(l)) for l in range(LMAX + 1)], f"l int, {columns}")


def difference(one, two, columns=("value",)):
    two = two.withColumnsRenamed({c: c + "_b" for c in columns})
    both = one.join(two, "ipix")
    worst = both.agg(F.count("*"), *[F.max(F.abs(F.col(c) - F.col(c + "_b"))) for c in columns]).first()
    return worst[0], max(worst[1:])


def test_smoothing_by_a_window_and_in_nest_order(spark, tables):
    alm = tables[0]
    sky = harmonic.alm2map(alm, 8).cache()
    fall = window(spark, "fl double", lambda l: (1.0 / (1 + l),))  # noqa: E741
    want = harmonic.alm2map(harmonic.almxfl(alm, fall), 8).cache()
    assert difference(harmonic.smoothing(sky, 8, beam_window=fall, lmax=LMAX, iter=2), want)[1] < 1e-4
    nested = sky.select(P.ring2nest(8, "ipix").alias("ipix"), "value")
    back = harmonic.smoothing(nested, 8, beam_window=fall, lmax=LMAX, iter=2, nest=True).select(P.nest2ring(8, "ipix").alias("ipix"), "value")
    n, worst = difference(back, want)
    assert n == 768 and worst < 1e-4
    gauss = harmonic.gauss_beam(spark, 0.3, LMAX).select("l", F.col("t").alias("fl"))
    assert difference(harmonic.alm2map(alm, 8, fwhm=0.3), harmonic.alm2map(harmonic.almxfl(alm, gauss), 8))[1] < 1e-12
    pixwin = window(spark, "t double, p double", lambda l: (1 - l / 20, 1 - l / 30))  # noqa: E741
    assert difference(harmonic.alm2map(alm, 8, pixwin=pixwin), harmonic.alm2map(harmonic.almxfl(alm, pixwin.select("l", F.col("t").alias("fl"))), 8))[1] < 1e-12


def test_polarised_smoothing(spark, tables):
    alm, pair = tables
    sky = spin.alm2map_pol(alm, pair, 8).cache()
    beam = harmonic.gauss_beam(spark, 0.3, LMAX, pol=True)
    t, e = (beam.select("l", F.col(c).alias("fl")) for c in "te")
    want = spin.alm2map_pol(harmonic.almxfl(alm, t), spin.pair_times(pair, e), 8).cache()
    holed = sky.withColumn("q", F.when(F.col("ipix") != 5, F.col("q")))
    got = spin.smoothing_pol(sky, 8, 0.3, lmax=LMAX, iter=2)
    n, worst = difference(got, want, ("i", "q", "u"))
    assert n == 768 and worst < 1e-3
    assert spin.smoothing_pol(holed, 8, 0.3, lmax=LMAX, iter=0).where("q is null").select("ipix").collect() == [(5,)]
    assert difference(spin.smoothing_pol(sky, 8, lmax=LMAX, iter=2, beam_window=beam), want, ("i", "q", "u"))[1] < 1e-3


def test_random_maps_of_windows(spark):
    cl = spark.range(2, LMAX + 1).select(F.col("id").cast("int").alias("l"), F.lit(1.0).alias("cl"), F.lit(4.0).alias("tt"), F.lit(2.0).alias("ee"), F.lit(1.0).alias("bb"), F.lit(1.5).alias("te"))
    pixwin = window(spark, "t double, p double", lambda l: (1 - l / 20, 1 - l / 30))  # noqa: E741
    drawn = harmonic.synfast(cl, 4, seed=3, lmax=5, mmax=2, fwhm=0.2, pixwin=pixwin)
    want = harmonic.alm2map(harmonic.synalm(cl.where("l <= 5"), 2, 3), 4, 0.2, pixwin)
    assert difference(drawn, want)[1] < 1e-12
    t, p = spin.synalm_pol(cl, 3)
    three = spin.synfast_pol(cl, 4, 3, pixwin=pixwin)
    by_hand = spin.alm2map_pol(harmonic.almxfl(t, pixwin.select("l", F.col("t").alias("fl"))), spin.pair_times(p, pixwin.select("l", F.col("p").alias("fl"))), 4)
    assert difference(three, by_hand, ("i", "q", "u"))[1] < 1e-12


def test_change_of_resolution_in_one_ratio(spark, tables):
    alm, pair = tables
    beam_in = window(spark, "t double, e double", lambda l: (1.0 / (1 + l), 0.0 if l == 4 else 1.0 / (2 + l)))  # noqa: E741
    beam_out = window(spark, "t double, e double", lambda l: (1.0 - l / 50, 1.0 - l / 40))  # noqa: E741
    pix_in, pix_out = (window(spark, "t double, p double", lambda l, k=k: (1 - l / k, 1 - l / (k + 9))) for k in (30, 60))  # noqa: E741
    sky = spin.alm2map_pol(alm, pair, 8).cache()
    options = {"lmax": LMAX, "iter": 3, "beam_in": beam_in, "beam_out": beam_out, "pixwin_in": pix_in, "pixwin_out": pix_out}
    t = window(spark, "fl double", lambda l: ((1 - l / 50) * (1 - l / 60) / (1 / (1 + l) * (1 - l / 30)),))  # noqa: E741
    e = window(spark, "fl double", lambda l: (0.0 if l == 4 else (1 - l / 40) * (1 - l / 69) / (1 / (2 + l) * (1 - l / 39)),))  # noqa: E741
    want = spin.alm2map_pol(harmonic.almxfl(alm, t), spin.pair_times(pair, e), 4).cache()
    n, worst = difference(spin.harmonic_ud_grade_pol(sky, 8, 4, **options), want, ("i", "q", "u"))
    assert n == 192 and worst < 5e-3
    one = harmonic.harmonic_ud_grade(sky.select("ipix", F.col("i").alias("value")), 8, 4, **options)
    assert difference(one, want.select("ipix", F.col("i").alias("value")))[1] < 5e-3
    plain = harmonic.harmonic_ud_grade(sky.select("ipix", F.col("i").alias("value")), 8, 4, fwhm_out=0.0, lmax=LMAX)
    assert difference(plain, harmonic.alm2map(alm, 4))[1] < 1e-3


def test_sizes_and_ranges(spark):
    sky = spark.range(192).select(F.col("id").alias("ipix"), F.when(F.col("id") == 3, P.UNSEEN).when(F.col("id") == 4, float("inf")).when(F.col("id") == 5, float("nan")).otherwise(F.col("id").cast("double")).alias("value"))
    assert maps.nside_of(sky) == 4 and maps.size_of(sky) == 192 and maps.fields_of(sky) == ["value"]
    assert maps.nside_of(sky.where("ipix < 20"), partial=True) == 2 and maps.nside_of(sky.where("false"), partial=True) == 1
    for wrong in (sky.where("ipix < 20"), sky.where("ipix <> 5"), sky.where("false"), sky.where("ipix < 191").unionAll(sky.where("ipix = 0"))):
        with pytest.raises(ValueError, match="no sky"):
            maps.nside_of(wrong)
    for wrong in (0, -4, 1.5, 1 << 30):
        with pytest.raises(ValueError):
            maps.checked_nside(wrong)
    assert maps.checked_nside(6) == 6
    with pytest.raises(ValueError, match="no size"):
        maps.checked_nside(6, nest=True)
    assert maps.value_range(sky).collect() == [(0.0, 191.0)] and maps.value_range(sky, low=5, high=9).collect() == [(5.0, 9.0)]
    assert maps.value_range(sky, high=-3).collect() == [(-3.0, -3.0)] and maps.value_range(sky.where("ipix = 3")).collect() == [(None, None)]
