"""Rolling transforms: memory at full resolution, weights within iterations, cuts, polarised spectra."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.operators import harmonic, spin


def test_an_order_at_full_resolution_fits():
    """One order at nside 8,192 and lmax 24,575: two rows of the recursion a tile, not a table of 6.4 GB."""
    nside, lmax, m = 8192, 24575, 20000
    a = np.zeros(lmax - m + 1, complex)
    a[-1], a[-700] = 1 + 2j, -0.5
    tracemalloc.start()
    f = harmonic.synthesised_order(m, a, nside)
    back = harmonic.analysed_order(m, lmax, nside, f)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and len(f) == 4 * nside - 1 and len(back) == len(a)
    _, _, size, _ = harmonic._rings(nside)
    # Quadrature over equal areas: ring sums count each pixel once.
    weighed = harmonic.analysed_order(m, lmax, nside, f * size) * (4 * np.pi / (12 * nside**2))
    assert abs(weighed[-1] - a[-1]) < 0.1 and abs(weighed[-700] - a[-700]) < 0.1


def test_tiles_and_halves_equal_the_table(monkeypatch):
    monkeypatch.setattr(harmonic, "RING_TILE", 5)
    monkeypatch.setattr(spin, "RING_TILE", 7)
    r, nside, lmax = np.random.default_rng(3), 8, 20
    z, s, _, _ = harmonic._rings(nside)
    theta = np.arctan2(s, z)
    for m in (0, 1, 6, 20):
        f, a = (r.normal(size=n) + 1j * r.normal(size=n) for n in (4 * nside - 1, lmax - m + 1))
        table = harmonic.legendre(m, lmax, z, s)
        assert np.allclose(harmonic.analysed_order(m, lmax, nside, f), table @ f) and np.allclose(harmonic.synthesised_order(m, a, nside), a @ table)
        for order in (m, -m):
            c = np.concatenate([np.zeros(m), a])
            table = spin.spin_harmonics(2, order, lmax, theta)
            assert np.allclose(spin.analysed_spin_order(2, order, lmax, theta, f), table @ f) and np.allclose(spin.synthesised_spin_order(2, order, c, theta), c @ table)


def coefficients(spark, lmax=10):
    return spark.createDataFrame([(l, m, 1.0 / (l + 1), 0.0 if m == 0 else 0.3 / (m + l)) for l in range(lmax + 1) for m in range(l + 1)], harmonic.ALM)


def worst(one, two):
    two = two.withColumnsRenamed({"re": "a", "im": "b"})
    return one.join(two, ["l", "m"]).agg(F.max(F.abs(F.col("re") - F.col("a")) + F.abs(F.col("im") - F.col("b")))).first()[0]


def solved_ring_weights(nside, lmax):
    """The least w with which the sums over rings of all even Legendre functions up to lmax are those of the sphere."""
    z, _, size, _ = harmonic._rings(nside)
    z, n = z[: 2 * nside], size[: 2 * nside] * np.where(np.arange(1, 2 * nside + 1) < 2 * nside, 2, 1)
    rows = np.array([np.polynomial.legendre.Legendre.basis(l)(z) * n for l in range(0, lmax + 1, 2)])
    want = np.zeros(len(rows))
    want[0] = 12 * nside**2
    return np.linalg.lstsq(rows, want - rows.sum(axis=1), rcond=None)[0]


def test_ring_weights_in_iterations(spark):
    nside, alm = 8, coefficients(spark)
    sky = harmonic.alm2map(alm, nside).cache()
    rings = spark.createDataFrame([(i + 1, float(w)) for i, w in enumerate(solved_ring_weights(nside, 22))], "ring int, w double")
    plain, heavy = (worst(harmonic.map2alm(sky, nside, 10, iter=0, rings=w), alm) for w in (None, rings))
    assert heavy < plain / 3
    once, twice = (worst(harmonic.map2alm(sky, nside, 10, iter=i, rings=rings), alm) for i in (1, 2))
    assert once < heavy / 10 and twice < once / 10
    outside = harmonic.map2alm(harmonic.weighted(sky, nside, rings=rings), nside, 10, iter=0)
    assert worst(harmonic.map2alm(sky, nside, 10, iter=0, rings=rings), outside) < 1e-14


def test_weights_of_absent_pixels_count_in_iterations(spark):
    sky = harmonic.alm2map(coefficients(spark, 6), 4).cache()
    rings = spark.createDataFrame([(i, 0.1 / i) for i in range(1, 9)], "ring int, w double")
    zeros = sky.select("ipix", F.when(F.col("ipix") % 3 != 0, F.col("value")).otherwise(0.0).alias("value"))
    few = sky.where("ipix % 3 <> 0")
    assert worst(harmonic.map2alm(few, 4, 6, iter=2, rings=rings), harmonic.map2alm(zeros, 4, 6, iter=2, rings=rings)) < 1e-13


def classes_by_force(nside):
    """Pixels alike under quarter turns and mirrors, numbered along each ring from its start."""
    out, n = {}, 0
    for i in range(1, 2 * nside + 1):
        q, half = min(i, nside), 0.5 if i < nside or (i - nside) % 2 == 0 else 0.0
        own = {}
        for j in range(q):
            phi = (j + half) / q
            own.setdefault(round(min(phi % 1, (1 - phi) % 1), 9), []).append(j)
        for k, members in enumerate(sorted(own.values())):
            for j in members:
                out[i, j] = n + k
        n += len(own)
    return out, n


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
def test_folded_pixel_weights(spark, nside):
    want, n = classes_by_force(nside)
    assert n == (3 * nside + 1) * (nside + 1) // 4
    folded = spark.createDataFrame([(k, k / 100) for k in range(n)], "index int, w double")
    got = harmonic.unfolded_weights(folded, nside)
    place = got.select("ipix", "weight", P.pix2ring(nside, "ipix").alias("ring"), (F.col("ipix") - P.ringinfo(nside, P.pix2ring(nside, "ipix"))["startpix"]).alias("j")).collect()
    assert len(place) == 12 * nside * nside
    for r in place:
        north = min(r.ring, 4 * nside - r.ring)
        assert r.weight == pytest.approx(1 + want[north, r.j % min(north, nside)] / 100)


def test_pixel_weights_stop_iterations_unless_asked_for(spark):
    sky = harmonic.alm2map(coefficients(spark, 6), 4).cache()
    pixels = spark.range(192).select(F.col("id").alias("ipix"), F.lit(1.0).alias("weight"))
    assert worst(harmonic.map2alm(sky, 4, 6, pixels=pixels), harmonic.map2alm(sky, 4, 6, iter=0)) == 0
    assert worst(harmonic.map2alm(sky, 4, 6, pixels=pixels, iter=2), harmonic.map2alm(sky, 4, 6, iter=2)) < 1e-13


def test_cut_bad_and_absent_pixels_count_as_zero(spark):
    sky = harmonic.alm2map(coefficients(spark, 6), 8).cache()
    bad = F.lit(0.0)
    lat = P.pix2ang(8, "ipix", lonlat=True)["lat"]
    zeroed = sky.select("ipix", F.when(F.abs(lat) < 30, bad).otherwise(F.col("value")).alias("value"))
    assert worst(harmonic.map2alm(sky, 8, 6, iter=1, gal_cut=30), harmonic.map2alm(zeroed, 8, 6, iter=1)) < 1e-13
    assert worst(harmonic.map2alm(sky.where(F.abs(lat) >= 30), 8, 6, iter=1), harmonic.map2alm(zeroed, 8, 6, iter=1)) < 1e-13
    marked = sky.select("ipix", F.when(F.abs(lat) < 30, F.when(F.col("ipix") % 2 == 0, P.UNSEEN)).otherwise(F.col("value")).alias("value"))
    assert worst(harmonic.map2alm(marked, 8, 6, iter=1), harmonic.map2alm(zeroed, 8, 6, iter=1)) < 1e-13
    assert harmonic.map2alm(sky.where("false"), 8, 6, iter=1).agg(F.coalesce(F.max(F.abs("re")), F.lit(0.0))).first()[0] == 0


def test_polarised_spectra(spark):
    r = np.random.default_rng(5)
    rows = [(l, m, *map(float, r.normal(size=4) * ([1, m > 0] * 2))) for l in range(2, 7) for m in range(l + 1)]
    pair = spark.createDataFrame(rows, spin.PAIR)
    alm = pair.select("l", "m", (F.col("g_re") + 0.2).alias("re"), F.col("g_im").alias("im"))
    sky = spin.alm2map_pol(alm, pair, 8).cache()
    got = spin.anafast_pol(sky, 8, lmax=6, iter=3).where("l >= 2").toPandas().set_index("l").sort_index()
    a = alm.join(pair, ["l", "m"]).toPandas()
    kinds = {"t": a["re"] + 1j * a["im"], "e": a["g_re"] + 1j * a["g_im"], "b": a["c_re"] + 1j * a["c_im"]}
    for x, y in spin.SPECTRA:
        product = (kinds[x] * np.conj(kinds[y])).to_numpy().real * np.where(a["m"] == 0, 1, 2)
        want = np.bincount(a["l"], product)[2:] / (2 * np.arange(2, 7) + 1)
        assert np.allclose(got[x + y], want, atol=1e-4)
    cross = spin.spectra(alm, pair, alm, pair, nspec=4).toPandas()
    assert list(cross.columns) == ["l", "tt", "ee", "bb", "te"]
    assert np.allclose(cross.set_index("l").sort_index()["te"], spin.spectra(alm, pair).toPandas().set_index("l").sort_index()["te"])
    cut = spin.anafast_pol(sky, 8, lmax=6, iter=0, gal_cut=40, nspec=1).toPandas()
    assert list(cut.columns) == ["l", "tt"] and cut["tt"].sum() < got["tt"].sum()


def test_an_iteration_makes_no_model_map(spark):
    """The residual's stage meets Fourier sums and rings: and no join of two maps."""
    sky = harmonic.alm2map(coefficients(spark, 6), 4)
    rows = harmonic.by_ring(sky, 4, ["value"])
    plan = harmonic._residual_along_rings(harmonic._to_rings(coefficients(spark, 6), 4), rows, 4, 6)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan.split("== Physical Plan ==")[1]
