"""Wigner's functions in tiles, and random fields that are the same on any cluster."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import harmonic, spin

R = np.random.default_rng(2)


def by_eigenvectors(l, theta):  # noqa: E741
    """exp(-i theta Jy) of a degree, from the eigenvectors of the x generator."""
    m = np.arange(-l, l + 1)
    side = 0.5 * np.sqrt(l * (l + 1.0) - m[:-1] * (m[:-1] + 1.0))
    e, q = np.linalg.eigh(np.diag(side, 1) + np.diag(side, -1))
    turn = np.diag(np.exp(-0.5j * math.pi * m))
    return (turn @ (q * np.exp(-1j * e * theta)) @ q.T @ turn.conj()).real


@pytest.mark.parametrize("theta", [0.0, 1e-9, 0.3, math.pi / 2, 2.7, math.pi, -1.1, 4.0, 2 * math.pi + 0.3])
def test_a_tile_equals_the_matrix(theta):
    top = 30
    k, m = np.array([0, 1, 5, 12, 30]), np.array([0, 3, 7, 30, -1, -3, -12, -30])
    a = R.normal(size=(top + 1, len(m))) + 1j * R.normal(size=(top + 1, len(m)))
    for sense in (1, -1):
        got = spin.turned_tile(a, sense * k, m, theta)
        for l in range(top + 1):  # noqa: E741
            d = by_eigenvectors(l, theta)
            for i, order in enumerate(sense * k):
                want = sum(d[order + l, n + l] * a[l, j] for j, n in enumerate(m) if abs(n) <= l) if abs(order) <= l else 0
                assert got[l, i] == pytest.approx(want, abs=1e-9)


def test_a_tile_at_high_degrees_fits_and_is_a_turn():
    """A tile at l = 6,143 takes under 300 MB; at l = 150, rows of Wigner's functions of one order are unit vectors over all orders."""
    lmax, t = 6143, spin.ORDER_TILE
    own = np.arange(3000, 3000 + t)
    m = np.concatenate([own, -own])
    a = np.zeros((lmax + 1, len(m)), complex)
    a[6000:] = 1.0
    tracemalloc.start()
    out = spin.turned_tile(a, np.arange(2560, 2560 + t), m, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak + a.nbytes < 300e6 and np.isfinite(out).all()
    lmax, k = 150, np.array([4, 26, 50, 150])
    total = np.zeros(len(k))
    for first in range(-lmax, lmax + 1, 100):
        m = np.arange(first, min(first + 100, lmax + 1))
        low, sign, start = spin._wigner_starts(k, m, 0.9)
        assert (low >= np.abs(m)[None, :]).all() and np.isin(sign, (-1, 1)).all() and not np.isnan(start).any()
        total += _squares(k, m, lmax, 0.9)
    assert total == pytest.approx(np.ones(len(k)))


def _squares(k, m, lmax, theta):
    """Sums over m of the squares of the last degree's functions."""
    out = np.zeros(len(k))
    for order in m:
        a = np.zeros((lmax + 1, 1), complex)
        a[lmax] = 1.0
        out += np.abs(spin.turned_tile(a, k, np.array([order]), theta)[lmax]) ** 2
    return out


def coefficients(spark, lmax, mmax=None):
    rows = [(l, m, float(R.normal()), float(R.normal()) if m else 0.0) for l in range(lmax + 1) for m in range(min(l, lmax if mmax is None else mmax) + 1)]
    return spark.createDataFrame(rows, harmonic.ALM)


def test_tiles_add_up(spark, monkeypatch):
    alm = coefficients(spark, 9).cache()
    whole = spin.rotate_alm(alm, 0.4, 1.1, -0.7).toPandas().sort_values(["l", "m"])
    monkeypatch.setattr(spin, "ORDER_TILE", 3)
    tiled = spin.rotate_alm(alm, 0.4, 1.1, -0.7).toPandas().sort_values(["l", "m"])
    assert len(tiled) == 55 and np.allclose(tiled, whole)
    back = spin.rotate_alm(spin.rotate_alm(alm, 0.4, 1.1, -0.7), 0.7, -1.1, -0.4).toPandas().sort_values(["l", "m"])
    assert np.allclose(back, alm.toPandas().sort_values(["l", "m"]), atol=1e-12)
    few = spin.rotate_alm(coefficients(spark, 6, 2), 0.1, 0.2, 0.3)
    assert few.count() == 28
    assert spin.rotate_alm(alm.where("false"), 0.1, 0.2, 0.3).count() == 0


def test_random_fields_do_not_depend_on_partitions(spark):
    cl = spark.range(0, 40).select(F.col("id").cast("int").alias("l"), F.lit(1.0).alias("cl"), F.lit(4.0).alias("tt"), F.lit(2.0).alias("ee"), F.lit(1.0).alias("bb"), F.lit(1.5).alias("te"))
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    one, seven = cl.repartition(1), cl.repartition(7)
    assert same(harmonic.synalm(one, seed=5), harmonic.synalm(seven, seed=5)) and not same(harmonic.synalm(one, seed=5), harmonic.synalm(one, seed=6))
    for a, b in zip(spin.synalm_pol(one, seed=5), spin.synalm_pol(seven, seed=5), strict=True):
        assert same(a, b)
    drawn = harmonic.synalm(cl, seed=5).where("m > 0").select((F.col("re") * math.sqrt(2)).alias("x"), (F.col("im") * math.sqrt(2)).alias("y")).toPandas()
    for c in ("x", "y"):
        v = np.sort(drawn[c].to_numpy())
        normal = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in v])
        assert np.abs(normal - (np.arange(len(v)) + 0.5) / len(v)).max() < 1.63 / math.sqrt(len(v))  # Kolmogorov, 1 in 100
    assert abs(np.corrcoef(drawn["x"], drawn["y"])[0, 1]) < 0.12
    t, p = spin.synalm_pol(cl, seed=5)
    both = spin.spectra(t, p).agg(*[F.avg(c).alias(c) for c in ("tt", "ee", "bb", "te", "eb", "tb")]).first()
    assert [both[c] for c in ("tt", "ee", "bb", "te", "eb", "tb")] == pytest.approx([4, 2, 1, 1.5, 0, 0], abs=0.5)
    assert harmonic.synfast(one, 4, seed=1).count() == 192
