"""Spin-weighted harmonics: pairs of coefficients (l, m, g_re, g_im, c_re, c_im) and pairs of maps (ipix, q, u).

The transforms have the two grouped stages of the scalar ones, with orders of
both signs on the rings between them.  A field q + iu of spin s is
-sum (g + ic) sY over all orders, where g and c are real fields' coefficients.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions import pixel as P

from ._lineage import settled
from .harmonic import ALM, ORDER_BLOCK, RING_BLOCK, RING_TILE, SUMS, _block, _complex, _fourier, _ring_values, _rings, _rolled, alm2map, almxfl, by_ring, effective_resolution_fwhm, map2alm, normals, transfer, windows_of
from .maps import interpolate, mask_bad

PAIR = "l int, m int, g_re double, g_im double, c_re double, c_im double"


def spin_rows(s: int, m: int, lmax: int, theta: np.ndarray):
    """(l, row) from the first degree on: sY at azimuth 0, of order m (of either sign); two rows are held.

    Wigner's functions by their recursion over degrees, started in logarithms.
    """
    low = max(abs(m), s)
    if abs(m) < s:
        j, a, sign = s, -m, (-1) ** (s + m)
    else:
        j, a, sign = (m, -s, (-1) ** (m + s)) if m > 0 or s == m == 0 else (-m, s, 1)
    with np.errstate(divide="ignore"):
        c, t = np.log(np.cos(theta / 2)), np.log(np.sin(theta / 2))
    start = 0.5 * (math.lgamma(2 * j + 1) - math.lgamma(j + a + 1) - math.lgamma(j - a + 1)) + (j + a) * c + (j - a) * t
    z, k = np.cos(theta), -s

    def following(n: int, now: np.ndarray, before: np.ndarray) -> np.ndarray:
        l = n - 1  # noqa: E741
        first = (2 * l + 1) * n / math.sqrt((n * n - m * m) * (n * n - k * k))
        shift = m * k / (l * n) if l else 0.0
        back = math.sqrt((l * l - m * m) * (l * l - k * k)) / (l * (2 * l + 1)) if l > low else 0.0
        return first * ((z - shift) * now - back * before)

    for l, row in _rolled(low, lmax, sign, start, following):  # noqa: E741
        yield l, row * ((-1) ** s * math.sqrt((2 * l + 1) / (4 * math.pi)))


def spin_harmonics(s: int, m: int, lmax: int, theta: np.ndarray) -> np.ndarray:
    """(lmax + 1, rings): the rows of ``spin_rows`` as one table, zero below the first degree."""
    out = np.zeros((lmax + 1, len(theta)))
    for l, row in spin_rows(s, m, lmax, theta):  # noqa: E741
        out[l] = row
    return out


def _tiles(theta: np.ndarray):
    for at in range(0, len(theta), RING_TILE):
        yield slice(at, at + RING_TILE)


def synthesised_spin_order(s: int, m: int, a: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """What coefficients a (l = 0, 1, ...) of order m, of either sign, sum to at colatitudes."""
    out = np.zeros(len(theta), complex)
    for tile in _tiles(theta):
        re, im = np.zeros(len(theta[tile])), np.zeros(len(theta[tile]))
        for l, row in spin_rows(s, m, len(a) - 1, theta[tile]):  # noqa: E741
            if a[l]:
                re += a[l].real * row
                im += a[l].imag * row
        out[tile] = re + 1j * im
    return out


def analysed_spin_order(s: int, m: int, lmax: int, theta: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Sums of f over colatitudes with the functions of order m, of either sign, for l = 0..lmax."""
    out = np.zeros((lmax + 1, 2))
    for tile in _tiles(theta):
        side = np.stack([f[tile].real, f[tile].imag], axis=1)
        for l, row in spin_rows(s, m, lmax, theta[tile]):  # noqa: E741
            out[l] += row @ side
    return out[:, 0] + 1j * out[:, 1]


def _frame(**columns) -> pd.DataFrame:
    return pd.DataFrame(columns)


def _pair_to_rings(pair: DataFrame, nside: int, spin: int) -> DataFrame:
    """Fourier sums (ring, m, re, im) of q + iu, orders of both signs."""
    z, s, _, _ = _rings(nside)
    theta = np.arctan2(s, z)

    def along_meridians(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m, own in rows.groupby("m"):
            at, top = own["l"].to_numpy(), int(own["l"].max())
            g, c = np.zeros(top + 1, complex), np.zeros(top + 1, complex)
            g[at] = own["g_re"].to_numpy() + 1j * own["g_im"].to_numpy()
            c[at] = own["c_re"].to_numpy() + 1j * own["c_im"].to_numpy()
            sides = [(m, g + 1j * c)] + ([(-m, (-1) ** m * (g.conj() + 1j * c.conj()))] if m else [])
            for order, a in sides:
                b = -synthesised_spin_order(spin, int(order), a, theta)
                out.append(_frame(ring=np.arange(1, 4 * nside), m=order, re=b.real, im=b.imag))
        return pd.concat(out)

    return pair.groupBy(_block("m", ORDER_BLOCK)).applyInPandas(along_meridians, SUMS)


def _pair_to_degrees(sums: DataFrame, nside: int, spin: int, lmax: int) -> DataFrame:
    z, s, _, _ = _rings(nside)
    theta = np.arctan2(s, z)

    def along_meridians(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m, own in rows.groupby(rows["m"].abs()):
            a = {}
            for order in {m, -m}:
                side = own[own["m"] == order]
                a[order] = analysed_spin_order(spin, int(order), lmax, theta[side["ring"].to_numpy() - 1], _complex(side)) * (np.pi / (3 * nside * nside))
            other = (-1) ** m * a[-m].conj()
            g, c = -(a[m] + other) / 2, 1j * (a[m] - other) / 2
            out.append(_frame(l=np.arange(lmax + 1), m=m, g_re=g.real, g_im=g.imag, c_re=c.real, c_im=c.imag)[m:])
        return pd.concat(out)

    return sums.groupBy(_block("m", ORDER_BLOCK)).applyInPandas(along_meridians, PAIR)


def _pair_along_rings(rows: DataFrame, nside: int, mmax: int) -> DataFrame:
    _, _, size, first = _rings(nside)
    m = np.arange(-mmax, mmax + 1)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ring, own in rows.groupby("ring"):
            values = np.zeros(int(size[ring - 1]), complex)
            values[own["place"].to_numpy()] = (own["q"].to_numpy() + 1j * own["u"].to_numpy()) * own["weight"].to_numpy()
            f = _fourier(values, m, first[ring - 1])
            out.append(_frame(ring=ring, m=m, re=f.real, im=f.imag))
        return pd.concat(out)

    return rows.groupBy(_block("ring", RING_BLOCK)).applyInPandas(summed, SUMS)


def _pair_residual_along_rings(sums: DataFrame, rows: DataFrame, nside: int, mmax: int) -> DataFrame:
    _, _, size, first = _rings(nside)
    m = np.arange(-mmax, mmax + 1)

    def summed(model: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out, held = [_frame(ring=[], m=[], re=[], im=[])], dict(list(rows.groupby("ring")))
        for ring, own in model.groupby("ring"):
            rest = -_ring_values(own["m"].to_numpy(), _complex(own), int(size[ring - 1]), first[ring - 1])
            if ring in held:
                place = held[ring]["place"].to_numpy()
                rest[place] += held[ring]["q"].to_numpy() + 1j * held[ring]["u"].to_numpy()
                rest[place] *= held[ring]["weight"].to_numpy()
            f = _fourier(rest, m, first[ring - 1])
            out.append(_frame(ring=ring, m=m, re=f.real, im=f.imag))
        return pd.concat(out[1:] or out)

    return sums.groupBy(_block("ring", RING_BLOCK)).cogroup(rows.groupBy(_block("ring", RING_BLOCK))).applyInPandas(summed, SUMS)


def alm2map_spin(pair: DataFrame, nside: int, spin: int) -> DataFrame:
    """(ipix, q, u): the two maps of a pair of coefficient tables, RING order."""
    _, _, size, first = _rings(nside)
    starts = np.cumsum(size) - size

    def along_rings(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ring, own in rows.groupby("ring"):
            n = int(size[ring - 1])
            f = _ring_values(own["m"].to_numpy(), _complex(own), n, first[ring - 1])
            out.append(_frame(ipix=starts[ring - 1] + np.arange(n), q=f.real, u=f.imag))
        return pd.concat(out)

    return _pair_to_rings(pair, nside, spin).groupBy(_block("ring", RING_BLOCK)).applyInPandas(along_rings, "ipix long, q double, u double")


def map2alm_spin(sky: DataFrame, nside: int, spin: int, lmax: int | None = None, mmax: int | None = None, iter: int = 0, **quadrature) -> DataFrame:
    """The pair of coefficient tables of maps (ipix, q, u), RING order; bad and absent pixels count as 0.

    ``iter`` times the residuals' coefficients are added; cuts and weights as for ``map2alm``.
    """
    lmax = 3 * nside - 1 if lmax is None else lmax
    mmax = lmax if mmax is None else min(mmax, lmax)
    rows = settled(by_ring(sky, nside, ["q", "u"], **quadrature))
    pair = _pair_to_degrees(_pair_along_rings(rows, nside, mmax), nside, spin, lmax)
    if not iter:
        return pair
    pair = settled(pair)
    for _ in range(iter):
        more = _pair_to_degrees(_pair_residual_along_rings(_pair_to_rings(pair, nside, spin), rows, nside, mmax), nside, spin, lmax)
        pair = settled(pair.unionAll(more).groupBy("l", "m").agg(*[F.sum(c).alias(c) for c in pair.columns[2:]]))
    return pair


def map2alm_pol(sky: DataFrame, nside: int, lmax: int | None = None, iter: int | None = None, mmax: int | None = None, **quadrature) -> tuple[DataFrame, DataFrame]:
    """Coefficients of temperature, and the pair (g gradient, c curl) of polarisation, of maps (ipix, i, q, u).

    Iterations, cuts and weights as for ``map2alm``.
    """
    iter = (3 if quadrature.get("pixels") is None else 0) if iter is None else iter
    pair = map2alm_spin(sky, nside, 2, lmax, mmax, iter, **quadrature)
    return map2alm(sky.select("ipix", F.col("i").alias("value")), nside, lmax, mmax, iter, **quadrature), pair


#: The order in which spectra are counted off.
SPECTRA = ("tt", "ee", "bb", "te", "eb", "tb")


def spectra(alm: DataFrame, pair: DataFrame, alm2: DataFrame | None = None, pair2: DataFrame | None = None, nspec: int | None = None) -> DataFrame:
    """(l, tt, ee, bb, te, eb, tb): the spectra of temperature and polarisation, or the cross spectra of two sets; the first ``nspec`` of them.

    One join of both tables on (l, m), then one aggregation by degree. A cross
    spectrum between two kinds is the mean of both ways.
    """
    def all_three(t: DataFrame, p: DataFrame) -> DataFrame:
        c = {"t_re": "re", "t_im": "im"}
        t = t.select("l", "m", *[F.col(v).alias(k) for k, v in c.items()])
        return t.join(p.select("l", "m", *[F.col(f"{a}_{b}").alias(f"{k}_{b}") for k, a in (("e", "g"), ("b", "c")) for b in ("re", "im")]), ["l", "m"], "full")

    one = all_three(alm, pair)
    names = [c for c in one.columns if c not in ("l", "m")]
    if alm2 is None:
        both = one.select("*", *[F.col(c).alias("x" + c) for c in names])
    else:
        both = one.join(all_three(alm2, pair2).withColumnsRenamed({c: "x" + c for c in names}), ["l", "m"])
    value = lambda c: F.coalesce(c, F.lit(0.0))
    product = lambda a, b: value(f"{a}_re") * value(f"x{b}_re") + value(f"{a}_im") * value(f"x{b}_im")
    twice = F.when(F.col("m") == 0, 1.0).otherwise(2.0) / (2 * F.col("l") + 1)
    shown = SPECTRA[: len(SPECTRA) if nspec is None else nspec]
    return both.groupBy("l").agg(*[F.sum(twice * (product(a, b) + product(b, a)) / 2).alias(a + b) for a, b in shown])


def anafast_pol(sky: DataFrame, nside: int, other: DataFrame | None = None, lmax: int | None = None, iter: int | None = None, nspec: int | None = None, **quadrature) -> DataFrame:
    """(l, tt, ee, bb, te, eb, tb) of maps (ipix, i, q, u), or the cross spectra with another set. Options as for ``map2alm``."""
    first = map2alm_pol(sky, nside, lmax, iter, **quadrature)
    second = (None, None) if other is None else map2alm_pol(other, nside, lmax, iter, **quadrature)
    return spectra(*first, *second, nspec=nspec)


def alm2map_pol(alm: DataFrame, pair: DataFrame, nside: int) -> DataFrame:
    """(ipix, i, q, u) of coefficients of temperature and polarisation."""
    return alm2map(alm, nside).withColumnRenamed("value", "i").join(alm2map_spin(pair, nside, 2), "ipix")


def pair_times(pair: DataFrame, window: DataFrame) -> DataFrame:
    """Both tables of a pair times a window (l, fl); 0 beyond it."""
    f = F.coalesce(F.col("fl"), F.lit(0.0))
    return pair.join(window.select("l", "fl"), "l", "left").select("l", "m", *[(F.col(c) * f).alias(c) for c in ("g_re", "g_im", "c_re", "c_im")])


def smoothed_pol(alm: DataFrame, pair: DataFrame, lmax: int, fwhm: float = 0.0, beam_window: DataFrame | None = None, pixwin: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Temperature and pair times a Gaussian beam, or that of a table (l, t, e), and times a pixel window (l, t, p)."""
    spark = alm.sparkSession
    t, e = (transfer(spark, lmax, windows_of(spark, lmax, c, fwhm, beam_window, pixwin), []) for c in "te")
    return almxfl(alm, t), pair_times(pair, e)


def smoothing_pol(sky: DataFrame, nside: int, fwhm: float = 0.0, lmax: int | None = None, iter: int | None = None, beam_window: DataFrame | None = None, nest: bool = False, **quadrature) -> DataFrame:
    """Maps (ipix, i, q, u) convolved as ``smoothing`` does one; bad pixels of each stay bad (null)."""
    lmax = 3 * nside - 1 if lmax is None else lmax
    names = ["i", "q", "u"]
    ring = sky.select(P.nest2ring(nside, "ipix").alias("ipix"), *names) if nest else sky.select("ipix", *names)
    alm, pair = smoothed_pol(*map2alm_pol(ring, nside, lmax, iter, **quadrature), lmax, fwhm, beam_window)
    smooth = alm2map_pol(alm, pair, nside).withColumnsRenamed({c: c + "2" for c in names})
    smooth = smooth.withColumn("ipix", P.ring2nest(nside, "ipix")) if nest else smooth
    bad = lambda c: F.col(c).isNull() | mask_bad(c)
    return sky.join(smooth, "ipix").select("ipix", *[F.when(~bad(c), F.col(c + "2")).alias(c) for c in names])


def synfast_pol(cl: DataFrame, nside: int, seed: int = 0, fwhm: float = 0.0, pixwin: DataFrame | None = None) -> DataFrame:
    """(ipix, i, q, u): random maps with spectra (l, tt, ee, bb, te), smoothed by a beam and by a pixel window (l, t, p)."""
    lmax = cl.agg(F.max("l")).first()[0] or 0
    return alm2map_pol(*smoothed_pol(*synalm_pol(cl, seed), lmax, fwhm, None, pixwin), nside)


def harmonic_ud_grade_pol(sky: DataFrame, nside: int, nside_out: int, fwhm_out: float | None = None, iter: int | None = None, lmax: int | None = None, fwhm_in: float = 0.0, beam_in: DataFrame | None = None, beam_out: DataFrame | None = None, pixwin_in: DataFrame | None = None, pixwin_out: DataFrame | None = None, **quadrature) -> DataFrame:
    """``harmonic_ud_grade`` of maps (ipix, i, q, u): tables of beams have (l, t, e), those of pixel windows (l, t, p)."""
    lmax = min(3 * nside_out - 1, 3 * nside - 1) if lmax is None else lmax
    fwhm_out = effective_resolution_fwhm(nside_out) if fwhm_out is None else fwhm_out
    spark = sky.sparkSession
    t, e = (transfer(spark, lmax, windows_of(spark, lmax, c, fwhm_out, beam_out, pixwin_out), windows_of(spark, lmax, c, fwhm_in, beam_in, pixwin_in)) for c in "te")
    alm, pair = map2alm_pol(sky, nside, lmax, iter, **quadrature)
    return alm2map_pol(almxfl(alm, t), pair_times(pair, e), nside_out)


def alm2map_der1(alm: DataFrame, nside: int) -> DataFrame:
    """(ipix, value, d_theta, d_phi): the map, its derivative by theta, and that by phi over sin(theta)."""
    rise = F.sqrt((F.col("l") * (F.col("l") + 1)).cast("double"))
    pair = alm.select("l", "m", (F.col("re") * rise).alias("g_re"), (F.col("im") * rise).alias("g_im"), F.lit(0.0).alias("c_re"), F.lit(0.0).alias("c_im"))
    slope = alm2map_spin(pair, nside, 1).withColumnsRenamed({"q": "d_theta", "u": "d_phi"})
    return alm2map(alm, nside).join(slope, "ipix")


# --- rotation of coefficients ----------------------------------------------
def zyz_of(matrix) -> tuple[float, float, float]:
    """psi, theta, phi of a matrix: about z, then y, then z, all fixed axes."""
    r = np.asarray(matrix, float)
    theta = math.atan2(math.hypot(r[0, 2], r[1, 2]), r[2, 2])
    if math.hypot(r[0, 2], r[1, 2]) < 1e-14:
        return math.copysign(1, r[2, 2]) * math.atan2(r[1, 0], r[1, 1]), theta, 0.0
    return math.atan2(r[2, 1], -r[2, 0]), theta, math.atan2(r[1, 2], r[0, 2])


#: Orders on each side of a tile of Wigner functions.
ORDER_TILE = 256


def _wigner_starts(k: np.ndarray, m: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first degree, sign, logarithm) of the first of Wigner's functions of orders k (rows) and m (columns)."""
    k, m = np.broadcast_arrays(k[:, None], m[None, :])
    low = np.maximum(np.abs(k), np.abs(m))
    by_row = np.abs(k) == low  # the order that has the degree's greatest magnitude; the other one is a
    a, top = np.where(by_row, m, k), np.where(by_row, k, m)
    up = top >= 0
    cos_power, sin_power = np.where(up, low + a, low - a), np.where(up, low - a, low + a)
    sign = np.where((by_row & up) | (~by_row & ~up), np.where((low + a) % 2, -1.0, 1.0), 1.0)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * int(low.max(initial=0)) + 1)))])
    start = 0.5 * (log_factorial[2 * low] - log_factorial[low + a] - log_factorial[low - a])
    for base, power in ((math.cos(theta / 2), cos_power), (math.sin(theta / 2), sin_power)):
        log = math.log(abs(base)) if abs(base) > 1e-300 else -np.inf
        start = start + np.multiply(power, log, out=np.zeros(power.shape), where=power > 0)
        sign = sign * np.where(power % 2, math.copysign(1, base), 1.0)
    return low, sign, start


def turned_tile(a: np.ndarray, k: np.ndarray, m: np.ndarray, theta: float) -> np.ndarray:
    """(degrees, k): what coefficients ``a`` (degrees from 0, m) of orders m, of either sign, give to orders k in a turn about y.

    Wigner's functions of the tile go from degree to degree by their recursion,
    started in logarithms; two degrees of the tile are held.
    """
    low, sign, start = _wigner_starts(k, m, theta)
    z, out = math.cos(theta), np.zeros((len(a), len(k)), complex)
    never = np.isneginf(start)
    scale = np.where((start < -600) & ~never, start, 0.0)  # values are now * exp(scale)
    begin = np.where(never, 0.0, sign * np.exp(np.where(never, 0.0, start - scale)))
    now, before, small = np.zeros(low.shape), np.zeros(low.shape), scale < 0
    waiting = bool(small.any())
    km, kk, mm = k[:, None] * m[None, :].astype(float), (k * k)[:, None].astype(float), (m * m)[None, :].astype(float)
    for l in range(int(low.min()), len(a)):  # noqa: E741
        if l > 0:
            n = l - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                following = (z - (km / (n * l) if n else 0.0)) * now
                if n:
                    following -= np.sqrt(np.maximum(0.0, (n * n - kk) * (n * n - mm))) / (n * (2 * n + 1)) * before
                following *= (2 * n + 1) * l / np.sqrt((l * l - kk) * (l * l - mm))
            before, now = now, np.where(low < l, following, 0.0)
        fresh = low == l
        now[fresh] = begin[fresh]
        if waiting:
            big = small & (np.abs(now) > 1e100)
            if big.any():
                now[big] *= 1e-100
                before[big] *= 1e-100
                scale[big] += 100 * math.log(10)
                done = big & (scale > -600)
                now[done] *= np.exp(scale[done])
                before[done] *= np.exp(scale[done])
                scale[done] = 0
                small = scale < 0
                waiting = bool(small.any())
        used = np.where(small, 0.0, now) if waiting else now
        out[l].real, out[l].imag = used @ a[l].real, used @ a[l].imag
    return out


def rotate_alm(alm: DataFrame, psi: float = 0.0, theta: float = 0.0, phi: float = 0.0, matrix=None) -> DataFrame:
    """Coefficients of the actively rotated field, angles in radians about z, y, z; all orders 0..l come out.

    A group is a tile: the coefficients of ``ORDER_TILE`` orders, and what they
    give to as many others; parts are summed by (l, m). A task holds two degrees
    of the tile's Wigner functions and the tile's coefficients, some 150 MB at
    l = 6,143; coefficients are sent once for each tile of other orders.
    """
    if matrix is not None:
        psi, theta, phi = zyz_of(matrix)
    top = alm.agg(F.max("l")).first()[0]
    if top is None:
        return alm.select("l", "m", "re", "im")

    def turned(rows: pd.DataFrame) -> pd.DataFrame:
        first, lmax = int(rows["to"].iloc[0]) * ORDER_TILE, int(rows["l"].max())
        k = np.arange(first, min(first + ORDER_TILE, lmax + 1))
        own = np.sort(rows["m"].unique())
        m = np.concatenate([own, -own[own > 0]])
        a, l, at = np.zeros((lmax + 1, len(m)), complex), rows["l"].to_numpy(), np.searchsorted(own, rows["m"].to_numpy())  # noqa: E741
        a[l, at] = _complex(rows)
        if len(own) and own[0] == 0:
            a[:, 0].imag = 0
        positive = own > 0
        a[:, len(own) :] = np.where(own[positive] % 2, -1.0, 1.0) * a[:, : len(own)][:, positive].conj()
        a *= np.exp(-1j * m * psi)
        out = turned_tile(a, k, m, theta) * np.exp(-1j * k * phi)
        l, j = np.nonzero(k[None, :] <= np.arange(lmax + 1)[:, None])  # noqa: E741
        return _frame(l=l, m=k[j], re=out[l, j].real, im=out[l, j].imag)

    tiles = F.sequence(F.lit(0), F.floor(F.col("l") / ORDER_TILE).cast("int"))
    rows = alm.select("l", "m", "re", "im", F.floor(F.col("m") / ORDER_TILE).alias("of"), F.explode(tiles).alias("to"))
    return rows.groupBy("of", "to").applyInPandas(turned, ALM).groupBy("l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def rotate_pair(pair: DataFrame, psi: float = 0.0, theta: float = 0.0, phi: float = 0.0, matrix=None) -> DataFrame:
    """Both tables of a pair turned as scalars are."""
    g, c = [rotate_alm(pair.select("l", "m", F.col(k + "_re").alias("re"), F.col(k + "_im").alias("im")), psi, theta, phi, matrix).withColumnsRenamed({"re": k + "_re", "im": k + "_im"}) for k in "gc"]
    return g.join(c, ["l", "m"])


def rotate_map_alms(sky: DataFrame, nside: int, rotator, lmax: int | None = None, iter: int = 3) -> DataFrame:
    """A map in another frame by way of its coefficients."""
    return alm2map(rotate_alm(map2alm(sky, nside, lmax, iter=iter), matrix=rotator.matrix), nside)


def rotate_map_polarised(sky: DataFrame, nside: int, rotator) -> DataFrame:
    """Maps (ipix, q, u[, i]) in another frame, interpolated; the polarisation turns with the meridians."""
    grid = sky.sparkSession.range(12 * nside * nside).select(F.col("id").alias("pixel"), P.pix2ang(nside, "id").alias("a"))
    points = settled(grid.select("pixel", rotator.inverse.direction(F.col("a.theta"), F.col("a.phi")).alias("d")).select("pixel", "d.*"))
    parts = [interpolate(points, sky.select("ipix", F.col(c).alias("value")), nside, "pixel", "theta", "phi").withColumnRenamed("value", c) for c in ("i", "q", "u") if c in sky.columns]
    joined = reduce(lambda x, y: x.join(y, "pixel"), parts, points.withColumn("turn", rotator.angle_ref("theta", "phi") * 2))
    c, s = F.cos("turn"), F.sin("turn")
    kept = ["i"] if "i" in sky.columns else []
    return joined.select(F.col("pixel").alias("ipix"), *kept, (F.col("q") * c - F.col("u") * s).alias("q"), (F.col("q") * s + F.col("u") * c).alias("u"))


# --- beams and spectra -----------------------------------------------------
def blm_gauss(spark: SparkSession, fwhm: float, lmax: int, pol: bool = False) -> DataFrame:
    """(comp, l, m, re, im) of a Gaussian beam on the pole; component 0, and 1 and 2 of order 2 if polarised."""
    if pol and lmax < 2:
        raise ValueError("lmax value too small")
    l = F.col("id").cast("double")  # noqa: E741
    fall = F.exp(l * (l + 1) * (-0.5 * fwhm * fwhm / (8 * math.log(2))))
    base, degree = spark.range(lmax + 1), F.col("id").cast("int").alias("l")
    rows = lambda comp, m, re, im: base.where(F.col("id") >= m).select(F.lit(comp).alias("comp"), degree, F.lit(m).alias("m"), re.alias("re"), im.alias("im"))
    out, none = rows(0, 0, F.sqrt((l * 2 + 1) / (4 * math.pi)) * fall, F.lit(0.0)), F.lit(0.0)
    if pol:
        tilt = F.sqrt((l * 2 + 1) / (32 * math.pi)) * fall
        out = out.unionAll(rows(1, 2, tilt, none)).unionAll(rows(2, 2, none, tilt))
    return out


def _legendre_rows(lmax: int, x: np.ndarray):
    """P_l(x) for l = 0..lmax in turn."""
    before, now = np.zeros_like(x), np.ones_like(x)
    for l in range(lmax + 1):  # noqa: E741
        yield l, now
        before, now = now, ((2 * l + 1) * x * now - l * before) / (l + 1)


def bl2beam(window: DataFrame, angles: DataFrame) -> DataFrame:
    """(theta, beam): the profile at the angles of table (theta) of a window (l, bl), a row per degree."""
    b = {r.l: r.bl for r in window.select("l", "bl").collect()}  # bounded by lmax

    def profile(batches):
        for rows in batches:
            theta, total = rows["theta"].to_numpy(), np.zeros(len(rows))
            for l, p in _legendre_rows(max(b, default=-1), np.cos(theta)):  # noqa: E741
                total += (b.get(l) or 0.0) * (2 * l + 1) / (4 * np.pi) * p
            yield _frame(theta=theta, beam=total)

    return angles.select("theta").mapInPandas(profile, "theta double, beam double")


def beam2bl(profile: DataFrame, lmax: int) -> DataFrame:
    """(l, bl): the window of a profile (theta, beam), by the trapezoidal rule; partial sums before the shuffle."""
    from pyspark.sql import Window

    order = Window.orderBy("theta")
    before, after = F.coalesce(F.lag("theta").over(order), F.col("theta")), F.coalesce(F.lead("theta").over(order), F.col("theta"))
    rows = profile.select("theta", (F.col("beam") * F.sin("theta") * (after - before) * math.pi).alias("w"))

    def parts(batches):
        for rows in batches:
            w = rows["w"].to_numpy()
            yield _frame(l=np.arange(lmax + 1), bl=[float(w @ p) for _, p in _legendre_rows(lmax, np.cos(rows["theta"].to_numpy()))])

    return rows.mapInPandas(parts, "l int, bl double").groupBy("l").agg(F.sum("bl").alias("bl"))


def synalm_pol(cl: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Random coefficients with spectra (l, tt, ee, bb, te): of temperature, and the pair of polarisation.

    A degree's 3 x 3 factor is written out; a pivot that isn't positive counts as 0.
    """
    c = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("tt", "ee", "bb", "te")}
    t = F.sqrt(F.greatest(c["tt"], F.lit(0.0)))
    cross = F.when(t > 0, c["te"] / t).otherwise(F.lit(0.0))
    rows = cl.select("l", t.alias("t"), cross.alias("x"), F.sqrt(F.greatest(c["ee"] - cross * cross, F.lit(0.0))).alias("e"), F.sqrt(F.greatest(c["bb"], F.lit(0.0))).alias("b"), F.explode(F.sequence(F.lit(0), F.col("l").cast("int"))).alias("m"))
    re, im = F.when(F.col("m") == 0, 1.0).otherwise(math.sqrt(0.5)), F.when(F.col("m") == 0, 0.0).otherwise(math.sqrt(0.5))
    drawn = rows.select("*", *[(w * n).alias(f"{p}{k}") for k in range(3) for p, w, n in zip(("re", "im"), (re, im), normals(seed, k), strict=True)])
    mixed = lambda p: F.col("x") * F.col(p + "0") + F.col("e") * F.col(p + "1")
    pair = drawn.select("l", "m", mixed("re").alias("g_re"), mixed("im").alias("g_im"), (F.col("b") * F.col("re2")).alias("c_re"), (F.col("b") * F.col("im2")).alias("c_im"))
    return drawn.select("l", "m", (F.col("t") * F.col("re0")).alias("re"), (F.col("t") * F.col("im0")).alias("im")), pair


def by_rows(count: int) -> list[int]:
    """Places of spectra kept by diagonals (TT EE BB TE EB TB) in the order by rows (TT TE TB EE EB BB)."""
    n = int((math.sqrt(8 * count + 1) - 1) / 2)
    if n * (n + 1) // 2 != count:
        raise ValueError("there must be n(n + 1)/2 spectra")
    start = [d * n - d * (d - 1) // 2 for d in range(n)]
    return [start[j - i] + i for i in range(n) for j in range(i, n)]
