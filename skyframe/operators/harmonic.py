"""Spherical harmonics: coefficient tables (l, m, re, im), spectra, transforms and beams.

Everything per coefficient is a column expression.  The two transforms are two
grouped stages each: Fourier sums along rings (grouped in blocks of rings) and
Legendre sums along meridians (grouped in blocks of m), with one shuffle of
rings x orders rows between them.  Legendre functions roll: a task holds two
degrees of one order over a tile of rings, whatever the resolution, and sums go
on as degrees come.  An iteration of ``map2alm`` meets the model's Fourier sums
with the map's rings in one grouped stage, so no model map is made or joined.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions import pixel as P

from ._lineage import settled
from .maps import mask_bad

RING_BLOCK, ORDER_BLOCK = 32, 8
#: Rings over which a recursion runs at once.
RING_TILE = 4096
SUMS = "ring int, m int, re double, im double"
ALM = "l int, m int, re double, im double"
#: Effective width in radians at nside 64 (160 arcmin); it goes with the pixel size.
_WIDTH_64 = math.radians(160 / 60)


# --- coefficient tables ----------------------------------------------------
def alm_index(l, m, lmax):  # noqa: E741
    l, m = P.col(l), P.col(m)  # noqa: E741
    return F.floor(m * (2 * lmax + 1 - m) / 2) + l


def alm_lm(index, lmax):
    i = P.col(index)
    m = F.ceil(((2 * lmax + 1) - F.sqrt((2 * lmax + 1) ** 2 - 8 * (i - lmax).cast("double"))) / 2)
    return P.let(m, lambda k: P.record(l=(i - F.floor(k * (2 * lmax + 1 - k) / 2)).cast("int"), m=k.cast("int")))


def alm_size(lmax: int, mmax: int | None = None) -> int:
    m = lmax if mmax is None else mmax
    return m * (2 * lmax + 1 - m) // 2 + lmax + 1


def alm_lmax(size: int, mmax: int | None = None) -> int:
    """-1 if no lmax has that many coefficients."""
    x = (-3 + math.sqrt(1 + 8 * size)) / 2 if mmax is None else (2 * size + mmax * mmax - mmax - 2) / (2 * mmax + 2)
    return int(x) if x == math.floor(x) else -1


def alm2cl(one: DataFrame, two: DataFrame | None = None) -> DataFrame:
    """(l, cl): the (cross) spectrum; orders above 0 count twice."""
    if two is None:
        rows = one.select("l", "m", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    else:
        other = two.select("l", "m", F.col("re").alias("re2"), F.col("im").alias("im2"))
        rows = one.join(other, ["l", "m"]).select("l", "m", (F.col("re") * F.col("re2") + F.col("im") * F.col("im2")).alias("p"))
    twice = F.when(F.col("m") == 0, F.col("p")).otherwise(F.col("p") * 2)
    return rows.groupBy("l").agg((F.sum(twice) / F.first(F.col("l") * 2 + 1)).alias("cl"))


def almxfl(alm: DataFrame, fl: DataFrame) -> DataFrame:
    """Coefficients times f(l) of table (l, fl), a row per degree; 0 beyond it."""
    f = F.coalesce(F.col("fl"), F.lit(0.0))
    return alm.join(fl.select("l", "fl"), "l", "left").select("l", "m", (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im"))


def resize_alm(alm: DataFrame, lmax: int, mmax: int | None = None) -> DataFrame:
    """Coefficients up to a degree and order, zeros where there were none."""
    mmax = lmax if mmax is None else mmax
    grid = alm.sparkSession.range(lmax + 1).select(F.col("id").cast("int").alias("l"))
    grid = grid.select("l", F.explode(F.sequence(F.lit(0), F.least(F.col("l"), F.lit(mmax)))).alias("m"))
    return grid.join(alm, ["l", "m"], "left").select("l", "m", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))


def gauss_beam(spark: SparkSession, fwhm: float, lmax: int = 512, pol: bool = False) -> DataFrame:
    """(l, t[, e, b, te]) of a Gaussian beam, width in radians."""
    s2 = (fwhm / math.sqrt(8 * math.log(2))) ** 2
    l = F.col("id").cast("double")  # noqa: E741
    t = F.exp(l * (l + 1) * (-0.5 * s2))
    out = [F.col("id").cast("int").alias("l"), t.alias("t")]
    if pol:
        out += [(t * math.exp(2 * s2)).alias("e"), (t * math.exp(2 * s2)).alias("b"), (t * math.exp(s2)).alias("te")]
    return spark.range(lmax + 1).select(*out)


def effective_resolution_fwhm(nside: int) -> float:
    return _WIDTH_64 * 64 / nside


def smoothalm(alm: DataFrame, fwhm: float = 0.0, spin: int = 0, beam_window: DataFrame | None = None) -> DataFrame:
    """Coefficients times a Gaussian beam's window for a spin, width in radians, or times a window (l, fl) instead."""
    if beam_window is not None:
        return almxfl(alm, beam_window)
    s2 = (fwhm / math.sqrt(8 * math.log(2))) ** 2
    f = F.exp((F.col("l") * (F.col("l") + 1) - spin * spin) * (-0.5 * s2))
    return alm.select("l", "m", (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im"))


def transfer(spark: SparkSession, lmax: int, over: list[DataFrame], under: list[DataFrame]) -> DataFrame:
    """(l, fl): the product of windows (l, fl) over that of others, in one ratio; 0 where any is absent or a divisor is 0."""
    out = spark.range(lmax + 1).select(F.col("id").cast("int").alias("l"), F.lit(1.0).alias("fl"))
    for k, window in enumerate([*over, *under]):
        own = out.join(window.select("l", F.col("fl").cast("double").alias("w")), "l", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        out = own.select("l", (F.col("fl") * F.col("w") if k < len(over) else F.when(F.col("w") != 0, F.col("fl") / F.col("w")).otherwise(0.0)).alias("fl"))
    return out


def windows_of(spark: SparkSession, lmax: int, column: str, fwhm: float, beam: DataFrame | None, pixwin: DataFrame | None) -> list[DataFrame]:
    """The windows (l, fl) of a beam (its table's column, or a Gaussian's) and of pixels, for ``column`` t or e; a pixel window calls the latter p."""
    out = []
    if beam is not None:
        out.append(beam.select("l", F.col(column).alias("fl")))
    elif fwhm:
        out.append(gauss_beam(spark, fwhm, lmax, pol=True).select("l", F.col(column).alias("fl")))
    if pixwin is not None:
        out.append(pixwin.select("l", F.col("p" if column == "e" else column).alias("fl")))
    return out


def normals(seed: int, component: int = 0):
    """Two columns of standard normal numbers for (l, m), by a digest of seed, component and both: the same however rows are dealt out."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(component)), F.col("l").cast("string"), F.col("m").cast("string")).cast("binary"))
    one, two = (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") / float(1 << 52) for at in (1, 14))
    far = F.sqrt(F.log(one + 0.5 / (1 << 52)) * -2.0)
    return far * F.cos(two * (2 * math.pi)), far * F.sin(two * (2 * math.pi))


def synalm(cl: DataFrame, mmax: int | None = None, seed: int = 0) -> DataFrame:
    """Random coefficients with spectrum (l, cl); null and negative cl count as 0. A seed gives the same ones on any cluster."""
    top = F.col("l") if mmax is None else F.least("l", F.lit(mmax))
    rows = cl.select("l", F.sqrt(F.greatest(F.coalesce("cl", F.lit(0.0)), F.lit(0.0))).alias("a"), F.explode(F.sequence(F.lit(0), top.cast("int"))).alias("m"))
    half, (re, im) = F.when(F.col("m") == 0, 1.0).otherwise(math.sqrt(0.5)), normals(seed)
    return rows.select("l", "m", (F.col("a") * half * re).alias("re"), (F.col("a") * F.when(F.col("m") == 0, 0.0).otherwise(half) * im).alias("im"))


# --- transforms ------------------------------------------------------------
def _rings(nside: int):
    """z, sin, length and first azimuth of all rings."""
    i = np.arange(1, 4 * nside)
    near = np.minimum(np.minimum(i, 4 * nside - i), nside)
    cap = (i < nside) | (i > 3 * nside)
    t = near**2 / (3.0 * nside**2)
    z = np.where(cap, np.sign(2 * nside - i) * (1 - t), (2 * nside - i) * 2 / (3.0 * nside))
    s = np.sqrt(np.where(cap, t * (2 - t), (1 - z) * (1 + z)))
    shift = np.where(cap | ((i - nside) % 2 == 0), 0.5, 0.0)
    return z, s, 4 * near, shift * np.pi / (2 * near)


def legendre_rows(m: int, lmax: int, z: np.ndarray, s: np.ndarray):
    """(l, row) for l = m..lmax: normalised functions of order m by the three-term recursion, started in logarithms; two rows are held.

    A row may be written to once the next one is asked for.
    """
    k = np.arange(1, m + 1)
    with np.errstate(divide="ignore"):
        start = 0.5 * (np.log((2 * m + 1) / (4 * np.pi)) + np.log((2 * k - 1) / (2 * k)).sum()) + m * np.log(s)

    def following(n: int, now: np.ndarray, before: np.ndarray) -> np.ndarray:
        a = math.sqrt((4 * n * n - 1) / (n * n - m * m))
        b = math.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1)) if n > m + 1 else 0.0
        return a * (z * now - b * before)

    return _rolled(m, lmax, (-1) ** m, start, following)


def _rolled(low: int, lmax: int, sign: int, start: np.ndarray, following):
    """Rows low..lmax of a recursion whose first row is sign * exp(start); what is too small for a double counts as 0 until it has grown."""
    scale = np.where(start < -600, start, 0.0)  # values are now * exp(scale)
    now, before = sign * np.exp(start - scale), np.zeros(len(start))
    small = scale < 0
    waiting = bool(small.any())
    for l in range(low, lmax + 1):  # noqa: E741
        yield l, np.where(small, 0.0, now) if waiting else now
        if l == lmax:
            return
        before, now = now, following(l + 1, now, before)
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


def legendre(m: int, lmax: int, z: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(lmax - m + 1, rings): the rows of ``legendre_rows`` as one table."""
    return np.array([row.copy() for _, row in legendre_rows(m, lmax, z, s)])


def analysed_order(m: int, lmax: int, nside: int, f: np.ndarray) -> np.ndarray:
    """Sums over all rings of Fourier sums ``f`` with the functions of order m, for l = m..lmax.

    North and south share a row: it is even or odd by turns.
    """
    z, s, _, _ = _rings(nside)
    half, out = 2 * nside, np.zeros((lmax - m + 1, 2))
    south = np.append(f[half:][::-1], 0)
    both = [np.stack([x.real, x.imag], axis=1) for x in (f[:half] + south, f[:half] - south)]
    for at in range(0, half, RING_TILE):
        tile = slice(at, at + RING_TILE)
        if not f[tile].any() and not south[tile].any():
            continue
        sides = [np.ascontiguousarray(x[tile]) for x in both]
        for l, row in legendre_rows(m, lmax, z[:half][tile], s[:half][tile]):  # noqa: E741
            out[l - m] += row @ sides[(l - m) % 2]
    return out[:, 0] + 1j * out[:, 1]


def synthesised_order(m: int, a: np.ndarray, nside: int) -> np.ndarray:
    """What coefficients a (l = m, m + 1, ...) of order m sum to on each ring."""
    z, s, _, _ = _rings(nside)
    half = 2 * nside
    sides = np.zeros((2, 2, half))  # even and odd, real and imaginary
    for at in range(0, half, RING_TILE):
        tile = slice(at, at + RING_TILE)
        own = np.zeros((2, 2, len(z[:half][tile])))
        for l, row in legendre_rows(m, m + len(a) - 1, z[:half][tile], s[:half][tile]):  # noqa: E741
            c = a[l - m]
            if c:
                side = own[(l - m) % 2]
                side[0] += c.real * row
                side[1] += c.imag * row
        sides[:, :, tile] = own
    even, odd = sides[:, 0] + 1j * sides[:, 1]
    return np.concatenate([even + odd, (even - odd)[:-1][::-1]])


def _fourier(values: np.ndarray, m: np.ndarray, first: float) -> np.ndarray:
    """Sums of a ring's values for orders m; ``first`` is the azimuth of its first pixel."""
    return np.fft.fft(values)[m % len(values)] * np.exp(-1j * m * first)


def _ring_values(m: np.ndarray, b: np.ndarray, n: int, first: float) -> np.ndarray:
    """A ring's n complex values of sums b for orders m."""
    folded = np.zeros(n, complex)
    np.add.at(folded, m % n, b * np.exp(1j * m * first))
    return np.fft.ifft(folded) * n


def _complex(rows: pd.DataFrame) -> np.ndarray:
    return rows["re"].to_numpy() + 1j * rows["im"].to_numpy()


def _block(column: str, size: int):
    return F.floor(F.abs(column) / size).alias("block")


def good_or_zero(value):
    return F.when(P.col(value).isNull() | F.isnan(value) | mask_bad(value), 0.0).otherwise(P.col(value))


def by_ring(sky: DataFrame, nside: int, columns: list[str], gal_cut: float = 0.0, rings: DataFrame | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """(ring, place, columns, weight) of a RING map; bad pixels and those within ``gal_cut`` degrees of the equator count as 0.

    weight: 1 + w of (ring, w), north and south alike, times that of (ipix, weight); 1 where there is none.
    With weights, absent pixels come as zeros, as an iteration's residual has them.
    """
    if rings is not None or pixels is not None:
        sky = sky.sparkSession.range(12 * nside * nside).select(F.col("id").alias("ipix")).join(sky, "ipix", "left")
    values = sky.select("ipix", *[good_or_zero(c).alias(c) for c in columns], P.pix2ring(nside, "ipix").alias("ring"))
    weight = F.lit(1.0)
    if pixels is not None:
        values = values.join(pixels.select("ipix", F.col("weight").alias("of_pixel")), "ipix", "left")
        weight = weight * F.coalesce("of_pixel", F.lit(1.0))
    if rings is not None:
        values = values.withColumn("north", F.least("ring", F.lit(4 * nside) - F.col("ring")))
        values = values.join(rings.select(F.col("ring").cast("long").alias("north"), F.col("w").alias("of_ring")), "north", "left")
        weight = weight * (1 + F.coalesce("of_ring", F.lit(0.0)))
    info = P.ringinfo(nside, "ring")
    values = values.select("*", weight.alias("weight"), info.alias("info"))
    cut = F.abs(F.col("info.costheta")) < math.sin(math.radians(gal_cut)) if gal_cut else F.lit(False)
    kept = [F.when(cut, 0.0).otherwise(F.col(c)).alias(c) for c in columns]
    return values.select(F.col("ring").cast("int").alias("ring"), (F.col("ipix") - F.col("info.startpix")).cast("int").alias("place"), *kept, "weight")


def _along_rings(rows: DataFrame, nside: int, mmax: int) -> DataFrame:
    """Weighted Fourier sums (ring, m, re, im) of ``by_ring`` rows."""
    _, _, size, first = _rings(nside)
    m = np.arange(mmax + 1)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ring, own in rows.groupby("ring"):
            values = np.zeros(int(size[ring - 1]))
            values[own["place"].to_numpy()] = own["value"].to_numpy() * own["weight"].to_numpy()
            f = _fourier(values, m, first[ring - 1])
            out.append(pd.DataFrame({"ring": ring, "m": m, "re": f.real, "im": f.imag}))
        return pd.concat(out)

    return rows.groupBy(_block("ring", RING_BLOCK)).applyInPandas(summed, SUMS)


def _residual_along_rings(sums: DataFrame, rows: DataFrame, nside: int, mmax: int) -> DataFrame:
    """Weighted Fourier sums of what the model (its own sums) leaves of the map; absent pixels count as 0."""
    _, _, size, first = _rings(nside)
    m = np.arange(mmax + 1)

    def summed(model: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out, held = [pd.DataFrame({"ring": [], "m": [], "re": [], "im": []})], dict(list(rows.groupby("ring")))
        for ring, own in model.groupby("ring"):
            n, order = int(size[ring - 1]), own["m"].to_numpy()
            rest = -_ring_values(order, _complex(own) * np.where(order == 0, 1, 2), n, first[ring - 1]).real
            if ring in held:
                place = held[ring]["place"].to_numpy()
                rest[place] += held[ring]["value"].to_numpy()
                rest[place] *= held[ring]["weight"].to_numpy()
            f = _fourier(rest, m, first[ring - 1])
            out.append(pd.DataFrame({"ring": ring, "m": m, "re": f.real, "im": f.imag}))
        return pd.concat(out[1:] or out)

    return sums.groupBy(_block("ring", RING_BLOCK)).cogroup(rows.groupBy(_block("ring", RING_BLOCK))).applyInPandas(summed, SUMS)


def _to_degrees(sums: DataFrame, nside: int, lmax: int) -> DataFrame:
    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m, own in rows.groupby("m"):
            f = np.zeros(4 * nside - 1, complex)
            f[own["ring"].to_numpy() - 1] = _complex(own)
            a = analysed_order(int(m), lmax, nside, f) * (4 * np.pi / (12 * nside * nside))
            out.append(pd.DataFrame({"l": np.arange(m, lmax + 1), "m": m, "re": a.real, "im": a.imag}))
        return pd.concat(out)

    return sums.groupBy(_block("m", ORDER_BLOCK)).applyInPandas(summed, ALM)


def _to_rings(alm: DataFrame, nside: int) -> DataFrame:
    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m, own in rows.groupby("m"):
            a = np.zeros(int(own["l"].max()) - m + 1, complex)
            a[own["l"].to_numpy() - m] = _complex(own)
            b = synthesised_order(int(m), a, nside)
            out.append(pd.DataFrame({"ring": np.arange(1, 4 * nside), "m": m, "re": b.real, "im": b.imag}))
        return pd.concat(out)

    return alm.groupBy(_block("m", ORDER_BLOCK)).applyInPandas(summed, SUMS)


def map2alm_once(sky: DataFrame, nside: int, lmax: int, mmax: int) -> DataFrame:
    return _to_degrees(_along_rings(by_ring(sky, nside, ["value"]), nside, mmax), nside, lmax)


def alm2map(alm: DataFrame, nside: int, fwhm: float = 0.0, pixwin: DataFrame | None = None) -> DataFrame:
    """(ipix, value): the map of a coefficient table, RING order; smoothed by a Gaussian beam and by a pixel window (l, t) if given."""
    _, _, size, first = _rings(nside)
    alm = smoothalm(alm, fwhm) if fwhm else alm
    alm = almxfl(alm, pixwin.select("l", F.col("t").alias("fl"))) if pixwin is not None else alm
    starts = np.cumsum(size) - size

    def along_rings(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ring, own in rows.groupby("ring"):
            n, m = int(size[ring - 1]), own["m"].to_numpy()
            values = _ring_values(m, _complex(own) * np.where(m == 0, 1, 2), n, first[ring - 1]).real
            out.append(pd.DataFrame({"ipix": starts[ring - 1] + np.arange(n), "value": values}))
        return pd.concat(out)

    return _to_rings(alm, nside).groupBy(_block("ring", RING_BLOCK)).applyInPandas(along_rings, "ipix long, value double")


def map2alm(sky: DataFrame, nside: int, lmax: int | None = None, mmax: int | None = None, iter: int | None = None, gal_cut: float = 0.0, rings: DataFrame | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """(l, m, re, im) of a RING map; bad and absent pixels, and those within ``gal_cut`` degrees of the equator, count as 0.

    ``iter`` times the residual's coefficients are added: 3 times, or never
    with weights of pixels unless asked for.  ``rings`` (ring, w) and ``pixels``
    (ipix, weight) weigh the quadrature in every one of them; see ``by_ring``.
    """
    lmax = 3 * nside - 1 if lmax is None else lmax
    mmax = lmax if mmax is None else mmax
    iter = (3 if pixels is None else 0) if iter is None else iter
    rows = settled(by_ring(sky, nside, ["value"], gal_cut, rings, pixels))
    alm = settled(_to_degrees(_along_rings(rows, nside, mmax), nside, lmax))
    for _ in range(iter):
        more = _to_degrees(_residual_along_rings(_to_rings(alm, nside), rows, nside, mmax), nside, lmax)
        alm = settled(alm.unionAll(more).groupBy("l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im")))
    return alm


def unfolded_weights(folded: DataFrame, nside: int) -> DataFrame:
    """(ipix, weight) of all pixels from their folded form (index, w): a pixel's weight is 1 + w of its class.

    Pixels are alike under turns by quarters, mirrors of a quarter and of north
    and south.  Classes are numbered along each ring's half quarter, ring by
    ring from the pole to the equator; there are (3 nside + 1)(nside + 1) / 4.
    """
    spark = folded.sparkSession
    ring = np.arange(1, 2 * nside + 1)
    quarter = np.minimum(ring, nside)
    shifted = (ring < nside) | ((ring - nside) % 2 == 0)
    classes = np.where(shifted, (quarter + 1) // 2, quarter // 2 + 1)
    starts = np.cumsum(classes) - classes
    table = pd.DataFrame({"north": ring, "quarter": quarter, "shifted": shifted.astype(int), "start": starts}).astype("int64")
    grid = spark.range(12 * nside * nside).select(F.col("id").alias("ipix"), P.pix2ring(nside, "id").alias("ring"))
    grid = grid.select("ipix", F.least("ring", F.lit(4 * nside) - F.col("ring")).alias("north"), (F.col("ipix") - P.ringinfo(nside, "ring")["startpix"]).alias("place"))
    grid = grid.join(F.broadcast(spark.createDataFrame(table)), "north")  # 2 nside rows
    within = F.col("place") % F.col("quarter")
    index = F.col("start") + F.least(within, F.col("quarter") - F.col("shifted") - within)
    grid = grid.select("ipix", index.alias("index"))
    return grid.join(folded.select(F.col("index").cast("long").alias("index"), "w"), "index").select("ipix", (1 + F.col("w")).alias("weight"))


def anafast(sky: DataFrame, nside: int, other: DataFrame | None = None, lmax: int | None = None, iter: int | None = None, **options) -> DataFrame:
    """(l, cl): the spectrum of a map, or the cross spectrum of two. Options as for ``map2alm``."""
    one = map2alm(sky, nside, lmax, iter=iter, **options)
    return alm2cl(one, None if other is None else map2alm(other, nside, lmax, iter=iter, **options))


def smoothing(sky: DataFrame, nside: int, fwhm: float = 0.0, lmax: int | None = None, iter: int | None = None, beam_window: DataFrame | None = None, nest: bool = False, **quadrature) -> DataFrame:
    """The map convolved with a Gaussian beam, or with that of a window (l, fl); bad pixels stay bad (null). Options as for ``map2alm``."""
    ring = sky.select(P.nest2ring(nside, "ipix").alias("ipix"), "value") if nest else sky
    smooth = alm2map(smoothalm(map2alm(ring, nside, lmax, iter=iter, **quadrature), fwhm, beam_window=beam_window), nside).withColumnRenamed("value", "smooth")
    smooth = smooth.withColumn("ipix", P.ring2nest(nside, "ipix")) if nest else smooth
    bad = F.col("value").isNull() | mask_bad("value")
    return sky.join(smooth, "ipix").select("ipix", F.when(~bad, F.col("smooth")).alias("value"))


def synfast(cl: DataFrame, nside: int, seed: int = 0, lmax: int | None = None, mmax: int | None = None, fwhm: float = 0.0, pixwin: DataFrame | None = None) -> DataFrame:
    """(ipix, value): a random map with spectrum (l, cl) up to a degree and order. ``synalm`` with the same seed gives its coefficients."""
    cl = cl if lmax is None else cl.where(F.col("l") <= lmax)
    return alm2map(synalm(cl, mmax, seed), nside, fwhm, pixwin)


def harmonic_ud_grade(sky: DataFrame, nside: int, nside_out: int, fwhm_out: float | None = None, iter: int | None = None, lmax: int | None = None, fwhm_in: float = 0.0, beam_in: DataFrame | None = None, beam_out: DataFrame | None = None, pixwin_in: DataFrame | None = None, pixwin_out: DataFrame | None = None, **quadrature) -> DataFrame:
    """Change of resolution by way of coefficients, times what comes out over what went in, in one ratio.

    Beams are Gaussian (widths in radians; going out, that of the new pixels
    unless given) or tables (l, t); pixel windows are tables (l, t).
    """
    lmax = min(3 * nside_out - 1, 3 * nside - 1) if lmax is None else lmax
    fwhm_out = effective_resolution_fwhm(nside_out) if fwhm_out is None else fwhm_out
    spark = sky.sparkSession
    ratio = transfer(spark, lmax, windows_of(spark, lmax, "t", fwhm_out, beam_out, pixwin_out), windows_of(spark, lmax, "t", fwhm_in, beam_in, pixwin_in))
    return ud_grade_transfer(sky, nside, nside_out, ratio, lmax, iter, **quadrature)


def ud_grade_transfer(sky: DataFrame, nside: int, nside_out: int, transfer: DataFrame, lmax: int | None = None, iter: int | None = None, **quadrature) -> DataFrame:
    """Change of resolution by way of coefficients, with f(l) of table (l, fl) in one step (see ``window_ratio``)."""
    lmax = min(3 * nside_out - 1, 3 * nside - 1) if lmax is None else lmax
    return alm2map(almxfl(map2alm(sky, nside, lmax, iter=iter, **quadrature), transfer), nside_out)


def window_ratio(new: DataFrame, old: DataFrame) -> DataFrame:
    """(l, fl): a window (l, fl) over another; 0 where the old one is 0 or either is absent."""
    before = old.select("l", F.col("fl").alias("before"))
    return new.select("l", "fl").join(before, "l").select("l", F.when(F.col("before") != 0, F.col("fl") / F.col("before")).otherwise(0.0).alias("fl"))


def weighted(sky: DataFrame, nside: int, pixels: DataFrame | None = None, rings: DataFrame | None = None) -> DataFrame:
    """The map times pixel weights (ipix, weight), and 1 + w of rings (ring, w), north and south alike.

    Absent weights count as 1; ``map2alm`` takes the same tables and applies them in its iterations as well.
    """
    if pixels is not None:
        sky = sky.join(pixels.select("ipix", "weight"), "ipix", "left").select("ipix", (F.col("value") * F.coalesce("weight", F.lit(1.0))).alias("value"))
    if rings is not None:
        ring = P.pix2ring(nside, "ipix")
        at = sky.select("ipix", "value", F.least(ring, 4 * nside - ring).alias("ring"))
        sky = at.join(rings.select(F.col("ring").cast("long").alias("ring"), "w"), "ring", "left").select("ipix", (F.col("value") * (1 + F.coalesce("w", F.lit(0.0)))).alias("value"))
    return sky


def _plus(one: DataFrame, two: DataFrame, factor: float, keys: list[str], values: list[str]) -> DataFrame:
    """one + factor * two, settled."""
    other = two.select(*keys, *[F.col(v).alias(v + "_b") for v in values])
    return settled(one.join(other, keys).select(*keys, *[(F.col(v) + F.col(v + "_b") * factor).alias(v) for v in values]))


def _size(frame: DataFrame) -> float:
    """Squared length: of a map, or of coefficients with both signs of the order."""
    if "value" in frame.columns:
        return float(frame.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0)
    return float(frame.agg(F.sum((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.when(F.col("m") == 0, 1.0).otherwise(2.0))).first()[0] or 0.0)


def map2alm_lsq(sky: DataFrame, nside: int, lmax: int, mmax: int | None = None, tol: float = 1e-10, maxiter: int = 20) -> tuple[DataFrame, float, int]:
    """Coefficients whose map is nearest a full map, the relative residual and the number of steps.

    Conjugate gradients on the least-squares problem; what meets on the driver is two sums a step.
    """
    mmax = lmax if mmax is None else mmax
    transposed = lambda rest: map2alm_once(rest, nside, lmax, mmax).select("l", "m", *[(F.col(c) * (12 * nside * nside / (4 * math.pi))).alias(c) for c in ("re", "im")])
    rest = settled(sky.select("ipix", good_or_zero("value").alias("value")))
    whole = _size(rest)
    way = settled(transposed(rest))
    alm, slope, steps = way.select("l", "m", F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), _size(way), 0
    first, left = slope, whole
    while steps < maxiter and slope > (tol * tol) * first and left > (tol * tol) * whole:
        image = settled(alm2map(way, nside))
        step = slope / _size(image)
        alm = _plus(alm, way, step, ["l", "m"], ["re", "im"])
        rest = _plus(rest, image, -step, ["ipix"], ["value"])
        down = settled(transposed(rest))
        slope, before, left = _size(down), slope, _size(rest)
        way = _plus(down, way, slope / before, ["l", "m"], ["re", "im"])
        steps += 1
    return alm, math.sqrt(left / whole) if whole else 0.0, steps
