"""Maps as DataFrames (ipix, value): order, resolution, masks, interpolation, monopole and dipole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.functions.pixel import UNSEEN

from . import blocks


def mask_bad(value, bad: float = UNSEEN, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether a value is the bad one; NaN is neither bad nor good."""
    v = P.col(value)
    return ~F.isnan(v) & (F.abs(v - bad) <= atol + rtol * abs(bad))


def mask_good(value, bad: float = UNSEEN, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    v = P.col(value)
    return ~F.isnan(v) & (F.abs(v - bad) > atol + rtol * abs(bad))


def unseen_to_null(value) -> Column:
    return F.when(~mask_bad(value), P.col(value))


def null_to_unseen(value) -> Column:
    return F.coalesce(P.col(value), F.lit(UNSEEN))


def fields_of(sky: DataFrame) -> list[str]:
    """The names of a map's values; several stand for as many maps."""
    return [c for c in sky.columns if c != "ipix"]


def nside_of(sky: DataFrame, partial: bool = False) -> int:
    """The size of a map from its pixels: all must be there, each once, or with ``partial`` the least power of two that has the greatest of them.

    One row reaches the driver.  An error if a full map's pixels don't make up a sky.
    """
    n, distinct, last = sky.agg(F.count("ipix"), F.count_distinct("ipix"), F.max("ipix")).first()
    if partial:
        nside = 1
        while 12 * nside * nside <= (last or 0):
            nside *= 2
        return checked_nside(nside)
    nside = int(round((n / 12) ** 0.5))
    if not n or n != distinct or 12 * nside * nside != n or last != n - 1:
        raise ValueError(f"{n} pixels up to {last} make up no sky")
    return checked_nside(nside)


def size_of(sky: DataFrame, partial: bool = False) -> int:
    """How many pixels a map's sky has."""
    return 12 * nside_of(sky, partial) ** 2


def checked_nside(nside: int, nest: bool = False) -> int:
    """The size itself; an error if it isn't one (for NEST: no power of two) or is beyond 2 ** 29."""
    if nside != int(nside) or nside < 1 or (nest and int(nside) & (int(nside) - 1)):
        raise ValueError(f"{nside} is no size of a map")
    if nside > 1 << 29:
        raise ValueError(f"{nside} is beyond 2 ** 29")
    return int(nside)


def value_range(sky: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """(low, high): one row, the limits of good, finite values, or those given; a limit that would pass the other is set to it."""
    good = F.when(mask_good("value") & (F.abs("value") < float("inf")), F.col("value"))
    found = sky.agg(F.min(good).alias("low"), F.max(good).alias("high"))
    low_, high_ = (F.col("low") if low is None else F.lit(float(low))), (F.col("high") if high is None else F.lit(float(high)))
    return found.select(low_.alias("low"), high_.alias("high")).select(F.least("low", "high").alias("low") if low is None else F.col("low"), F.greatest("low", "high").alias("high") if high is None else F.col("high"))


def pixelise(points: DataFrame, nside: int, pix: Column, value: str) -> DataFrame:
    """(ipix, hits, mean): partial sums before the only shuffle, which moves a row per pixel and task."""
    return points.select(pix.alias("ipix"), value).groupBy("ipix").agg(F.count("*").alias("hits"), F.avg(value).alias("mean"))


def reorder(sky: DataFrame, nside: int, to_nest: bool) -> DataFrame:
    """The map in the other scheme: a projection, no join and no shuffle."""
    return sky.withColumn("ipix", (P.ring2nest if to_nest else P.nest2ring)(nside, "ipix"))


def degrade(sky: DataFrame, nside: int, nside_out: int, nest: bool = False, pessimistic: bool = False, power: float | None = None) -> DataFrame:
    """(ipix, value): the mean of each large pixel's good ones; null where none (pessimistic: where not all) is good."""
    step = 2 * int(round(np.log2(nside // nside_out)))
    parent = F.shiftright(P.col("ipix") if nest else P.ring2nest(nside, "ipix"), step)
    good = mask_good("value") & (F.abs("value") < float("inf"))
    agg = sky.groupBy(parent.alias("parent")).agg(F.sum(F.when(~mask_bad("value"), F.col("value"))).alias("total"), F.count(F.when(good, 1)).alias("n"))
    enough = F.col("n") == (1 << step) if pessimistic else F.col("n") > 0
    mean = F.col("total") / F.col("n") * (float(nside_out) / nside) ** power if power else F.col("total") / F.col("n")
    return agg.select((F.col("parent") if nest else P.nest2ring(nside_out, "parent")).alias("ipix"), F.when(enough, mean).alias("value"))


def upgrade(sky: DataFrame, nside: int, nside_out: int, nest: bool = False, power: float | None = None) -> DataFrame:
    """(ipix, value): each pixel's value for its parts."""
    step = 2 * int(round(np.log2(nside_out // nside)))
    first = F.shiftleft(P.col("ipix") if nest else P.ring2nest(nside, "ipix"), step)
    value = F.col("value") * (float(nside_out) / nside) ** power if power else F.col("value")
    parts = sky.select(F.explode(F.sequence(first, first + (1 << step) - 1)).alias("part"), value.alias("value"))
    return parts.select((F.col("part") if nest else P.nest2ring(nside_out, "part")).alias("ipix"), "value")


def ud_grade(sky: DataFrame, nside: int, nside_out: int, nest: bool = False, pessimistic: bool = False, power: float | None = None) -> DataFrame:
    if nside_out == nside:
        return sky
    return upgrade(sky, nside, nside_out, nest, power) if nside_out > nside else degrade(sky, nside, nside_out, nest, pessimistic, power)


def interpolate(points: DataFrame, sky: DataFrame, nside: int, key: str, theta, phi, nest: bool = False) -> DataFrame:
    """(key, value): bilinear interpolation at points, a row for each, keys repeated or not; null where a pixel with weight is absent.

    A point meets one of its four pixels, whose row holds the values around it
    (``blocks.patches``), so one row a point is shuffled. Sizes that
    are no powers of two have no blocks: there each point meets its four pixels.
    """
    blocked = not nside & (nside - 1)
    near = points.select(key, P.interp_weights(nside, theta, phi, nest and not blocked).alias("w"))
    if not blocked:
        near = near.select(key, F.monotonically_increasing_id().alias("_point"), "w").select(key, "_point", F.inline("w")).select(key, "_point", F.col("pix").alias("ipix"), "weight")
        joined = near.join(sky.select("ipix", "value"), "ipix", "left")
        complete = F.count(F.when(F.col("value").isNotNull() | (F.col("weight") == 0), 1)) == 4
        return joined.groupBy("_point", key).agg(F.when(complete, F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0)))).alias("value")).drop("_point")
    joined = near.select(key, "w", blocks.patch_of(nside, F.col("w")).alias("ipix")).join(blocks.patches(sky, nside, nest), "ipix", "left")
    part = lambda p: F.when(p["weight"] == 0, 0.0).otherwise(p["weight"] * F.get("val", F.array_position("pix", p["pix"]) - 1))
    return joined.select(key, F.aggregate(F.transform("w", part), F.lit(0.0), lambda a, b: a + b).alias("value"))


def _fitted(sky: DataFrame, nside: int, nest: bool, cut: float) -> DataFrame:
    good = sky.where(F.col("value").isNotNull() & (F.col("value") != UNSEEN) & ~F.isnan("value") & (F.abs("value") < float("inf")))
    vectors = good.select("value", P.pix2vec(nside, "ipix", nest).alias("v")).select("value", "v.*")
    return vectors.where(F.abs("z") >= float(np.sin(np.radians(cut)))) if cut else vectors


def dipole_moments(sky: DataFrame, nside: int, nest: bool = False, gal_cut: float = 0.0) -> DataFrame:
    """One row: the ten distinct sums of the normal matrix and the four of the right side, in one aggregation."""
    one = F.lit(1.0)
    parts = {"1": one, "x": F.col("x"), "y": F.col("y"), "z": F.col("z")}
    names = list(parts)
    sums = [F.sum(parts[a] * parts[b]).alias(f"s_{a}{b}") for i, a in enumerate(names) for b in names[i:]]
    sums += [F.sum(parts[a] * F.col("value")).alias(f"r_{a}") for a in names]
    return _fitted(sky, nside, nest, gal_cut).agg(*sums)


def fit_dipole(sky: DataFrame, nside: int, nest: bool = False, gal_cut: float = 0.0) -> tuple[float, np.ndarray]:
    """Monopole and dipole vector; one row comes to the driver."""
    row = dipole_moments(sky, nside, nest, gal_cut).first()
    names = "1xyz"
    matrix = np.array([[row[f"s_{min(a, b, key=names.index)}{max(a, b, key=names.index)}"] for b in names] for a in names], float)
    found = np.linalg.solve(matrix, [row[f"r_{a}"] for a in names])
    return float(found[0]), found[1:]


def fit_monopole(sky: DataFrame, nside: int, nest: bool = False, gal_cut: float = 0.0) -> DataFrame:
    return _fitted(sky, nside, nest, gal_cut).agg(F.avg("value").alias("monopole"))


def remove_dipole(sky: DataFrame, nside: int, nest: bool = False, gal_cut: float = 0.0) -> DataFrame:
    """The map less its monopole and dipole; bad values become null."""
    mono, (dx, dy, dz) = fit_dipole(sky, nside, nest, gal_cut)
    v = P.pix2vec(nside, "ipix", nest)
    model = P.let(v, lambda u: u["x"] * float(dx) + u["y"] * float(dy) + u["z"] * float(dz) + mono)
    return sky.withColumn("value", unseen_to_null("value") - model)


def remove_monopole(sky: DataFrame, nside: int, nest: bool = False, gal_cut: float = 0.0) -> DataFrame:
    return sky.withColumn("value", unseen_to_null("value") - fit_monopole(sky, nside, nest, gal_cut).first()[0])


def rotate_map(sky: DataFrame, nside: int, rotator) -> DataFrame:
    """A full map in another frame, interpolated at the pixels' places in the old one."""
    grid = sky.sparkSession.range(12 * nside * nside).select(F.col("id").alias("pixel"), P.pix2ang(nside, "id").alias("a"))
    old = rotator.inverse.direction(F.col("a.theta"), F.col("a.phi"))
    points = grid.select("pixel", old.alias("d")).select("pixel", "d.*")
    return interpolate(points, sky, nside, "pixel", "theta", "phi").withColumnRenamed("pixel", "ipix")


def equalised(sky: DataFrame, bins: int | None = None) -> DataFrame:
    """(ipix, value, level): good values' places in 0..1 by the cumulated histogram; null for the others.

    Bins are a twentieth of the good values' number, 5,000 at most, or that number if fewer than 3 come out.
    Only the histogram's rows are put in order.
    """
    from pyspark.sql import Window

    value = F.when(mask_good("value") & (F.abs("value") < float("inf")), F.col("value"))
    low, high, n = sky.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n:
        return sky.select("ipix", "value", F.lit(None).cast("double").alias("level"))
    bins = bins or (min(n // 20, 5000) if n // 20 >= 3 else n)
    at = F.when(value.isNotNull(), F.least(F.floor((value - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1))).cast("int")
    counts = sky.select(at.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    up_to = counts.select("bin", (F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / n).alias("level"))
    return sky.select("ipix", "value", at.alias("bin")).join(up_to, "bin", "left").select("ipix", "value", "level")
