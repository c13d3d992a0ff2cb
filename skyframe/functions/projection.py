"""Image planes: from a grid cell to a direction, and from a map to a projected image."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pixel import let, record, vec2pix


def mollweide(x: Column, y: Column) -> Column:
    """Vector at plane coordinates, x in [-2, 2], y in [-1, 1]; null off the ellipse."""
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    z = (F.asin(y) + y * s) * (2 / math.pi)
    phi = F.when(s > 0, x * (math.pi / 2) / s).otherwise(F.lit(0.0))
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return F.when(x * x / 4 + y * y <= 1, record(x=r * F.cos(phi), y=r * F.sin(phi), z=z))


def gnomonic(x: Column, y: Column) -> Column:
    r = F.sqrt(x * x + y * y + 1)
    return record(x=1 / r, y=x / r, z=y / r)


def cartesian(lon: Column, lat: Column) -> Column:
    """Vector at longitude and latitude in degrees."""
    a, b = F.radians(lon), F.radians(lat)
    return record(x=F.cos(b) * F.cos(a), y=F.cos(b) * F.sin(a), z=F.sin(b))


def orthographic(x: Column, y: Column) -> Column:
    """The near half of the sky within the unit disc."""
    r2 = x * x + y * y
    return F.when(r2 <= 1, record(x=F.sqrt(F.greatest(F.lit(0.0), 1 - r2)), y=x, z=y))


def azimuthal(x: Column, y: Column, equal_area: bool = False) -> Column:
    """Equidistant from the centre up to radius pi, or of equal area up to radius 2."""
    r = F.sqrt(x * x + y * y)
    c = F.asin(F.least(F.lit(1.0), r / 2)) * 2 if equal_area else r
    s = F.when(r > 0, F.sin(c) / r).otherwise(F.lit(1.0))
    return F.when(r <= (2.0 if equal_area else math.pi), record(x=F.cos(c), y=x * s, z=y * s))


PLANES = {"mollweide": (mollweide, 2.0, 1.0), "orthographic": (orthographic, 1.0, 1.0), "azimuthal": (azimuthal, math.pi, math.pi), "lambert": (lambda x, y: azimuthal(x, y, True), 2.0, 2.0), "cartesian": (cartesian, 180.0, 90.0), "gnomonic": (gnomonic, 0.5, 0.5)}


def image_pixels(spark: SparkSession, nside: int, plane: str = "mollweide", xsize: int = 800, ysize: int = 400, rotator=None, nest: bool = False, flip: bool = True) -> DataFrame:
    """(i, j, ipix): rows and columns of an image and the pixel seen at each; null off the sky. Longitude grows leftwards unless not flipped."""
    of, w, h = PLANES[plane]
    grid = spark.range(xsize * ysize).select(F.floor(F.col("id") / xsize).cast("int").alias("i"), (F.col("id") % xsize).cast("int").alias("j"))
    x = ((F.col("j") + 0.5) / xsize * 2 - 1) * (-w if flip else w)
    y = ((F.col("i") + 0.5) / ysize * 2 - 1) * h
    v = grid.select("i", "j", of(x, y).alias("v"))
    back = rotator.inverse.vector(F.col("v")) if rotator else F.col("v")
    pix = let(back, lambda u: vec2pix(nside, u["x"], u["y"], u["z"], nest))
    return v.select("i", "j", F.when(F.col("v").isNotNull(), pix).alias("ipix"))


def project_map(sky: DataFrame, nside: int, plane: str = "mollweide", xsize: int = 800, ysize: int = 400, rotator=None, nest: bool = False, flip: bool = True) -> DataFrame:
    """(i, j, value): a map seen on an image grid; -inf off the sky, null where the map has no value."""
    grid = image_pixels(sky.sparkSession, nside, plane, xsize, ysize, rotator, nest, flip)
    joined = grid.join(sky.select("ipix", "value"), "ipix", "left")
    return joined.select("i", "j", F.when(F.col("ipix").isNull(), F.lit(float("-inf"))).otherwise(F.col("value")).alias("value"))


# --- from a vector to the plane ----------------------------------------------
def _mollweide_angle(z: Column) -> Column:
    """t with 2 t + sin(2 t) = pi z, by Newton steps; near the poles it starts from the series there."""
    near = F.lit(math.pi / 2) - F.pow(F.greatest(F.lit(0.0), 1 - F.abs(z)) * (3 * math.pi / 4), F.lit(1 / 3))
    start = F.when(F.abs(z) > 0.5, F.signum(z) * near).otherwise(z * (math.pi / 4))
    step = lambda t, _: t - F.when(F.cos(t) > 1e-6, (t * 2 + F.sin(t * 2) - z * math.pi) / (F.cos(t) * F.cos(t) * 4)).otherwise(0.0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)


def _xy(x: Column, y: Column) -> Column:
    return record(x=x, y=y)


def mollweide_xy(v: Column) -> Column:
    return let(_mollweide_angle(v["z"]), lambda t: _xy(F.atan2(v["y"], v["x"]) * (2 / math.pi) * F.cos(t), F.sin(t)))


def gnomonic_xy(v: Column) -> Column:
    """Null behind the plane."""
    return F.when(v["x"] > 0, _xy(v["y"] / v["x"], v["z"] / v["x"]))


def cartesian_xy(v: Column) -> Column:
    return _xy(F.degrees(F.atan2(v["y"], v["x"])), F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))))


def orthographic_xy(v: Column) -> Column:
    """Null on the far half."""
    return F.when(v["x"] >= 0, _xy(v["y"], v["z"]))


def azimuthal_xy(v: Column, equal_area: bool = False) -> Column:
    s = F.sqrt(v["y"] * v["y"] + v["z"] * v["z"])
    c = F.atan2(s, v["x"])
    r = F.sin(c / 2) * 2 if equal_area else c
    return let(F.when(s > 0, r / s).otherwise(F.lit(1.0)), lambda k: _xy(v["y"] * k, v["z"] * k))


TO_PLANE = {"mollweide": mollweide_xy, "orthographic": orthographic_xy, "azimuthal": azimuthal_xy, "lambert": lambda v: azimuthal_xy(v, True), "cartesian": cartesian_xy, "gnomonic": gnomonic_xy}


def image_cell(v: Column, plane: str = "mollweide", xsize: int = 800, ysize: int = 400, rotator=None, flip: bool = True) -> Column:
    """(i, j) of the image cell in which a direction (unit vector struct) is seen, as ``image_pixels`` counts; null outside the image."""
    _, w, h = PLANES[plane]
    seen = let(rotator.vector(v) if rotator else v, lambda u: TO_PLANE[plane](u))
    cell = let(seen, lambda p: record(j=F.floor((p["x"] / (-w if flip else w) + 1) / 2 * xsize).cast("int"), i=F.floor((p["y"] / h + 1) / 2 * ysize).cast("int")))
    return let(cell, lambda c: F.when((c["i"] >= 0) & (c["i"] < ysize) & (c["j"] >= 0) & (c["j"] < xsize), record(i=c["i"], j=c["j"])))


def symlog(x: Column) -> Column:
    return F.log10((x + F.sqrt(x * x + 4)) * 0.5)


def symexp(x: Column) -> Column:
    """The inverse of ``symlog``."""
    return F.pow(F.lit(10.0), x) - F.pow(F.lit(10.0), -x)
