"""Region queries: pixels and ranges of discs, polygons and strips."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions import pixel as P

from . import coverage
from .coverage import max_pixrad


def _rings(spark: SparkSession, nside: int) -> DataFrame:
    return spark.range(1, 4 * nside).select(P.ringinfo(nside, "id").alias("r")).select("r.*")


def disc_ranges(spark: SparkSession, nside: int, vec, radius: float) -> DataFrame:
    """(first, last) RING pixels, both within: a range or two for each ring that the disc meets, O(nside) rows for any radius."""
    x, y, z = np.asarray(vec, float) / np.linalg.norm(vec)
    theta, phi, sin = math.atan2(math.hypot(x, y), z), math.atan2(y, x), math.hypot(x, y)
    low, high = math.cos(min(math.pi, theta + radius)), math.cos(max(0.0, theta - radius))
    low, high = (-2.0 if theta + radius >= math.pi else low), (2.0 if theta - radius <= 0 else high)
    rings = _rings(spark, nside).where((F.col("costheta") >= low) & (F.col("costheta") <= high))
    cos = (F.lit(math.cos(radius)) - F.col("costheta") * float(z)) / (F.col("sintheta") * float(sin))
    if sin == 0:
        half = F.when(F.col("costheta") * float(z) >= math.cos(radius), F.lit(math.pi))
    else:
        half = F.when(cos <= -1, F.lit(math.pi)).when(cos <= 1, F.acos(cos))
    rings = rings.withColumn("half", half).where("half is not null")
    step, shift = F.lit(2 * math.pi) / F.col("ringpix"), F.when(F.col("shifted"), 0.5).otherwise(0.0)
    rings = rings.withColumn("a", F.ceil((F.lit(phi) - F.col("half")) / step - shift)).withColumn("b", F.floor((F.lit(phi) + F.col("half")) / step - shift)).where("a <= b")
    n, s = F.col("ringpix"), F.col("startpix")
    a, size = F.pmod("a", n), F.least(F.col("b") - F.col("a") + 1, n)
    one = F.array(F.struct((s + a).alias("first"), (s + a + size - 1).alias("last")))
    two = F.array(F.struct((s + a).alias("first"), (s + n - 1).alias("last")), F.struct(s.alias("first"), (s + a + size - 1 - n).alias("last")))
    everything = F.array(F.struct(s.alias("first"), (s + n - 1).alias("last")))
    ranges = F.when(size >= n, everything).when(a + size <= n, one).otherwise(two)
    return rings.select(F.explode(ranges).alias("r")).select("r.*")


def pixels_of(ranges: DataFrame) -> DataFrame:
    return ranges.select(F.explode(F.sequence("first", "last")).alias("ipix"))


def ranges_of(pixels: DataFrame) -> DataFrame:
    """(first, last) of each run of neighbouring ids: joined in blocks of a million ids, then at the blocks' edges."""
    return coverage.joined(pixels.select(F.col("ipix").alias("first"), F.col("ipix").alias("last")), [], 20)


def _vector(v) -> Column:
    return P.record(**{c: F.lit(float(x)) for c, x in zip("xyz", v, strict=True)})


def _power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def _covered_pixels(shaped, nside: int, inclusive: bool, fact: int, nest: bool) -> DataFrame:
    out = pixels_of(coverage.covered_ranges(shaped, [], nside, inclusive, fact))
    return out if nest else out.select(P.nest2ring(nside, "ipix").alias("ipix"))


def query_disc(spark: SparkSession, nside: int, vec, radius: float, inclusive: bool = False, fact: int = 4, nest: bool = False) -> DataFrame:
    """(ipix): pixels with their centre in a disc; inclusive: all that overlap it and maybe a few more, by way of a grid ``fact`` times as fine.

    Inclusive discs descend the tree of cells where sizes are powers of two; other sizes have all fine pixels made.
    """
    if inclusive and _power_of_two(nside) and _power_of_two(fact):
        shaped = coverage.one_region(spark, coverage.discs, vec=_vector(vec), radius=F.lit(float(radius)))
        return _covered_pixels(shaped, nside, True, fact, nest)
    if inclusive:
        fine = pixels_of(disc_ranges(spark, nside * fact, vec, radius + max_pixrad(nside * fact)))
        parent = P.vec2pix(nside, F.col("v.x"), F.col("v.y"), F.col("v.z"))
        out = fine.select(P.pix2vec(nside * fact, "ipix").alias("v")).select(parent.alias("ipix")).distinct()
    else:
        out = pixels_of(disc_ranges(spark, nside, vec, radius))
    return out.select(P.ring2nest(nside, "ipix").alias("ipix")) if nest else out


def query_strip(spark: SparkSession, nside: int, theta1: float, theta2: float, inclusive: bool = False, nest: bool = False) -> DataFrame:
    """(ipix): pixels with centres between two colatitudes; if the first is the larger, those of both polar caps."""
    if inclusive:
        grow = max_pixrad(nside)
        theta1, theta2 = (max(0.0, theta1 - grow), min(math.pi, theta2 + grow)) if theta1 < theta2 else (theta1 - grow, theta2 + grow)
    theta = F.atan2("sintheta", "costheta")
    within = (theta >= theta1) & (theta <= theta2) if theta1 < theta2 else (theta >= theta1) | (theta <= theta2)
    out = pixels_of(_rings(spark, nside).where(within).select(F.col("startpix").alias("first"), (F.col("startpix") + F.col("ringpix") - 1).alias("last")))
    return out.select(P.ring2nest(nside, "ipix").alias("ipix")) if nest else out


def query_polygon(spark: SparkSession, nside: int, vertices, inclusive: bool = False, fact: int = 4, nest: bool = False) -> DataFrame:
    """(ipix): pixels with centres in a convex polygon, by descent of the tree of cells; inclusive as for discs.

    Sizes that are no powers of two take candidates from a disc around it.
    """
    v = np.asarray(vertices, float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    if len(v) < 3:
        raise ValueError("a polygon has three vertices at least")
    normals = np.cross(v, np.roll(v, -1, axis=0))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    sides = np.sign([normals[i] @ v[(i + 2) % len(v)] for i in range(len(v))])
    if abs(sides.sum()) != len(v):
        raise ValueError("the polygon isn't convex")
    if _power_of_two(nside) and (_power_of_two(fact) or not inclusive):
        shaped = coverage.one_region(spark, coverage.polygons, vertices=F.array(*[_vector(p) for p in v]))
        return _covered_pixels(shaped, nside, inclusive, fact, nest)
    normals *= sides[0]
    centre = v.sum(axis=0) / np.linalg.norm(v.sum(axis=0))
    grow = max_pixrad(nside) if inclusive else 0.0
    radius = max(math.acos(np.clip(centre @ p, -1, 1)) for p in v) + grow
    out = query_disc(spark, nside, centre, radius)
    vec = out.select("ipix", P.pix2vec(nside, "ipix").alias("c"))
    for a, b, c in normals.tolist():
        vec = vec.where(F.col("c.x") * a + F.col("c.y") * b + F.col("c.z") * c >= -math.sin(grow))
    out = vec.select("ipix")
    return out.select(P.ring2nest(nside, "ipix").alias("ipix")) if nest else out


def in_ranges(points: DataFrame, ranges: DataFrame, nside: int) -> DataFrame:
    """Points (ipix) that lie in ranges: joined on the ring, so no pair of a point and a far range is made."""
    keyed = ranges.select("first", "last", P.pix2ring(nside, "first").alias("ring")).withColumnRenamed("ring", "range_ring")
    rows = points.withColumn("point_ring", P.pix2ring(nside, "ipix"))
    on = (F.col("point_ring") == F.col("range_ring")) & F.col("ipix").between(F.col("first"), F.col("last"))
    return rows.join(keyed, on, "left_semi").drop("point_ring")
