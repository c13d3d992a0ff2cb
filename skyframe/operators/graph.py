"""Operators on the grid's eight-neighbour graph: extrema, holes and distances."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions import pixel as P

from . import blocks
from ._lineage import dropped, settled
from .coverage import max_pixrad
from .maps import mask_good


def neighbour_pairs(sky: DataFrame, nside: int, nest: bool = False) -> DataFrame:
    """(ipix, near) of the map's pixels."""
    return sky.select("ipix", F.explode(P.neighbours(nside, "ipix", nest)).alias("near")).where("near >= 0")


def hotspots(sky: DataFrame, nside: int, nest: bool = False) -> DataFrame:
    """(ipix, value, is_min, is_max): good pixels strictly beyond all good neighbours, whose values count as 32-bit floats; one without any is both.

    Maps whose size is a power of two are dealt out in blocks with their
    borders' values, one shuffle of the map; others are joined to their neighbours.
    """
    good = sky.where(mask_good("value") & F.col("value").isNotNull()).select("ipix", F.col("value").cast("double").alias("value"))
    if not nside & (nside - 1):
        dealt = good.select((F.col("ipix") if nest else P.ring2nest(nside, "ipix")).alias("ipix"), "value", F.col("value").cast("float").cast("double").alias("other"))
        found = blocks.extremes(dealt, nside)
        return found if nest else found.withColumn("ipix", P.nest2ring(nside, "ipix"))
    around = good.select(F.col("ipix").alias("near"), F.col("value").cast("float").cast("double").alias("other"))
    ends = neighbour_pairs(good, nside, nest).join(around, "near").groupBy("ipix").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    out = good.join(ends, "ipix", "left")
    is_min, is_max = F.coalesce(F.col("value") < F.col("low"), F.lit(True)), F.coalesce(F.col("value") > F.col("high"), F.lit(True))
    return out.select("ipix", "value", is_min.alias("is_min"), is_max.alias("is_max")).where("is_min or is_max")


#: The order at which all pairs of cells are looked at, 192 cells at most.
START = 2
#: Links between blocks that one task may join up (two numbers each).
LINKS = 2_000_000


def components(pixels: DataFrame, nside: int, nest: bool = False) -> DataFrame:
    """(ipix, label) of connected pixels, label the smallest id of a component in NEST order.

    Blocks are labelled each within a task, so what is left is the graph of
    blocks' components and of the links over their edges. A graph of at most
    ``LINKS`` links is joined up by one task; a larger one by stars, whose
    rounds go with the logarithm of its size. Sizes that are no powers of two
    have no blocks: each pixel is its own component there.
    """
    if nside & (nside - 1):
        parts = pixels.select("ipix", F.col("ipix").alias("label"), F.lit(True).alias("edge"))
        nest = False
    else:
        parts = blocks.labelled(pixels.select((F.col("ipix") if nest else P.ring2nest(nside, "ipix")).alias("ipix")), nside)
    parts = settled(parts)
    square = not nside & (nside - 1)
    edges = parts.where("edge")
    near = edges.select("label", F.explode(P.neighbours(nside, "ipix", square)).alias("near")).where("near >= 0")
    links = near.join(edges.select(F.col("ipix").alias("near"), F.col("label").alias("other")), "near").where("label > other").select(F.col("label").alias("u"), F.col("other").alias("v")).distinct()
    roots = linked(settled(links))
    out = parts.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").select("ipix", F.coalesce("root", "label").alias("label"))
    return out if nest or not square else out.select(P.nest2ring(nside, "ipix").alias("ipix"), "label")


def linked(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of links (u, v), u > v, is connected to; links are stored."""
    if links.limit(LINKS + 1).count() <= LINKS:
        return links.coalesce(1).mapInPandas(_joined_up, "node long, root long")
    before = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = settled(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(links, large)
        links = small
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _joined_up(batches):
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(up), "root": [root(x) for x in list(up)]}, dtype="int64")


def fill_small_holes(mask: DataFrame, nside: int, nest: bool = False, min_size: int | None = None, min_area_arcmin2: float | None = None) -> DataFrame:
    """``mask`` (ipix, masked) with connected groups of masked pixels set free if they're smaller than a size or an area."""
    if min_size is None and min_area_arcmin2 is None:
        return mask
    area = 4 * math.pi / (12 * nside * nside) * (180 * 60 / math.pi) ** 2
    labels = components(mask.where("masked").select("ipix"), nside, nest)
    n = F.col("n")
    small = F.lit(False)
    small = small | (n < min_size) if min_size is not None else small
    small = small | (n * area < min_area_arcmin2) if min_area_arcmin2 is not None else small
    filled = labels.join(labels.groupBy("label").agg(F.count("*").alias("n")).where(small), "label", "left_semi").select("ipix", F.lit(True).alias("filled"))
    out = mask.join(filled, "ipix", "left")
    return out.select("ipix", (F.col("masked") & F.col("filled").isNull()).alias("masked"))


def dist2holes(mask: DataFrame, nside: int, nest: bool = False, max_distance: float = math.pi, min_size: int | None = None, min_area_arcmin2: float | None = None) -> DataFrame:
    """(ipix, distance): from each free pixel to the nearest masked one; 0 on masked ones, at most ``max_distance``.

    Holes smaller than a size or an area are free pixels (``fill_small_holes``).

    Cells of the NEST tree go down together: a cell's candidates are cells with
    holes, at distances d of centres from the least one to that and twice both
    radii more, as any other can't hold the nearest hole of any of its pixels.
    A round goes one order down, so rounds are fewer than the order and two;
    each joins cells with their own parts and with those of their candidates.
    Only holes at their set's border count. Where a size is no power of two,
    cells are those of the next one, and a last round goes from them to pixels.
    """
    if min_size is not None or min_area_arcmin2 is not None:
        mask = settled(fill_small_holes(mask, nside, nest, min_size, min_area_arcmin2))
    if not mask.where("masked").limit(1).count():
        return mask.select("ipix", F.lit(float(max_distance)).alias("distance"))
    order = (nside - 1).bit_length()
    square = nside == 1 << order
    if square:
        cells = settled(mask.select((F.col("ipix") if nest else P.ring2nest(nside, "ipix")).alias("ipix"), "masked"))
        holes = settled(blocks.border(cells.where("masked"), nside))
        points = _cells(cells.where(~F.col("masked")), order, order).withColumn("up", F.shiftright("cell", 2))
        ends = _cells(holes, order, order).withColumn("up", F.shiftright("cell", 2))
    else:
        at = mask.select(F.col("ipix").alias("cell"), "masked", P.pix2vec(nside, "ipix").alias("v")).select("cell", "masked", "v.*")
        at = settled(at.withColumn("up", P.vec2pix(1 << order, "x", "y", "z", True)))
        cells, holes = at.select(F.col("up").alias("ipix")), at.where("masked").select(F.col("up").alias("ipix"))
        points, ends = at.where(~F.col("masked")).drop("masked"), at.where("masked").drop("masked")
    near = None
    for k in range(START, order + (not square)):
        own, bad = (_cells(rows, order, k).withColumn("up", F.shiftright("cell", 2)) for rows in (cells, holes))
        pairs = _distances(own, bad, near)
        reach = 4 * max_pixrad(1 << k)
        lists = pairs.groupBy("cell").agg(F.min("d").alias("least"), F.collect_list(F.struct("d", "hole")).alias("all"))  # of one cell
        now = settled(lists.select("cell", F.transform(F.filter("all", lambda p: p["d"] <= F.col("least") + reach), lambda p: p["hole"]).alias("holes")))
        if near is not None:
            dropped(near)
        near = now
    found = _distances(points, ends, near).groupBy("cell").agg(F.min("d").alias("d"))
    at = P.nest2ring(nside, "cell") if square and not nest else F.col("cell")
    free = found.select(at.alias("ipix"), F.least(F.col("d"), F.lit(float(max_distance))).alias("distance"))
    return free.unionAll(mask.where("masked").select("ipix", F.lit(0.0).alias("distance")))


def _distances(own: DataFrame, holes: DataFrame, near: DataFrame | None) -> DataFrame:
    """(cell, hole, d): of rows (cell, up, x, y, z) to those holes' rows whose ``up`` is a candidate of their own; without candidates, all of 12 * 4 ** START at most."""
    bad = holes.withColumnsRenamed({"cell": "hole", "x": "hx", "y": "hy", "z": "hz", "up": "hole_up"})
    if near is None:
        pairs = own.crossJoin(F.broadcast(bad))
    else:
        pairs = own.join(near.withColumnRenamed("cell", "up"), "up").withColumn("hole_up", F.explode("holes")).drop("holes").join(bad, "hole_up")
    a, b, c = (F.col(p) * F.col("h" + q) - F.col(q) * F.col("h" + p) for p, q in ("yz", "zx", "xy"))
    along = F.col("x") * F.col("hx") + F.col("y") * F.col("hy") + F.col("z") * F.col("hz")
    return pairs.select("cell", "hole", F.atan2(F.sqrt(a * a + b * b + c * c), along).alias("d"))


def _cells(pixels: DataFrame, order: int, k: int) -> DataFrame:
    """(cell, x, y, z): the cells of order k that hold any of the NEST pixels."""
    own = pixels.select(F.shiftright("ipix", 2 * (order - k)).alias("cell"))
    own = own if k == order and "masked" in pixels.columns else own.distinct()
    return own.select("cell", P.pix2vec(1 << k, "cell", True).alias("v")).select("cell", "v.*")
