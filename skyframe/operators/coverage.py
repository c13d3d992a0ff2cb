"""Regions covered by cells of mixed depth: a descent of the NEST tree.

A region is a row of a table and has a depth: how far inside it a direction
lies, in radians, negative outside.  A cell whose centre lies deeper than the
cell's radius is inside as a whole; one that lies farther out than that is
dropped; any other is split into four.  So the number of cells goes with the
region's border, not its area, and all regions of a table descend at once, as
projections and explosions without a join.  Regions are dealt out by their
keys; on fine grids one more shuffle deals the cells of the third order out, so
that a single large region is spread as well.

A region's cells come in order, one after the other, so runs are made as they
pass by, without a shuffle or sort of cells; only where a region was spread,
runs at its blocks' edges meet again.  Regions of one key make up one: of
these, ranges are joined within blocks of the sky, each a group of its own, and
then across the blocks' edges, at most two ranges a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skyframe.functions import pixel as P

#: Cells of this order are blocks: where the descent is dealt out, and in which ranges are joined.
BLOCK_ORDER = 3
#: Down to this order at most (49,152 cells) a region stays whole in its task.
WHOLE_ORDER = 6

Depth = Callable[[Column, Column], Column]


def max_pixrad(nside: int) -> float:
    """The greatest distance of a pixel's corner from its centre."""
    z = 1 - (1 - 1 / nside) ** 2 / 3
    a = (math.sqrt(5) / 3 * math.cos(math.pi / 4 / nside), math.sqrt(5) / 3 * math.sin(math.pi / 4 / nside), 2 / 3)
    b = (math.sqrt(1 - z * z), 0.0, z)
    cross = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    return math.atan2(math.hypot(*cross), sum(p * q for p, q in zip(a, b, strict=True)))


# --- regions ---------------------------------------------------------------
def _unit(v: Column) -> Column:
    return P.let(v, lambda u: P.let(F.sqrt(u["x"] * u["x"] + u["y"] * u["y"] + u["z"] * u["z"]), lambda r: P.record(**{c: u[c] / r for c in "xyz"})))


def _cross(a: Column, b: Column) -> Column:
    return P.record(x=a["y"] * b["z"] - a["z"] * b["y"], y=a["z"] * b["x"] - a["x"] * b["z"], z=a["x"] * b["y"] - a["y"] * b["x"])


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def discs(regions: DataFrame, vec: Column, radius: Column) -> tuple[DataFrame, Depth]:
    """Of rows with a direction (x, y, z) of any length and a radius."""
    rows = regions.withColumn("_shape", P.record(c=_unit(vec), r=radius.cast("double")))
    return rows, lambda v, shape: shape["r"] - P.angdist(v, shape["c"])


def polygons(regions: DataFrame, vertices: Column) -> tuple[DataFrame, Depth]:
    """Of rows with an array of three directions at least, in either sense; an error if one isn't convex. Null and empty arrays have no shape."""
    def at(array: Column, i: Column) -> Column:
        return F.element_at(array, (F.pmod(i, F.size(array)) + 1).cast("int"))

    def each(array: Column, use) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(array) - 1), use)

    def sides(v: Column) -> Column:
        return P.let(each(v, lambda i: _unit(_cross(at(v, i), at(v, i + 1)))), lambda n: oriented(v, n))

    def oriented(v: Column, n: Column) -> Column:
        """Normals that point inwards, if every vertex lies on one side of the side before it."""
        inner = each(v, lambda i: F.signum(_dot(at(n, i), at(v, i + 2))))
        turned = lambda s: F.transform(n, lambda m: P.record(**{c: m[c] * s for c in "xyz"}))
        wrong = F.raise_error(F.lit("a polygon has three vertices at least and is convex"))
        return P.let(inner, lambda s: F.when((F.size(v) >= 3) & (F.array_min(s) == F.array_max(s)) & (s[0] != 0), turned(s[0])).otherwise(wrong))

    rows = regions.withColumn("_shape", F.when(F.size(vertices) > 0, P.let(F.transform(vertices, _unit), sides)))

    def depth(v: Column, shape: Column) -> Column:
        return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.array_min(F.transform(shape, lambda m: _dot(m, v))))))

    return rows, depth


def strips(regions: DataFrame, theta1: Column, theta2: Column) -> tuple[DataFrame, Depth]:
    """Of rows with two colatitudes; if the first is the larger, both polar caps."""
    rows = regions.withColumn("_shape", P.record(a=theta1.cast("double"), b=theta2.cast("double")))

    def depth(v: Column, shape: Column) -> Column:
        theta = P.vec2theta(v["x"], v["y"], v["z"])
        below, above = theta - shape["a"], shape["b"] - theta
        return F.when(shape["a"] < shape["b"], F.least(below, above)).otherwise(F.greatest(below, above))

    return rows, depth


# --- descent ---------------------------------------------------------------
def _order(nside: int) -> int:
    order = nside.bit_length() - 1
    if nside != 1 << order:
        raise ValueError("the tree's sizes are powers of two")
    return order


def cells(shaped: tuple[DataFrame, Depth], keys: list[str], nside: int, inclusive: bool = False, fact: int = 4, spread: bool = True) -> DataFrame:
    """(keys, order, cell): NEST cells of mixed orders that make up each region; rows without a shape have none.

    A pixel belongs to a region if its centre does.  ``inclusive``: if the
    centre of one of its parts on a grid ``fact`` times as fine is within a
    part's radius of it; so all that overlap it do, and maybe a few more. A
    cell of the last order may then come several times. Cells of a row come in
    order and together; if they are ``spread``, those of a block do.
    """
    regions, depth = shaped
    last = _order(nside)
    finest = last + (_order(fact) if inclusive else 0)
    reach = max_pixrad(1 << finest) if inclusive else 0.0
    state = ["face", "x", "y", "cell", "order", "inside"]
    start = F.transform(F.sequence(P.long(0), P.long(11)), lambda f: P.record(face=f, x=P.long(0), y=P.long(0), cell=f, order=F.lit(0), inside=F.lit(False)))
    rows = regions.where("_shape is not null").select(*keys, "_shape", F.explode(start).alias("c")).select(*keys, "_shape", "c.*")
    # One expression serves all orders; it is worked out once a row, by the explosion alone.
    x, y, order = F.col("x"), F.col("y"), F.col("order")
    n = F.call_function("shiftleft", F.lit(1), order).cast("double")
    radius = F.element_at(F.array(*[F.lit(max_pixrad(1 << k)) for k in range(finest + 1)]), order + 1)
    kept = lambda inside: F.array(P.record(**{c: F.col(c) for c in state[:-1]}, inside=inside))
    parts = F.array(*[P.record(face=F.col("face"), x=x * 2 + i, y=y * 2 + j, cell=F.col("cell") * 4 + i + 2 * j, order=order + 1, inside=F.lit(False)) for j in (0, 1) for i in (0, 1)])
    own = P.let(P.face_point(F.col("face"), (x + 0.5) / n, (y + 0.5) / n), lambda v: depth(v, F.col("_shape")))

    def dealt(d: Column) -> Column:
        at_last = F.when(d >= -reach, kept(F.lit(True))).otherwise(F.slice(parts, 1, 0))
        split = F.when(d >= radius, kept(F.lit(True))).when(d >= -radius - reach, parts).otherwise(F.slice(parts, 1, 0))
        return F.when(order == finest, at_last).otherwise(split)

    step = F.explode(F.when(F.col("inside"), kept(F.lit(True))).otherwise(P.let(own, dealt))).alias("c")
    for k in range(finest + 1):
        rows = rows.select(*keys, "_shape", step).select(*keys, "_shape", "c.*")
        if spread and k + 1 == BLOCK_ORDER:
            rows = rows.repartition("face", "x", "y")
    up = F.greatest(F.col("order") - last, F.lit(0))
    return rows.select(*keys, F.least("order", F.lit(last)).alias("order"), F.call_function("shiftright", F.col("cell"), 2 * up).alias("cell"))


def runs_of(covered: DataFrame, keys: list[str], nside: int) -> DataFrame:
    """(keys, first, last): cells (keys, _region, order, cell) as runs of NEST pixels, both within; those of a region that follow each other are one."""
    down = 2 * (_order(nside) - F.col("order"))
    shift = lambda c: F.call_function("shiftleft", c, down)
    rows = covered.select(*keys, "_region", shift(F.col("cell")).alias("first"), (shift(F.col("cell") + 1) - 1).alias("last"))
    schema = StructType([*covered.select(*keys).schema.fields, *[StructField(c, LongType()) for c in ("first", "last")]])
    return rows.mapInArrow(_passing_runs, schema)


def _passing_runs(batches):
    held = None

    def shown(batch):
        return batch.select([c for c in batch.schema.names if c != "_region"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        region, first, last = (batch.column(c).to_numpy() for c in ("_region", "first", "last"))
        new = (region[1:] != region[:-1]) | (first[1:] < first[:-1]) | (first[1:] > last[:-1] + 1)
        starts = np.flatnonzero(np.append(True, new))
        ends = pa.array(np.maximum.reduceat(last, starts))
        found = batch.take(pa.array(starts))
        found = pa.RecordBatch.from_arrays([ends if c == "last" else found.column(c) for c in found.schema.names], schema=found.schema)
        yield shown(found.slice(0, len(starts) - 1))
        held = found.slice(len(starts) - 1)  # the last run may go on
    if held is not None:
        yield shown(held)


def joined(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(keys, first, last): ranges that touch or overlap made one.

    They are joined within blocks of 2 ** bits numbers, by where they start, and
    then those that reach a block's edge with each other. A range may only pass
    over an edge if it starts at one and no other starts within it.
    """

    size = 1 << bits
    own = _runs_by(rows.withColumn("block", F.shiftright("first", bits)), [*keys, "block"]).drop("block")
    return _over_edges(own, keys, size)


def _runs_by(part: DataFrame, by: list) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("first", "last")
    up_to = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    starts = part.withColumn("new", F.when(up_to.isNull() | (F.col("first") > up_to + 1), 1).otherwise(0))
    starts = starts.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return starts.groupBy(*by, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def _over_edges(own: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Ranges of which those at the edges of blocks of ``size`` numbers are joined."""
    edge = (F.col("first") % size == 0) | ((F.col("last") + 1) % size == 0)
    ends = _runs_by(own.where(edge), keys)
    return own.where(~edge).select(*keys, "first", "last").unionAll(ends.select(*keys, "first", "last"))


def covered_ranges(shaped: tuple[DataFrame, Depth], keys: list[str], nside: int, inclusive: bool = False, fact: int = 4) -> DataFrame:
    """(keys, first, last): NEST ranges of each region, rows of equal keys together; see ``cells``."""
    regions, depth = shaped
    last = _order(nside)
    bits = 2 * max(0, last - BLOCK_ORDER)
    rows = regions.where("_shape is not null").select(*keys, "_shape")

    def runs(some: DataFrame, spread: bool) -> DataFrame:
        numbered = some.withColumn("_region", F.monotonically_increasing_id())
        return runs_of(cells((numbered, depth), [*keys, "_region"], nside, inclusive, fact, spread), keys, nside)

    def together(some: DataFrame) -> DataFrame:
        """Of regions that may overlap: runs are cut at blocks' edges before they are joined."""
        block = F.explode(F.sequence(F.shiftright("first", bits), F.shiftright("last", bits))).alias("block")
        start = F.call_function("shiftleft", F.col("block"), F.lit(bits))
        cut = runs(some, True).select(*keys, "first", "last", block)
        return joined(cut.select(*keys, F.greatest("first", start).alias("first"), F.least("last", start + ((1 << bits) - 1)).alias("last")), keys, bits)

    if not keys:
        return together(rows)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count that is kept: few bytes make many cells
    rows = rows.repartition(parts, *keys).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    spread = last + (_order(fact) if inclusive else 0) > WHOLE_ORDER
    alone = runs(rows.where("_n = 1").drop("_n"), spread)
    if spread:
        alone = _over_edges(alone, keys, 1 << bits)
    return alone.unionAll(together(rows.where("_n > 1").drop("_n").dropDuplicates([*keys, "_shape"])))


def in_nest_ranges(points: DataFrame, found: DataFrame, keys: list[str], nside: int) -> DataFrame:
    """Points (ipix, NEST) with the keys of every region whose ranges hold them: joined on coarse cells, so no pair of a point and a far range is made."""
    shift = 2 * max(0, _order(nside) - BLOCK_ORDER - 2)
    near = found.select(*keys, "first", "last", F.explode(F.sequence(F.shiftright("first", shift), F.shiftright("last", shift))).alias("_near"))
    rows = points.withColumn("_near", F.shiftright(F.col("ipix").cast("long"), shift))
    on = F.col("ipix").between(F.col("first"), F.col("last"))
    return rows.join(near, "_near").where(on).drop("_near", "first", "last")


def one_region(spark, shape, **values) -> tuple[DataFrame, Depth]:
    """A table of one region without keys."""
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return shape(row, *[F.col(k) for k in values])
