"""Line integral convolution: a texture smeared along the directions of polarisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions import pixel as P

from . import blocks, harmonic
from ._lineage import dropped, settled
from .maps import checked_nside, unseen_to_null

_STATE = "start long, way int, tick int, x double, y double, z double, dx double, dy double, dz double, total double, weight double"


def kernel(steps: int) -> np.ndarray:
    """Weights along a line: a squared sine that adds up to 1."""
    w = np.sin(np.pi * np.arange(1, steps + 1) / (steps + 1)) ** 2
    return w / w.sum()


def white_noise(spark: SparkSession, nside: int, seed: int = 42) -> DataFrame:
    """(ipix, value) in [-0.5, 0.5) by a digest of seed and pixel: the same however rows are dealt out."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    return spark.range(12 * nside * nside).select(F.col("id").alias("ipix"), (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52) - 0.5).alias("value"))


def noise_at_degree(spark: SparkSession, nside: int, ell: int, seed: int = 42) -> DataFrame:
    """(ipix, value): random numbers with power at one degree alone; a negative one stands for 2 nside."""
    ell = 2 * nside if ell < 0 else ell
    re, im = harmonic.normals(seed)
    orders = spark.range(ell + 1).select(F.lit(ell).alias("l"), F.col("id").cast("int").alias("m"))
    return harmonic.alm2map(orders.select("l", "m", re.alias("re"), F.when(F.col("m") == 0, 0.0).otherwise(im).alias("im")), nside)


def _bracket(nside: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors (n, 3): the RING pixel that holds each, and four pixels and weights that interpolate there."""
    z, s, length, first = harmonic._rings(nside)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    colatitude = np.arctan2(s, z)
    theta, phi = np.arctan2(np.hypot(v[:, 0], v[:, 1]), v[:, 2]), np.arctan2(v[:, 1], v[:, 0]) % (2 * np.pi)
    below = np.searchsorted(colatitude, theta, side="right")  # rings above the point
    up, down = np.maximum(below - 1, 0), np.minimum(below, len(z) - 1)

    def pair(ring):
        at = (phi - first[ring]) / (2 * np.pi / length[ring])
        k = np.floor(at).astype(np.int64)
        return begin[ring] + k % length[ring], begin[ring] + (k + 1) % length[ring], at - k

    (a, b, wa), (c, d, wc) = pair(up), pair(down)
    between = np.where(up == down, 1.0, colatitude[down] - colatitude[up])
    t = (theta - colatitude[up]) / between
    pix, weight = np.stack([a, b, c, d]), np.stack([(1 - wa) * (1 - t), wa * (1 - t), (1 - wc) * t, wc * t])
    top, bottom = below == 0, below == len(z)
    # Beyond the last ring, the four pixels at the pole share what is left.
    share = np.where(top, 1 - theta / colatitude[0], 1 - (np.pi - theta) / (np.pi - colatitude[-1])) / 4
    pix[:2, top], pix[2:, bottom] = begin[0] + (pix[2:, top] + 2) % 4, begin[-1] + (pix[:2, bottom] - begin[-1] + 2) % 4
    for pole, near, far, w in ((top, slice(2, 4), slice(0, 2), wc), (bottom, slice(0, 2), slice(2, 4), wa)):
        weight[near, pole] = np.stack([1 - w, w])[:, pole] * (1 - 4 * share[pole]) + share[pole]
        weight[far, pole] = share[pole]
    # Less is rounding: on a ring it would ask for pixels of the next one.
    return _holder(nside, v, phi), pix, np.where(weight < 1e-12, 0.0, weight)


def _holder(nside: int, v: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The RING pixel that holds each vector."""
    z, turn = v[:, 2], phi / (np.pi / 2) % 4
    belt = np.abs(z) <= 2 / 3
    low, high = np.floor(nside * (turn + 0.5 - z * 0.75)).astype(np.int64), np.floor(nside * (turn + 0.5 + z * 0.75)).astype(np.int64)
    ring = nside + 1 + low - high
    place = ((low + high - nside + 2 - ring % 2) // 2) % (4 * nside)
    in_belt = 2 * nside * (nside - 1) + (ring - 1) * 4 * nside + place
    part = turn - np.floor(turn)
    far = nside * np.hypot(v[:, 0], v[:, 1]) / np.sqrt((1 + np.abs(z)) / 3)  # nside * sqrt(3 * (1 - |z|)), exact at the poles too
    near = np.floor(part * far).astype(np.int64) + np.floor((1 - part) * far).astype(np.int64) + 1
    place = np.floor(turn * near).astype(np.int64) % (4 * near)
    return np.where(belt, in_belt, np.where(z > 0, 2 * near * (near - 1) + place, 12 * nside * nside - 2 * near * (near + 1) + place))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _directions(v: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Unit vectors along the polarisation: its angle counts from south to east; NaN where there is none."""
    angle = np.where(np.hypot(q, u) > 0, np.arctan2(u, q) / 2, np.nan)
    s = np.hypot(v[:, 0], v[:, 1])
    c, d = np.where(s > 0, v[:, 0] / np.where(s > 0, s, 1), 1.0), np.where(s > 0, v[:, 1] / np.where(s > 0, s, 1), 0.0)
    south, east = np.stack([v[:, 2] * c, v[:, 2] * d, -s], 1), np.stack([-d, c, np.zeros(len(s))], 1)
    return south * np.cos(angle)[:, None] + east * np.sin(angle)[:, None]


def _along(v: np.ndarray, d: np.ndarray, angle: float) -> np.ndarray:
    """v moved by an angle along d, of which only the part across v counts."""
    return _unit(v * math.cos(angle) + _unit(d - v * (v * d).sum(1, keepdims=True)) * math.sin(angle))


def traced(nside: int, rows: pd.DataFrame, states: pd.DataFrame, weights: np.ndarray, step: float) -> pd.DataFrame:
    """Lines followed over a block's pixels and those around it, until they end or leave; ``done`` marks those that end.

    A tick is half a step: at even ones a line stands at a point, whose texture
    counts, at odd ones the direction half a step on is what it goes by.
    """
    ids, at = np.unique(rows["ring"].to_numpy(), return_index=True)
    q, u, texture = (rows[c].to_numpy(float)[at] for c in ("q", "u", "t"))
    half = len(weights) // 2
    out = []
    # `moved`: this block didn't get the line at this very point, so what it lacks another block may have.
    live, moved = states.copy(), np.zeros(len(states), bool)
    while len(live):
        v, d = live[["x", "y", "z"]].to_numpy(), live[["dx", "dy", "dz"]].to_numpy()
        tick, way = live["tick"].to_numpy(), live["way"].to_numpy()
        whole = tick % 2 == 0
        p = v.copy()
        p[~whole] = _along(v[~whole], d[~whole], step / 2)
        holder, pix, w = _bracket(nside, p)
        slot = np.minimum(np.searchsorted(ids, np.vstack([holder, pix])), len(ids) - 1)
        known = ids[slot] == np.vstack([holder, pix])
        here = known[0] & (known[1:] | (w == 0)).all(0)
        leaves = ~here & moved
        out.append(live[leaves].assign(done=False))
        value = np.where(known[0], texture[slot[0]], np.nan)
        place = half + way * (tick // 2)
        counts = whole & ~leaves & ~np.isnan(value) & ((way > 0) | (tick > 0))
        k = np.where(counts, weights[np.clip(place, 0, len(weights) - 1)], 0.0)
        live = live.assign(total=live["total"] + k * np.where(counts, value, 0.0), weight=live["weight"] + k)
        qu = [np.where(w == 0, 0.0, w * np.where(known[1:], m[slot[1:]], np.nan)).sum(0) for m in (q, u)]
        now = _directions(p, *qu)
        sign = np.where(tick == 0, way, np.where((now * d).sum(1) < 0, -1, 1))
        now = now * sign[:, None]
        last = whole & ((place + way < 0) | (place + way >= len(weights)))
        ends = ~leaves & (last | np.isnan(now).any(1))
        out.append(live[ends].assign(done=True))
        goes = ~leaves & ~ends
        v[goes & ~whole] = _along(v[goes & ~whole], now[goes & ~whole], step)
        live = live.assign(tick=tick + 1, x=v[:, 0], y=v[:, 1], z=v[:, 2], dx=now[:, 0], dy=now[:, 1], dz=now[:, 2])[goes]
        moved = np.ones(len(live), bool)
    return pd.concat(out, ignore_index=True) if out else states.assign(done=pd.Series(dtype=bool))


def line_integral_convolution(
    sky: DataFrame, nside: int, texture: DataFrame | None = None, steps: int = 100, kernel_steps: int = 50, step_radian: float = 0.003,
    pol_min: float = -1e30, pol_max: float = 1e30, rand_seed: int = 42, ell: int | None = None, modulate: bool = False, nest: bool = False,
) -> DataFrame:
    """(ipix, value): the mean of a texture along the line of polarisation through each pixel of a map (ipix, q, u), from 1 where least to 0.05 where greatest.

    A line goes by second-order steps through the interpolated map, to either
    side of the pixel's centre; ``kernel_steps`` points count by ``kernel``. It
    ends where a pixel with weight is absent or bad or where q = u = 0. Each
    pixel has its own line, so results don't hang on any order of pixels, and
    ``steps``, the length of a line that pixels might share, is checked alone.
    With ``modulate`` the value is multiplied by the polarised amplitude, held
    within pol_min and pol_max and brought to 0..1. Pixels without q, u or
    texture are null. Textures are white noise, noise at one degree (``ell``),
    or given ones (ipix, value); null and NaN count as absent.

    The map is dealt to blocks with their borders; lines that leave a block are
    handed on to the next, so a round is a shuffle of lines under way, and
    rounds go with the blocks that a line crosses, whatever the map's size.
    """
    if kernel_steps > steps:
        raise ValueError("a kernel has no more steps than a line")
    checked_nside(nside, nest=True)
    spark, weights = sky.sparkSession, kernel(kernel_steps)
    if texture is None:
        texture = white_noise(spark, nside, rand_seed) if ell is None else noise_at_degree(spark, nside, ell, rand_seed)
        texture = texture.withColumn("ipix", P.ring2nest(nside, "ipix")) if nest else texture
    good = lambda c: F.when(~F.isnan(c), unseen_to_null(c)).cast("double")
    both = sky.select("ipix", good("q").alias("q"), good("u").alias("u")).join(texture.select("ipix", good("value").alias("t")), "ipix", "left")
    ring, nested = (P.nest2ring(nside, "ipix"), F.col("ipix")) if nest else (F.col("ipix"), P.ring2nest(nside, "ipix"))
    own = settled(both.select(nested.alias("ipix"), ring.cast("long").alias("ring"), "q", "u", "t"))
    dealt = settled(blocks.with_halo(own, nside, ["ring", "q", "u", "t"]).drop("own", "ipix"))

    lines = own.where("q is not null and u is not null and t is not null").select(F.col("ring").alias("start"), P.pix2vec(nside, "ring").alias("v"))
    zero = [F.lit(0.0).alias(c) for c in ("dx", "dy", "dz", "total", "weight")]
    lines = lines.select("start", F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"), F.lit(0).alias("tick"), "v.*", *zero)

    def follow(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _STATE.split(", ")]
        if not len(states) or not len(rows):
            return states[names].assign(done=True)
        return traced(nside, rows, states[names], weights, step_radian)

    ended, rounds = None, []
    while True:
        out = settled(dealt.groupBy("block").cogroup(_routed(lines, nside, step_radian).groupBy("block")).applyInPandas(follow, _STATE + ", done boolean"))
        rounds.append(out)
        over = out.where("done").select("start", "total", "weight")
        ended = over if ended is None else ended.unionAll(over)
        lines = out.where(~F.col("done")).drop("done")
        if not lines.limit(1).count():
            break
    means = settled(ended.groupBy("start").agg((F.sum("total") / F.sum("weight")).alias("mean")))
    dropped(dealt, *rounds)

    size = F.greatest(F.lit(float(pol_min)), F.least(F.lit(float(pol_max)), F.sqrt(F.col("q") * F.col("q") + F.col("u") * F.col("u"))))
    low, high = means.agg(F.min("mean"), F.max("mean")).first()
    value = F.lit(1.0) - (F.col("mean") - F.lit(low).cast("double")) * (0.95 / ((high - low) or 1.0) if low is not None else 1.0)
    if modulate:
        least, most = own.where("q is not null and u is not null and t is not null").agg(F.min(size), F.max(size)).first()
        value = value * ((size - F.lit(least).cast("double")) / (((most - least) or 1.0) if least is not None else 1.0))
    return own.join(means.withColumnRenamed("start", "ring"), "ring", "left").select((F.col("ipix") if nest else F.col("ring").alias("ipix")), value.alias("value"))


def _routed(lines: DataFrame, nside: int, step: float) -> DataFrame:
    """Lines with the block of the point at which each is to be looked up."""
    half = F.when(F.col("tick") % 2 == 0, 0.0).otherwise(step / 2)
    along = F.col("dx") * F.col("x") + F.col("dy") * F.col("y") + F.col("dz") * F.col("z")
    across = lines.withColumn("_a", along).withColumn("_h", half)
    t = [F.col("d" + c) - F.col("_a") * F.col(c) for c in "xyz"]
    long = F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2])
    across = across.withColumn("_n", F.when(long > 0, F.sin("_h") / long).otherwise(0.0))
    for c, e in zip("xyz", t, strict=True):
        across = across.withColumn("_" + c, F.col(c) * F.cos("_h") + e * F.col("_n"))
    # The block of the pixel that has all others with weight about it, the point's holder among them.
    across = across.withColumn("_w", P.interp_weights(nside, P.vec2theta("_x", "_y", "_z"), P.vec2phi("_x", "_y")))
    at = P.ring2nest(nside, blocks.patch_of(nside, F.col("_w")))
    return across.withColumn("block", F.shiftright(at, 2 * blocks.block_order(nside))).select("block", *lines.columns)
