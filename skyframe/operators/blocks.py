"""Square blocks of the NEST grid, each worked on as a small image within one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions import pixel as P

#: A block has 4 ** ORDER pixels at most.
ORDER = 6


def block_order(nside: int) -> int:
    """log2 of a block's side."""
    return min(ORDER, nside.bit_length() - 1)


def in_block(nside: int):
    """A NEST pixel's block."""
    return F.shiftright("ipix", 2 * block_order(nside)).alias("block")


def place_in_block(pix: np.ndarray, side_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of NEST pixels within their blocks: even and odd bits."""
    x, y = np.zeros(len(pix), np.int64), np.zeros(len(pix), np.int64)
    for b in range(side_bits):
        x |= (pix >> (2 * b) & 1) << b
        y |= (pix >> (2 * b + 1) & 1) << b
    return x, y


def _shifted(image: np.ndarray, dx: int, dy: int, outside) -> np.ndarray:
    """The image with each pixel's neighbour at (dx, dy) in its place."""
    framed = np.pad(image, 1, constant_values=outside)
    n = image.shape[0]
    return framed[1 + dx : 1 + dx + n, 1 + dy : 1 + dy + n]


_AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def border(pixels: DataFrame, nside: int) -> DataFrame:
    """(ipix) of NEST pixels that are not surrounded by others of the set within their block: all of the set's border, and what lies at a block's edge."""
    bits = block_order(nside)

    def outer(rows: pd.DataFrame) -> pd.DataFrame:
        pix = rows["ipix"].to_numpy()
        x, y = place_in_block(pix, bits)
        held = np.zeros((1 << bits, 1 << bits), bool)
        held[x, y] = True
        inner = held.copy()
        for dx, dy in _AROUND:
            inner &= _shifted(held, dx, dy, False)
        return pd.DataFrame({"ipix": pix[~inner[x, y]]})

    return pixels.select("ipix").groupBy(in_block(nside)).applyInPandas(outer, "ipix long")


def labelled(pixels: DataFrame, nside: int) -> DataFrame:
    """(ipix, label, edge): within each block the least id of those connected to a NEST pixel, and whether it lies at the block's edge.

    Labels hook onto the least of their neighbours' and pointers jump, so rounds within a block go with the logarithm of a path.
    """
    bits = block_order(nside)
    side = 1 << bits

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        pix = np.sort(rows["ipix"].unique())
        x, y = place_in_block(pix, bits)
        own = np.arange(len(pix))
        at = np.full((side, side), len(pix))
        at[x, y] = own
        near = np.stack([_shifted(at, dx, dy, len(pix))[x, y] for dx, dy in _AROUND])
        parent = np.append(own, len(pix))
        while True:
            lowest = np.minimum(parent[near].min(axis=0), parent[:-1])
            new = parent.copy()
            np.minimum.at(new, parent[:-1], lowest)
            while True:
                jumped = new[new]
                if (jumped == new).all():
                    break
                new = jumped
            if (new == parent).all():
                break
            parent = new
        edge = (x == 0) | (y == 0) | (x == side - 1) | (y == side - 1)
        return pd.DataFrame({"ipix": pix, "label": pix[parent[:-1]], "edge": edge})

    return pixels.select("ipix").groupBy(in_block(nside)).applyInPandas(least, "ipix long, label long, edge boolean")


def with_halo(sky: DataFrame, nside: int, columns: list[str]) -> DataFrame:
    """(block, ipix, columns, own): NEST pixels' rows dealt to their blocks, and a row for each neighbour in another block.

    A row that isn't a block's own has the neighbour's id there, so a task
    needs no geometry beyond its own square. Only a block's edge is copied.
    """
    bits = block_order(nside)
    side = 1 << bits
    place = P.nest2xyf(side, F.col("ipix") % (side * side))
    rows = sky.select("ipix", *columns, place["x"].alias("_x"), place["y"].alias("_y"))
    edge = F.col("_x").isin(0, side - 1) | F.col("_y").isin(0, side - 1)
    block = lambda c: F.shiftright(c, 2 * bits)
    itself = F.array(P.record(at=F.col("ipix"), own=F.lit(True)))
    others = F.filter(P.neighbours(nside, "ipix", True), lambda n: (n >= 0) & (block(n) != block(F.col("ipix"))))
    dealt = F.when(edge, F.concat(itself, F.transform(others, lambda n: P.record(at=n, own=F.lit(False))))).otherwise(itself)
    rows = rows.select(*columns, F.explode(dealt).alias("to"))
    return rows.select(block(F.col("to.at")).alias("block"), F.col("to.at").alias("ipix"), *columns, "to.own")


def extremes(good: DataFrame, nside: int) -> DataFrame:
    """(ipix, value, is_min, is_max) of NEST pixels beyond all their neighbours, whose values count as ``other``: one shuffle of the map's rows and the blocks' edges."""
    bits = block_order(nside)

    def beyond(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["own"]]
        pix, value = own["ipix"].to_numpy(), own["value"].to_numpy()
        x, y = place_in_block(pix, bits)
        image = np.full((1 << bits, 1 << bits), np.nan)
        image[x, y] = own["other"].to_numpy()
        around = np.stack([_shifted(image, dx, dy, np.nan)[x, y] for dx, dy in _AROUND])
        low, high = np.where(np.isnan(around), np.inf, around).min(axis=0), np.where(np.isnan(around), -np.inf, around).max(axis=0)
        halo = rows[~rows["own"]]
        order = np.argsort(pix)
        at = np.searchsorted(pix, halo["ipix"].to_numpy(), sorter=order)
        at = order[np.minimum(at, len(pix) - 1)] if len(pix) else at
        here = pix[at] == halo["ipix"].to_numpy() if len(pix) else np.zeros(len(halo), bool)
        np.minimum.at(low, at[here], halo["other"].to_numpy()[here])
        np.maximum.at(high, at[here], halo["other"].to_numpy()[here])
        out = pd.DataFrame({"ipix": pix, "value": value, "is_min": value < low, "is_max": value > high})
        return out[out["is_min"] | out["is_max"]]

    return with_halo(good, nside, ["value", "other"]).groupBy("block").applyInPandas(beyond, "ipix long, value double, is_min boolean, is_max boolean")


def patches(sky: DataFrame, nside: int, nest: bool = False) -> DataFrame:
    """(ipix, pix, val): for RING pixels the RING ids and values of themselves and their neighbours, as far as they are not null; one shuffle of the map's rows and the blocks' edges."""
    bits = block_order(nside)
    side = 1 << bits
    x, y = place_in_block(np.arange(side * side), bits)

    def around(table: pa.Table) -> pa.Table:
        at, src, value, own = (table.column(c).to_numpy() for c in ("ipix", "src", "value", "own"))
        own = own.astype(bool)
        ids, values = src[own], value[own]
        slot = np.full((side, side), -1)
        slot[x[at[own] % (side * side)], y[at[own] % (side * side)]] = np.arange(len(ids))
        near = np.stack([slot[x, y]] + [_shifted(slot, dx, dy, -1)[x, y] for dx, dy in _AROUND])
        k, i = np.nonzero(near >= 0)
        ats = np.concatenate([i + at[0] // (side * side) * (side * side), at[~own]])
        order = np.argsort(ats, kind="stable")
        centres, starts = np.unique(ats[order], return_index=True)
        offsets = np.append(starts, len(ats)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, np.concatenate([inner[near[k, i]], outer])[order]) for inner, outer in ((ids, src[~own]), (values, value[~own]))]
        return pa.table({"centre": centres, "pix": lists[0], "val": lists[1]})

    ring, at = (P.nest2ring(nside, "ipix"), F.col("ipix")) if nest else (F.col("ipix"), P.ring2nest(nside, "ipix"))
    rows = sky.where("value is not null").select(at.alias("ipix"), ring.cast("long").alias("src"), F.col("value").cast("double").alias("value"))
    found = with_halo(rows, nside, ["src", "value"]).groupBy("block").applyInArrow(around, "centre long, pix array<long>, val array<double>")
    return found.select(P.nest2ring(nside, "centre").alias("ipix"), "pix", "val")


def patch_of(nside: int, w):
    """The RING pixel among a point's four weighted ones (``interp_weights``) that has the others as neighbours.

    In the belt it is the one of greatest weight. In a cap it lies on the ring
    next to the pole: the one whose two neighbours on the other ring are the point's.
    """
    npix, cap = 12 * nside * nside, 2 * nside * (nside - 1)

    def polar(first, second, other):
        """Counted from the pole; ``other`` comes first on the ring further off."""
        def chosen(a):
            quarter = P.let(P.idiv(P.isqrt(2 * a["p"] + 1) + 1, F.lit(2)), lambda r: 4 * r + P.idiv(a["p"] - 2 * r * (r - 1), r))
            return F.when(a["b"] == a["p"] + quarter, a["p"]).otherwise(a["q"])

        return P.let(P.record(p=first, q=second, b=other), chosen)

    a, b, c, d = (F.get(w, F.lit(i))["pix"] for i in range(4))
    heaviest = F.array_max(F.transform(w, lambda p: F.struct(p["weight"], p["pix"])))["pix"]
    mirrored = lambda p: npix - 1 - p
    return F.when(a < cap, polar(a, b, c)).when(d >= npix - cap, mirrored(polar(mirrored(d), mirrored(c), mirrored(b)))).otherwise(heaviest)
