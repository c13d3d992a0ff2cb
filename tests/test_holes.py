"""Holes: components over blocks, distances by descent, against pixel-by-pixel searches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.operators import blocks, graph, regions

R = np.random.default_rng(21)


def vectors(spark, nside, nest=False):
    rows = spark.range(12 * nside * nside).select("id", P.pix2vec(nside, "id", nest).alias("v")).select("id", "v.*").toPandas().sort_values("id")
    return rows[["x", "y", "z"]].to_numpy()


def spiral(side):
    """Pixels of a path that winds inwards over a square, a pixel wide and as far apart, and a second path between its turns."""
    held = np.zeros((side, side), bool)
    x, y, dx, dy, n, first = 0, 0, 1, 0, side - 1, True
    while n > 1:
        for _ in range(1 if first else 2):
            for _ in range(n):
                held[x, y] = True
                x, y = x + dx, y + dy
            dx, dy = -dy, dx
        if not first:
            n -= 4
        else:
            first = False
    return held


def components_by_force(spark, ids, nside, nest):
    rows = spark.createDataFrame([(int(i),) for i in ids], "ipix long").select("ipix", P.neighbours(nside, "ipix", nest).alias("n")).collect()
    near, out = {r.ipix: r.n for r in rows}, {}
    for start in sorted(near):
        if start in out:
            continue
        stack, out[start] = [start], start
        while stack:
            for n in near[stack.pop()]:
                if n in near and n not in out:
                    out[n] = start
                    stack.append(n)
    return out


def same_groups(got, want):
    groups = {}
    for i, label in got.items():
        groups.setdefault(label, set()).add(i)
    other = {}
    for i, label in want.items():
        other.setdefault(label, set()).add(i)
    return sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


@pytest.mark.parametrize(("nside", "nest", "links"), [(8, False, 10**6), (8, True, 0), (6, False, 10**6)])
def test_components(spark, monkeypatch, nside, nest, links):
    monkeypatch.setattr(graph, "LINKS", links)
    monkeypatch.setattr(blocks, "ORDER", 2)
    ids = np.flatnonzero(R.random(12 * nside * nside) < 0.4)
    got = {r.ipix: r.label for r in graph.components(spark.createDataFrame([(int(i),) for i in ids], "ipix long"), nside, nest).collect()}
    assert same_groups(got, components_by_force(spark, ids, nside, nest)) and len(got) == len(ids)


def test_rounds_do_not_grow_with_a_holes_length(spark, monkeypatch):
    """A spiral through all blocks of a face at nside 256 is one hole; nothing is passed on from pixel to pixel."""
    held = spiral(256)
    x, y = np.nonzero(held)
    pix = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x long, y long").select(P.xyf2nest(256, "x", "y", 4).alias("ipix")).cache()
    n = int(held.sum())
    assert n > 8000
    rounds = []
    kept = graph.settled
    monkeypatch.setattr(graph, "settled", lambda f: rounds.append(1) or kept(f))
    for links, most in ((10**6, 2), (0, 40)):
        monkeypatch.setattr(graph, "LINKS", links)
        rounds.clear()
        sizes = graph.components(pix, 256, True).groupBy("label").count().collect()
        assert [r["count"] for r in sizes] == [n] and len(rounds) <= most
    mask = pix.select("ipix", F.lit(True).alias("masked"))
    assert graph.fill_small_holes(mask, 256, True, min_size=n).where("masked").count() == n
    assert graph.fill_small_holes(mask, 256, True, min_size=n + 1).where("masked").count() == 0


def test_border_of_blocks(spark):
    ids = np.flatnonzero(R.random(12 * 16 * 16) < 0.9)
    frame = spark.createDataFrame([(int(i),) for i in ids], "ipix long")
    got = {r.ipix for r in blocks.border(frame, 16).collect()}
    around = {r.ipix: r.n for r in frame.select("ipix", P.neighbours(16, "ipix", True).alias("n")).collect()}
    own = set(around)
    assert {i for i, n in around.items() if not set(n) <= own} <= got < own


@pytest.mark.parametrize(("nside", "nest"), [(16, False), (8, True), (6, False)])
def test_distances(spark, nside, nest):
    v = vectors(spark, nside, nest)
    disc = np.flatnonzero(v @ np.array([math.cos(1.0), math.sin(1.0), 0.4]) / math.hypot(1, 0.4) > math.cos(0.3))
    holes = sorted({*map(int, disc), *map(int, R.integers(0, len(v), size=3))})
    present = sorted({*holes, *map(int, np.flatnonzero(R.random(len(v)) < 0.7))})  # a map with pixels absent
    mask = spark.createDataFrame([(i, i in set(holes)) for i in present], "ipix long, masked boolean")
    got = {r.ipix: r.distance for r in graph.dist2holes(mask, nside, nest).collect()}
    want = np.arctan2(np.linalg.norm(np.cross(v[:, None], v[holes][None]), axis=2), v @ v[holes].T).min(axis=1)
    assert sorted(got) == present and max(abs(got[i] - want[i]) for i in present) < 1e-9


def test_bounds_and_small_holes(spark):
    near = sorted(r.ipix for r in regions.query_disc(spark, 8, (-0.25, 0.43, 0.87), math.radians(10)).collect())
    single = 100
    mask = spark.range(768).select(F.col("id").alias("ipix"), F.col("id").isin([*near, single]).alias("masked"))
    v = vectors(spark, 8)
    for options, holes in (({}, [*near, single]), ({"min_size": 2}, near), ({"min_area_arcmin2": 12 * 60 * 60 * 6.0}, near if len(near) * 53.7 > 72 else [])):
        want = np.arctan2(np.linalg.norm(np.cross(v[:, None], v[holes][None]), axis=2), v @ v[holes].T).min(axis=1)
        rows = graph.dist2holes(mask, 8, max_distance=0.5, **options).collect()
        assert len(rows) == 768 and max(abs(r.distance - min(0.5, want[r.ipix])) for r in rows) < 1e-9
    free = mask.select("ipix", F.lit(False).alias("masked"))
    assert graph.dist2holes(free, 8).select("distance").distinct().collect() == [(math.pi,)]
    whole = mask.select("ipix", F.lit(True).alias("masked"))
    assert graph.dist2holes(whole, 8).select("distance").distinct().collect() == [(0.0,)]
