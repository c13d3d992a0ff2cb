"""Cells of mixed depth against every pixel, one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.operators import coverage, regions

R = np.random.default_rng(8)


@pytest.fixture(scope="module")
def grids(spark):
    """NEST pixel centres by nside."""
    out = {}
    for nside in (16, 64, 128):
        rows = spark.range(12 * nside * nside).select("id", P.pix2vec(nside, "id", True).alias("v")).select("id", "v.*").toPandas().sort_values("id")
        out[nside] = rows[["x", "y", "z"]].to_numpy()
    return out


def pixels(rows):
    out = {}
    for r in rows:
        own = out.setdefault(r.key, [])
        assert r.first <= r.last
        own.append((r.first, r.last))
    for own in out.values():
        own.sort()
        assert all(b > a + 1 for (_, a), (b, _) in zip(own, own[1:]))  # runs neither touch nor overlap
    return {k: [i for a, b in own for i in range(a, b + 1)] for k, own in out.items()}


def by_force(depth, grids, nside, inclusive, fact):
    if not inclusive:
        return np.flatnonzero(depth(grids[nside]) >= 0).tolist()
    fine = np.flatnonzero(depth(grids[nside * fact]) >= -coverage.max_pixrad(nside * fact))
    return sorted({int(i) // fact**2 for i in fine})


def angle(points, c):
    return np.arctan2(np.linalg.norm(np.cross(points, c), axis=1), points @ c)


@pytest.mark.parametrize(("nside", "inclusive", "fact"), [(64, False, 1), (64, True, 2), (64, True, 1), (16, True, 4)])
def test_discs_polygons_and_strips(spark, grids, nside, inclusive, fact):
    centres = R.normal(size=(6, 3))
    radii = [0.3, 1.4, 2.9, 3.2, 0.004, 0.0]
    rows = [(k, *map(float, c), r) for k, (c, r) in enumerate(zip(centres, radii, strict=True))]
    table = spark.createDataFrame(rows, "key int, x double, y double, z double, r double")
    got = pixels(coverage.covered_ranges(coverage.discs(table, F.struct("x", "y", "z"), F.col("r")), ["key"], nside, inclusive, fact).collect())
    for k, c in enumerate(centres):
        assert got.get(k, []) == by_force(lambda p, c=c, k=k: radii[k] - angle(p, c / np.linalg.norm(c)), grids, nside, inclusive, fact), k

    around = [[(math.cos(a) * w, math.sin(a) * w, 1.0) for a in np.arange(0, 2 * math.pi, 2 * math.pi / n)] for n, w in ((3, 0.9), (4, 0.1), (5, 3.0), (7, 0.01))]
    turns = [np.linalg.qr(R.normal(size=(3, 3)))[0] for _ in around]
    shapes = [(np.array(s) @ t)[:: (-1) ** k] for k, (s, t) in enumerate(zip(around, turns, strict=True))]
    rows = [(k, [tuple(map(float, v)) for v in s]) for k, s in enumerate(shapes)]
    table = spark.createDataFrame(rows, "key int, corners array<struct<x: double, y: double, z: double>>")
    got = pixels(coverage.covered_ranges(coverage.polygons(table, F.col("corners")), ["key"], nside, inclusive, fact).collect())
    for k, s in enumerate(shapes):
        n = np.cross(s, np.roll(s, -1, axis=0))
        n /= np.linalg.norm(n, axis=1)[:, None]
        n *= np.sign(n[0] @ s[2])
        assert got.get(k, []) == by_force(lambda p, n=n: np.arcsin(np.clip((p @ n.T).min(axis=1), -1, 1)), grids, nside, inclusive, fact), k

    thetas = [(0.4, 1.3), (2.0, 1.0), (0.0, 0.02), (1.5707, 1.5709), (3.0, 3.1), (0.0001, 0.0002)]
    table = spark.createDataFrame([(k, *t) for k, t in enumerate(thetas)], "key int, a double, b double")
    got = pixels(coverage.covered_ranges(coverage.strips(table, F.col("a"), F.col("b")), ["key"], nside, inclusive, fact).collect())
    for k, (a, b) in enumerate(thetas):
        theta = lambda p: np.arctan2(np.hypot(p[:, 0], p[:, 1]), p[:, 2])
        depth = (lambda p, a=a, b=b: np.minimum(theta(p) - a, b - theta(p))) if a < b else (lambda p, a=a, b=b: np.maximum(theta(p) - a, b - theta(p)))
        assert got.get(k, []) == by_force(depth, grids, nside, inclusive, fact), k


def test_cells_go_with_the_border(spark):
    table = spark.createDataFrame([(1, 0.3, -0.2, 0.9, 1.0)], "key int, x double, y double, z double, r double")
    sizes = []
    for nside in (64, 128, 256):
        shaped = coverage.discs(table, F.struct("x", "y", "z"), F.col("r"))
        n = coverage.cells(shaped, ["key"], nside).count()
        sizes.append(n)
        assert n < 40 * nside and coverage.covered_ranges(shaped, ["key"], nside).count() < 10 * nside
    assert sizes[2] / sizes[1] < 2.3 and sizes[1] / sizes[0] < 2.3


def test_asserted_cases(spark):
    v = (0.17101007, 0.03015369, 0.98480775)
    ids = lambda df: sorted(r.ipix for r in df.collect())
    assert ids(regions.query_disc(spark, 8, v, math.radians(6), inclusive=True)) == [0, 3, 4, 5, 11, 12, 13, 23]
    assert ids(regions.query_disc(spark, 6, v, math.radians(6), inclusive=True, fact=3)) != []
    corner = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    centre = ids(regions.query_polygon(spark, 8, corner))
    wide = ids(regions.query_polygon(spark, 8, corner, inclusive=True))
    assert set(centre) < set(wide) and len(wide) < 2 * len(centre)
    none = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 1e-10), (2, None, 0.0, 0.0, 0.1), (3, 1.0, 0.0, 0.0, None)], "key int, x double, y double, z double, r double")
    assert coverage.covered_ranges(coverage.discs(none, F.struct("x", "y", "z"), F.col("r")), ["key"], 8).count() == 0
    with pytest.raises(ValueError, match="powers"):
        coverage.cells(coverage.discs(none, F.struct("x", "y", "z"), F.col("r")), ["key"], 12)
    bow = spark.createDataFrame([(1, [(1.0, 0.0, 0.1), (0.9, 0.5, 0.1), (0.9, 0.2, 0.3), (0.9, 0.25, 0.1)])], "key int, c array<struct<x: double, y: double, z: double>>")
    with pytest.raises(Exception, match="convex"):
        coverage.covered_ranges(coverage.polygons(bow, F.col("c")), ["key"], 8).count()


def test_runs_across_blocks(spark):
    for trial in range(4):
        ids = sorted({int(i) for i in R.integers(0, 400, size=220 + 40 * trial)})
        rows = spark.createDataFrame([(k, i, i) for k in (1, None) for i in ids], "key int, first long, last long")
        runs = []
        for i in ids:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        got = coverage.joined(rows.unionAll(rows), ["key"], 3).collect()
        for key in (1, None):
            assert sorted([r.first, r.last] for r in got if r.key == key) == runs
    assert coverage.joined(rows.where("false"), [], 3).count() == 0


def test_points_in_ranges_of_many_regions(spark):
    table = spark.createDataFrame([(1, 0.3, -0.2, 0.9, 0.5), (2, 0.0, 0.0, -1.0, 1.2), (3, 0.3, -0.2, 0.9, 0.1)], "key int, x double, y double, z double, r double")
    found = coverage.covered_ranges(coverage.discs(table, F.struct("x", "y", "z"), F.col("r")), ["key"], 64).cache()
    points = spark.range(0, 12 * 64 * 64, 7).select(F.col("id").alias("ipix"), (F.col("id") * 2).alias("point"))
    got = coverage.in_nest_ranges(points, found, ["key"], 64)
    want = points.crossJoin(found).where("ipix between first and last").select("ipix", "point", "key")
    assert got.select("ipix", "point", "key").exceptAll(want).isEmpty() and got.count() == want.count()
