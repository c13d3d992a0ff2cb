"""Rotations: sequences of steps, frames, calls, properties and the node tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions.rotation import NODES, SELECT, Rotator, euler, euler_matrix, frame_matrix, node_matrix


def test_sequences():
    one, two = Rotator(coord=("G", "E")), Rotator(coord="EC", rot=(10, 20, 30))
    both = Rotator(coord=[("E", "C"), ("G", "E")], rot=[(10, 20, 30), None])
    assert both == two * one and both.consistent and (both.coord_in, both.coord_out) == ("G", "C") and both.coord_names == ("Galactic", "Equatorial")
    assert (two * one).coord_in == "G" and not (one * two).consistent and (one * two).coord_in is None
    back = Rotator(coord=[("E", "C"), ("G", "E")], inverse=[True, False])
    assert np.allclose(back.matrix, frame_matrix("E", "C").T @ frame_matrix("G", "E")) and not back.consistent
    assert both.inverse.coord_in == "C" and (both * both.inverse).does_rotate is False
    assert Rotator(rot=(math.pi / 6, 0.1), degrees=False) == Rotator(rot=(30, math.degrees(0.1)))
    assert np.allclose(Rotator(rot=[(30, 0, 0), (10, 0, 0)]).matrix, euler_matrix((40, 0, 0)))
    assert Rotator(coord="galactic").does_rotate is False and Rotator(coord=("Q", "E")) == Rotator(coord="CE")


def test_wrong_arguments():
    for rot, coord in (([(0, 0, 90)], [("C", "E"), ("E", "G")]), ([(0, 0, 90)], "CE"), ((0, 0, 90), [("C", "E"), ("E", "G")])):
        with pytest.raises(ValueError, match="same length"):
            Rotator(coord=coord, rot=rot)
    with pytest.raises(ValueError, match="inverse"):
        Rotator(coord=[("C", "E"), ("E", "G")], inverse=[True])
    with pytest.raises(ValueError, match="unknown frame"):
        Rotator(coord="XY")
    with pytest.raises(TypeError):
        Rotator(coord="CE") * 2
    with pytest.raises(ValueError, match="1 to 6"):
        euler(0.0, 0.0, 7)


def test_calls(spark):
    r = Rotator(coord="GE")
    row = spark.range(1).select(
        r(F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).alias("v"),
        r(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("w"),
        r(F.lit(math.pi / 2), F.lit(0.0)).alias("d"),
        r(F.lit(0.0), F.lit(0.0), lonlat=True).alias("l"),
        r(*[F.lit(x) for x in (1.66742347999, -1.6259571125)], inverse=True).alias("back"),
    ).first()
    assert [row.v.x, row.v.y, row.v.z] == pytest.approx([-0.05487563, -0.99382135, -0.09647686], abs=1e-5) and row.w == row.v
    assert (row.d.theta, row.d.phi) == pytest.approx((1.66742347999, -1.6259571125), abs=1e-5)
    assert (row.l.lon, row.l.lat) == pytest.approx((360 + math.degrees(row.d.phi), 90 - math.degrees(row.d.theta)))
    assert (row.back.theta, row.back.phi) == pytest.approx((math.pi / 2, 0.0), abs=1e-5)


def test_node_tables(spark):
    for of, to in SELECT:
        assert np.allclose(node_matrix(of, to), frame_matrix(of, to), atol=2e-6)  # both of 2000
        m = node_matrix(of, to, fk4=True)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9) and np.allclose(m, node_matrix(to, of, fk4=True).T)
    assert np.allclose(node_matrix("E", "G", True) @ node_matrix("C", "E", True), node_matrix("C", "G", True), atol=1e-6)
    assert abs(node_matrix("C", "G", True) - node_matrix("C", "G")).max() > 1e-3 and set(NODES) == {"J2000", "B1950"}
    pole = spark.range(1).select(euler(F.lit(192.25), F.lit(27.4), 1, fk4=True).alias("p"), euler(F.lit(33.0), F.lit(0.0), 2, fk4=True).alias("q")).first()
    assert pole.p.lat == pytest.approx(90, abs=1e-4) and pole.q.lat == pytest.approx(0, abs=1e-4) and pole.q.lon == pytest.approx(282.25, abs=1e-4)
