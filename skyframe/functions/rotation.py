"""Rotations and sky frames: a 3 x 3 matrix on the driver, nine literals in column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixel import ang2vec, col, let, lonlat2vec, record, vec2lonlat

# Mean obliquity and galactic pole and node of J2000, degrees.
OBLIQUITY = 23.4392911
POLE_RA, POLE_DEC, POLE_LON = 192.85948, 27.12825, 122.93192
FRAMES = {"G": "Galactic", "E": "Ecliptic", "C": "Equatorial"}

# Between frames, the longitude of the node in the new and in the old one, sine and cosine of the tilt; by equinox.
NODES = {
    "J2000": {
        "CG": (0.57477043300, 4.9368292465, 0.88998808748, 0.45598377618),
        "CE": (0.0, 0.0, 0.39777715593, 0.91748206207),
        "EG": (0.11142137093, 4.71279419371, 0.86766622025, 0.49714719172),
    },
    "B1950": {
        "CG": (0.57595865315, 4.9261918136, 0.88781538514, 0.46019978478),
        "CE": (0.0, 0.0, 0.39788119938, 0.91743694670),
        "EG": (0.11129056012, 4.7005372834, 0.86766174755, 0.49715499774),
    },
}
#: What the numbers 1 to 6 stand for: from and to.
SELECT = ("CG", "GC", "CE", "EC", "EG", "GE")


def _about(axis: int, angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    i, j = ((1, 2), (2, 0), (0, 1))[axis]
    m = np.eye(3)
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = -s, s
    return m


def euler_matrix(angles, kind: str = "ZYX", degrees: bool = True) -> np.ndarray:
    """The matrix of up to three angles; the second counts the other way round, as a latitude does."""
    a, b, c = [math.radians(x) if degrees else x for x in (*angles, 0.0, 0.0, 0.0)[:3]]
    second, third = {"ZYX": (1, 0), "Y": (1, 2), "X": (0, 2)}[kind]
    return (_about(2, a) @ _about(second, -b) @ _about(third, c)).T


def _from_equatorial(frame: str) -> np.ndarray:
    if frame == "C":
        return np.eye(3)
    if frame == "E":
        return _about(0, math.radians(-OBLIQUITY))
    if frame == "G":
        ra, dec, lon = map(math.radians, (POLE_RA, POLE_DEC, POLE_LON))
        return _about(2, lon - math.pi) @ _about(1, dec - math.pi / 2) @ _about(2, -ra)
    raise ValueError(f"unknown frame {frame!r}: G, E or C")


def frame_matrix(of: str, to: str) -> np.ndarray:
    return _from_equatorial(to) @ _from_equatorial(of).T


def node_matrix(of: str, to: str, fk4: bool = False) -> np.ndarray:
    """The matrix between frames by their nodes, of equinox 2000, or with ``fk4`` of 1950 for equatorial and ecliptic ones."""
    table = NODES["B1950" if fk4 else "J2000"]
    if of + to not in table:
        return node_matrix(to, of, fk4).T
    new, old, s, c = table[of + to]
    return _about(2, new) @ np.array([[1, 0, 0], [0, c, s], [0, -s, c]]) @ _about(2, -old)


def euler(lon, lat, select: int, fk4: bool = False) -> Column:
    """(lon, lat) struct in degrees, lon in [0, 360), of a direction in another frame; ``select`` as in ``SELECT``, from 1."""
    if not 1 <= select <= len(SELECT):
        raise ValueError("select is a number from 1 to 6")
    turn = Rotator(matrix=node_matrix(*SELECT[select - 1], fk4))
    return let(turn.vector(lonlat2vec(lon, lat)), lambda v: vec2lonlat(v["x"], v["y"], v["z"]))


def _frame_letter(name: str) -> str:
    letter = {"Q": "C"}.get(name.strip().upper()[:1], name.strip().upper()[:1])
    if letter not in FRAMES:
        raise ValueError(f"unknown frame {name!r}: G, E or C")
    return letter


def _frames(coord) -> tuple[str, str] | None:
    """A pair of frames, of two letters or names; one alone stands for no change."""
    if coord is None:
        return None
    names = [coord] if isinstance(coord, str) and (len(coord) != 2) else list(coord)
    if not 1 <= len(names) <= 2:
        raise ValueError("a step goes from one frame to another")
    return _frame_letter(names[0]), _frame_letter(names[-1])


class Rotator:
    """A rotation: first from frame to frame (``coord``), then by angles (``rot``); ``*`` composes, right first.

    Sequences of angles, of pairs of frames, or of both in the same number give
    steps, the last of which is applied first; ``inverse`` is one for all or one each.
    """

    def __init__(self, rot=None, coord=None, inverse: bool | list = False, kind: str = "ZYX", matrix=None, degrees: bool = True):
        many_rots = isinstance(rot, (list, tuple, np.ndarray)) and any(isinstance(r, (list, tuple, np.ndarray)) for r in rot)
        many_coords = isinstance(coord, (list, tuple)) and any(not isinstance(c, str) for c in coord)
        if (many_rots or many_coords) and rot is not None and coord is not None and (many_rots != many_coords or len(rot) != len(coord)):
            raise ValueError("angles and frames must be single or sequences of the same length")
        n = len(rot) if many_rots else len(coord) if many_coords else 1
        rots, coords = (list(rot) if many_rots else [rot] * n), (list(coord) if many_coords else [coord] * n)
        inverses = list(inverse) if isinstance(inverse, (list, tuple)) else [bool(inverse)] * n
        if len(inverses) != n:
            raise ValueError("there must be one inverse for all steps or one for each")
        #: (angles, frames, inverse) of each step.
        self.steps = [(r, _frames(c), i) for r, c, i in zip(rots, coords, inverses, strict=True)]
        self.matrix = np.eye(3) if matrix is None else np.asarray(matrix, float)
        if matrix is not None and rot is None and coord is None:
            self.matrix = self.matrix.T if inverses[0] else self.matrix
            return
        for r, c, i in self.steps:
            m = np.eye(3) if c is None else frame_matrix(*c)
            if r is not None:
                m = euler_matrix(r if np.ndim(r) else (r,), kind, degrees) @ m
            self.matrix = self.matrix @ (m.T if i else m)

    def _of(self, matrix: np.ndarray, steps: list) -> Rotator:
        out = Rotator(matrix=matrix)
        out.steps = steps
        return out

    def __mul__(self, other: Rotator) -> Rotator:
        if not isinstance(other, Rotator):
            raise TypeError("a rotation is composed with another one")
        return self._of(self.matrix @ other.matrix, self.steps + other.steps)

    def __eq__(self, other) -> bool:
        return isinstance(other, Rotator) and np.allclose(self.matrix, other.matrix, atol=1e-15)

    @property
    def consistent(self) -> bool:
        """Whether each step starts in the frame in which the one after it in the list ends."""
        pairs = [(c[i], c[not i]) if c else (None, None) for _, c, i in self.steps]
        return all(of == to for (of, _), (_, to) in zip(pairs, pairs[1:]))

    @property
    def coord_in(self) -> str | None:
        """The frame that goes in; None without one, or if steps don't fit together."""
        _, c, i = self.steps[-1]
        return c[bool(i)] if c and self.consistent else None

    @property
    def coord_out(self) -> str | None:
        _, c, i = self.steps[0]
        return c[not i] if c and self.consistent else None

    @property
    def coord_names(self) -> tuple[str | None, str | None]:
        return FRAMES.get(self.coord_in), FRAMES.get(self.coord_out)

    def __call__(self, *place, lonlat: bool = False, inverse: bool = False) -> Column:
        """Turned: a vector struct; x, y, z; theta, phi; or with ``lonlat`` longitude and latitude in degrees. Comes back as it went in."""
        turn = self.inverse if inverse else self
        if len(place) == 1:
            return turn.vector(col(place[0]))
        if len(place) == 3:
            return turn.vector(record(x=col(place[0]), y=col(place[1]), z=col(place[2])))
        if len(place) != 2:
            raise TypeError("one, two or three columns are turned")
        if lonlat:
            return let(turn.vector(lonlat2vec(*place)), lambda v: vec2lonlat(v["x"], v["y"], v["z"]))
        return turn.direction(*place)

    __hash__ = None

    @property
    def inverse(self) -> Rotator:
        return self._of(self.matrix.T, [(r, c, not i) for r, c, i in self.steps[::-1]])

    @property
    def does_rotate(self) -> bool:
        return not np.allclose(self.matrix, np.eye(3), atol=1e-15)

    def vector(self, v: Column) -> Column:
        m = self.matrix.tolist()
        return record(**{k: reduce(lambda p, q: p + q, [v[c] * row[i] for i, c in enumerate("xyz")]) for k, row in zip("xyz", m, strict=True)})

    def direction(self, theta, phi) -> Column:
        """(theta, phi) struct; phi in (-pi, pi]."""
        v = self.vector(ang2vec(theta, phi))
        return record(theta=F.atan2(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]), v["z"]), phi=F.atan2(v["y"], v["x"]))

    def angle_ref(self, theta, phi) -> Column:
        """By how much a polarisation angle at a direction grows."""
        v = self.vector(ang2vec(theta, phi))
        p = self.matrix[:, 2].tolist()
        dot = v["x"] * p[0] + v["y"] * p[1] + v["z"] * p[2]
        return F.atan2(v["y"] * p[0] - v["x"] * p[1], F.lit(p[2]) - v["z"] * dot)
