"""Pixel geometry of the hierarchical equal-area iso-latitude grid as column expressions.

Every function takes columns (or plain numbers) and returns a column that
Catalyst compiles; none runs Python on executors.  ``nside`` may be a number,
which folds at planning, or a column.  A null argument gives null.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_PI, TWO_PI = math.pi / 2, 2 * math.pi
UNSEEN = -1.6375e30

# Ring and azimuth of each base face's southern corner.
_FACE_RING = [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]
_FACE_PHI = [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7]
_DIRECTIONS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))  # SW W NW N NE E SE S


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def long(x) -> Column:
    return F.lit(int(x)).cast("long") if isinstance(x, int) else col(x).cast("long")


def idiv(a, b) -> Column:
    return F.call_function("div", col(a), col(b))


def whole(x) -> Column:
    return F.floor(x).cast("long")


def pick(values: list[int], at: Column) -> Column:
    """values[at], zero-based."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: what composed functions share isn't written out again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def record(**fields) -> Column:
    return F.struct(*[col(v).alias(k) for k, v in fields.items()])


def isqrt(x: Column) -> Column:
    """Exact for all longs: the double's root is at most one off."""
    return let(record(x=x, s=whole(F.sqrt(x.cast("double")))), lambda r: r["s"] + F.when(r["s"] * r["s"] > r["x"], -1).when((r["s"] + 1) * (r["s"] + 1) <= r["x"], 1).otherwise(0))


# --- angles and vectors ----------------------------------------------------
def lonlat2theta(lat) -> Column:
    return F.lit(HALF_PI) - F.radians(col(lat))


def lonlat2phi(lon) -> Column:
    return F.radians(col(lon))


def folded_lonlat(lon, lat, bounce: bool = True) -> tuple[Column, Column]:
    """Latitudes beyond the poles come back: a bounce keeps the longitude, else it turns by 180 degrees."""
    lon, lat = col(lon), col(lat)
    turned = F.pmod(lat + 90, F.lit(360.0)) - 90
    over = turned > 90
    return F.when(over & F.lit(not bounce), lon + 180).otherwise(lon), F.when(over, F.lit(180.0) - turned).otherwise(turned)


def theta2lat(theta) -> Column:
    return F.lit(90.0) - F.degrees(col(theta))


def ang2vec(theta, phi) -> Column:
    s = F.sin(col(theta))
    return F.struct((s * F.cos(col(phi))).alias("x"), (s * F.sin(col(phi))).alias("y"), F.cos(col(theta)).alias("z"))


def lonlat2vec(lon, lat) -> Column:
    return ang2vec(lonlat2theta(lat), lonlat2phi(lon))


def vec2lonlat(x, y, z) -> Column:
    """(lon, lat) struct in degrees, lon in [0, 360)."""
    return record(lon=F.degrees(vec2phi(x, y)), lat=theta2lat(vec2theta(x, y, z)))


def unit(v: Column) -> Column:
    """A vector struct at length 1; null components for the null vector."""
    return let(v, lambda u: let(F.sqrt(u["x"] * u["x"] + u["y"] * u["y"] + u["z"] * u["z"]), lambda r: record(**{c: F.when(r > 0, u[c] / r) for c in "xyz"})))


def vec2theta(x, y, z) -> Column:
    x, y, z = map(col, (x, y, z))
    return F.atan2(F.sqrt(x * x + y * y), z)


def vec2phi(x, y) -> Column:
    return F.pmod(F.atan2(col(y), col(x)), F.lit(TWO_PI))


def angdist(v: Column, w: Column) -> Column:
    """Angle between two vector structs, good at all separations."""
    cross = [v[a] * w[b] - v[b] * w[a] for a, b in (("y", "z"), ("z", "x"), ("x", "y"))]
    return F.atan2(F.sqrt(reduce(lambda p, q: p + q, [c * c for c in cross])), v["x"] * w["x"] + v["y"] * w["y"] + v["z"] * w["z"])


# --- resolution ------------------------------------------------------------
def nside2npix(nside) -> Column:
    n = long(nside)
    return n * n * 12


def npix2nside(npix) -> Column:
    """Null unless npix is 12 nside ** 2."""
    s = isqrt(idiv(long(npix), F.lit(12)))
    return F.when(s * s * 12 == long(npix), s)


def nside2order(nside) -> Column:
    return F.when(is_nside(nside, nest=True), F.round(F.log2(col(nside).cast("double"))).cast("int"))


def order2nside(order) -> Column:
    return F.shiftleft(F.lit(1).cast("long"), order) if isinstance(order, int) else F.call_function("shiftleft", F.lit(1).cast("long"), col(order).cast("int"))


def is_nside(nside, nest: bool = False) -> Column:
    n = long(nside)
    ok = (n > 0) & (n <= 2**29)
    return ok & (n.bitwiseAND(n - 1) == 0) if nest else ok


def is_npix(npix) -> Column:
    return npix2nside(npix).isNotNull()


def order2npix(order) -> Column:
    return nside2npix(order2nside(order))


def npix2order(npix) -> Column:
    """Null unless npix is 12 * 4 ** order."""
    return nside2order(npix2nside(npix))


def theta_ok(theta) -> Column:
    """Whether a colatitude lies in 0..pi, but for what rounding adds."""
    return (col(theta) >= 0) & (col(theta) <= math.pi + 1e-5)


def min_valid_nside(npix) -> Column:
    return order2nside(F.greatest(F.lit(0), F.ceil(F.log2(col(npix) / 12.0) * 0.5)))


def nside2pixarea(nside, degrees: bool = False) -> Column:
    area = F.lit(4 * math.pi) / nside2npix(nside)
    return area * (180 / math.pi) ** 2 if degrees else area


def nside2resol(nside, arcmin: bool = False) -> Column:
    r = F.sqrt(nside2pixarea(nside))
    return F.degrees(r) * 60 if arcmin else r


def max_pixrad(nside, degrees: bool = False) -> Column:
    n = col(nside).cast("double")
    t = (1 - 1 / n) * (1 - 1 / n)
    z1 = F.lit(1.0) - t / 3
    a = F.struct((F.lit(math.sqrt(5) / 3) * F.cos(F.lit(math.pi / 4) / n)).alias("x"), (F.lit(math.sqrt(5) / 3) * F.sin(F.lit(math.pi / 4) / n)).alias("y"), F.lit(2 / 3).alias("z"))
    b = F.struct(F.sqrt(1 - z1 * z1).alias("x"), F.lit(0.0).alias("y"), z1.alias("z"))
    r = angdist(a, b)
    return F.degrees(r) if degrees else r


# --- positions to pixels ---------------------------------------------------
def _place(nside, z, phi, s=None) -> Column:
    """What both schemes need of a position (z, phi); ``s`` is sin(theta) where it is known."""
    n = long(nside)
    d = n.cast("double")
    start = record(n=n, z=z, s=F.lit(None).cast("double") if s is None else s, tt=F.pmod(F.pmod(col(phi), F.lit(TWO_PI)) / HALF_PI, F.lit(4.0)))

    def places(r):
        za = F.abs(r["z"])
        near = d * F.when((za > 0.99) & r["s"].isNotNull(), r["s"] / F.sqrt((za + 1) / 3)).otherwise(F.sqrt(F.greatest(F.lit(0.0), (1 - za) * 3)))
        t1, t2, tp = d * (r["tt"] + 0.5), d * r["z"] * 0.75, r["tt"] - F.floor(r["tt"])
        belt = za <= 2 / 3
        jp = F.when(belt, whole(t1 - t2)).otherwise(whole(tp * near))
        jm = F.when(belt, whole(t1 + t2)).otherwise(whole((1 - tp) * near))
        return record(n=r["n"], z=r["z"], tt=r["tt"], belt=belt, jp=jp, jm=jm)

    return let(start, places)


def zphi2ring(nside, z, phi, s=None) -> Column:
    def ring(p):
        n, jp, jm = p["n"], p["jp"], p["jm"]
        ir = n + 1 + jp - jm
        ip = idiv(jp + jm - n + 2 - ir.bitwiseAND(F.lit(1).cast("long")) + 4 * n, F.lit(2)) - 2 * n
        belt = 2 * n * (n - 1) + (ir - 1) * 4 * n + F.pmod(ip, 4 * n)
        cr = jp + jm + 1
        ci = F.pmod(whole(p["tt"] * cr), 4 * cr)
        return F.when(p["belt"], belt).when(p["z"] > 0, 2 * cr * (cr - 1) + ci).otherwise(12 * n * n - 2 * cr * (cr + 1) + ci)

    return let(_place(nside, z, phi, s), ring)


def zphi2xyf(nside, z, phi, s=None) -> Column:
    def xyf(p):
        n, jp, jm = p["n"], p["jp"], p["jm"]
        fp, fm = idiv(jp, n), idiv(jm, n)
        belt = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, fp).otherwise(fm + 8)
        quarter, cp, cm = F.least(F.lit(3).cast("long"), whole(p["tt"])), F.least(jp, n - 1), F.least(jm, n - 1)
        of = lambda b, u, v: F.when(p["belt"], b).when(p["z"] >= 0, u).otherwise(v)
        return record(x=of(jm % n, n - 1 - cm, cp), y=of(n - 1 - jp % n, n - 1 - cp, cm), face=of(belt, quarter, quarter + 8))

    return let(_place(nside, z, phi, s), xyf)


def _masked(x: Column, shifted, by: int, mask: int) -> Column:
    return let(x, lambda v: v.bitwiseOR(shifted(v, by)).bitwiseAND(F.lit(mask)))


def _spread(x: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = _masked(x, F.shiftleft, shift, mask)
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = _masked(x, F.shiftright, shift, mask)
    return x


def xyf2nest(nside, x, y, face) -> Column:
    n = long(nside)
    return long(face) * n * n + _spread(long(x)) + F.shiftleft(_spread(long(y)), 1)


def nest2xyf(nside, pix) -> Column:
    n, p = long(nside), long(pix)
    inner = p % (n * n)
    return record(x=_gather(inner), y=_gather(F.shiftright(inner, 1)), face=idiv(p, n * n))


def xyf2ring(nside, x, y, face) -> Column:
    n = long(nside)
    first = record(x=long(x), y=long(y), face=long(face), jr=pick(_FACE_RING, long(face)) * n - long(x) - long(y) - 1)

    def ring(r):
        jr = r["jr"]
        nr = F.when(jr < n, jr).when(jr > 3 * n, 4 * n - jr).otherwise(n)
        before = F.when(jr < n, 2 * jr * (jr - 1)).when(jr > 3 * n, 12 * n * n - 2 * (4 * n - jr) * (4 * n - jr + 1)).otherwise(2 * n * (n - 1) + (jr - n) * 4 * n)
        shift = F.when((jr < n) | (jr > 3 * n), F.lit(0)).otherwise((jr - n).bitwiseAND(F.lit(1).cast("long")))
        jp = idiv(pick(_FACE_PHI, r["face"]) * nr + r["x"] - r["y"] + 1 + shift + 8 * nr, F.lit(2)) - 4 * nr
        return before + F.pmod(jp - 1, 4 * nr)

    return let(first, ring)


def _ring(nside, pix) -> Column:
    """Of a RING pixel: its ring and the pixels of a quarter of it, the ring's start, the place in it, shift, z, phi and sin(theta)."""
    n = long(nside)
    npix, cap, d = 12 * n * n, 2 * n * (n - 1), n.cast("double")
    first = let(long(pix), lambda p: record(p=p, a=idiv(isqrt(2 * p + 1) + 1, F.lit(2)), b=idiv(isqrt(2 * (npix - p) - 1) + 1, F.lit(2))))

    def place(r):
        p, a, b = r["p"], r["a"], r["b"]
        north, south, belt = p < cap, p >= npix - cap, idiv(p - cap, 4 * n) + n
        start = F.when(north, 2 * a * (a - 1)).when(south, npix - 2 * b * (b + 1)).otherwise(cap + (belt - n) * 4 * n)
        return record(p=p, north=north, south=south, near=F.when(north, a).when(south, b).otherwise(n), ring=F.when(north, a).when(south, 4 * n - b).otherwise(belt), start=start)

    def angles(r):
        i, polar = r["near"].cast("double"), r["north"] | r["south"]
        t = i * i / (3 * d * d)
        z = F.when(r["north"], 1 - t).when(r["south"], t - 1).otherwise((2 * n - r["ring"]) * 2 / (3 * d))
        shift = F.when(polar | ((r["ring"] - n) % 2 == 0), 0.5).otherwise(0.0)
        s = F.sqrt(F.when(polar, t * (2 - t)).otherwise((1 - z) * (1 + z)))
        return record(ring=r["ring"], near=r["near"], start=r["start"], place=r["p"] - r["start"], shift=shift, z=z, phi=(r["p"] - r["start"] + shift) * HALF_PI / i, s=s)

    return let(let(first, place), angles)


def ring2xyf(nside, pix) -> Column:
    n = long(nside)

    def faced(r):
        ring, place = r["ring"], r["place"] + 1
        fm = idiv(place - idiv(ring - n + 1, F.lit(2)) + n - 1, n)
        fp = idiv(place - idiv(3 * n + 1 - ring, F.lit(2)) + n - 1, n)
        belt = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, fp).otherwise(fm + 8)
        quarter, polar = idiv(r["place"], r["near"]), (ring < n) | (ring > 3 * n)
        shift = F.when(polar, F.lit(0)).otherwise((ring - n).bitwiseAND(F.lit(1).cast("long")))
        return record(ring=ring, place=place, near=r["near"], shift=shift, face=F.when(ring < n, quarter).when(ring > 3 * n, quarter + 8).otherwise(belt))

    def shifted(r):
        ipt = 2 * r["place"] - pick(_FACE_PHI, r["face"]) * r["near"] - r["shift"] - 1
        return record(face=r["face"], irt=r["ring"] - pick(_FACE_RING, r["face"]) * n + 1, ipt=F.when(ipt >= 2 * n, ipt - 8 * n).otherwise(ipt))

    last = lambda r: record(x=F.shiftright(r["ipt"] - r["irt"], 1), y=F.shiftright(-r["ipt"] - r["irt"], 1), face=r["face"])
    return let(let(let(_ring(nside, pix), faced), shifted), last)


def ring2nest(nside, pix) -> Column:
    return let(ring2xyf(nside, pix), lambda r: xyf2nest(nside, r["x"], r["y"], r["face"]))


def nest2ring(nside, pix) -> Column:
    return let(nest2xyf(nside, pix), lambda r: xyf2ring(nside, r["x"], r["y"], r["face"]))


def xyf2pix(nside, x, y, face, nest: bool = False) -> Column:
    return xyf2nest(nside, x, y, face) if nest else xyf2ring(nside, x, y, face)


def pix2xyf(nside, pix, nest: bool = False) -> Column:
    return nest2xyf(nside, pix) if nest else ring2xyf(nside, pix)


def zphi2pix(nside, z, phi, nest: bool = False, s=None) -> Column:
    if not nest:
        return zphi2ring(nside, z, phi, s)
    return let(zphi2xyf(nside, z, phi, s), lambda r: xyf2nest(nside, r["x"], r["y"], r["face"]))


def ang2pix(nside, theta, phi, nest: bool = False, lonlat: bool = False) -> Column:
    """The pixel that holds a position: colatitude and longitude in radians, or with ``lonlat`` longitude and latitude in degrees. Null outside the sphere."""
    if lonlat:
        theta, phi = lonlat2theta(phi), lonlat2phi(theta)
    theta = col(theta)
    return F.when((theta >= 0) & (theta <= math.pi + 1e-5), zphi2pix(nside, F.cos(theta), phi, nest, F.sin(theta)))


def vec2pix(nside, x, y, z, nest: bool = False) -> Column:
    """The pixel in the direction of a vector of any length but 0."""
    x, y, z = (col(v).cast("double") for v in (x, y, z))
    r = F.sqrt(x * x + y * y + z * z)
    return zphi2pix(nside, z / r, F.atan2(y, x), nest, F.sqrt(x * x + y * y) / r)


def _of(nside, pix, nest):
    return _ring(nside, nest2ring(nside, pix) if nest else pix)


def pix2ang(nside, pix, nest: bool = False, lonlat: bool = False) -> Column:
    if lonlat:
        return let(_of(nside, pix, nest), lambda r: record(lon=F.degrees(r["phi"]), lat=theta2lat(F.atan2(r["s"], r["z"]))))
    return let(_of(nside, pix, nest), lambda r: record(theta=F.atan2(r["s"], r["z"]), phi=r["phi"]))


def pix2zphi(nside, pix, nest: bool = False) -> Column:
    return let(_of(nside, pix, nest), lambda r: record(z=r["z"], phi=r["phi"]))


def pix2vec(nside, pix, nest: bool = False) -> Column:
    return let(_of(nside, pix, nest), lambda r: record(x=r["s"] * F.cos(r["phi"]), y=r["s"] * F.sin(r["phi"]), z=r["z"]))


def pix2ring(nside, pix, nest: bool = False) -> Column:
    return _of(nside, pix, nest)["ring"]


def ringinfo(nside, ring) -> Column:
    """Start, length, cos and sin of colatitude, and shift of a ring numbered from 1."""
    n, i = long(nside), long(ring)
    start = F.when(i < n, 2 * i * (i - 1)).when(i > 3 * n, 12 * n * n - 2 * (4 * n - i) * (4 * n - i + 1)).otherwise(2 * n * (n - 1) + (i - n) * 4 * n)
    return let(_ring(nside, start), lambda r: record(startpix=r["start"], ringpix=4 * r["near"], costheta=r["z"], sintheta=r["s"], shifted=r["shift"] > 0))


# --- corners, neighbours, interpolation ------------------------------------
def _corner(face: int, u: float, v: float) -> tuple[float, float, float]:
    jr = _FACE_RING[face] - u - v
    nr, z = (jr, 1 - jr * jr / 3) if jr < 1 else (4 - jr, (4 - jr) ** 2 / 3 - 1) if jr > 3 else (1, (2 - jr) * 2 / 3)
    phi = math.pi / 4 * ((_FACE_PHI[face] * nr + u - v) % (8 * nr)) / nr if nr else 0
    s = math.sqrt(max(0, 1 - z * z))
    return round(s * math.cos(phi), 9) + 0.0, round(s * math.sin(phi), 9) + 0.0, round(z, 9) + 0.0


def face_point(face: Column, u: Column, v: Column) -> Column:
    """The vector at continuous coordinates of a base face."""
    first = record(jr=pick(_FACE_RING, face) - u - v, turn=pick(_FACE_PHI, face), across=u - v)

    def ringed(r):
        nr = F.when(r["jr"] < 1, r["jr"]).when(r["jr"] > 3, 4 - r["jr"]).otherwise(F.lit(1.0))
        z = F.when(r["jr"] < 1, 1 - r["jr"] * r["jr"] / 3).when(r["jr"] > 3, (4 - r["jr"]) * (4 - r["jr"]) / 3 - 1).otherwise((2 - r["jr"]) * 2 / 3)
        phi = F.when(nr > 0, F.pmod(r["turn"] * nr + r["across"], 8 * nr) * (math.pi / 4) / nr).otherwise(F.lit(0.0))
        return record(z=z, phi=phi)

    def vector(r):
        s = F.sqrt(F.greatest(F.lit(0.0), (1 - r["z"]) * (1 + r["z"])))
        return record(x=s * F.cos(r["phi"]), y=s * F.sin(r["phi"]), z=r["z"])

    return let(let(first, ringed), vector)


def boundaries(nside, pix, step: int = 1, nest: bool = False) -> Column:
    """Array of 4 * step points around a pixel, from the northern corner by west, south and east."""
    n = col(nside).cast("double")
    at = let(pix2xyf(nside, pix, nest), lambda r: record(u=(r["x"] + 0.5) / n, v=(r["y"] + 0.5) / n, face=r["face"]))

    def points(r):
        d, out = 0.5 / n, []
        for side in range(4):
            for k in range(step):
                t = 2 * k / step
                du, dv = ((1 - t, 1), (-1, 1 - t), (-1 + t, -1), (1, -1 + t))[side]
                out.append(face_point(r["face"], r["u"] + d * du, r["v"] + d * dv))
        return F.array(*out)

    return let(at, points)


def _adjacent() -> dict[tuple[int, int, int], tuple[int, tuple] | None]:
    """For a face and a step off it: the face beyond and how its coordinates follow, from corners the faces share.

    A pixel (x, y) of a 1 x 1 face's neighbour is found by mapping the four
    corners of the square beyond an edge to the face that has both corners of
    that edge; beyond a corner, to the face that has the corner but no edge of
    this face there (none where three faces meet).
    """
    corners = {f: {(u, v): _corner(f, u, v) for u, v in product((0, 1), repeat=2)} for f in range(12)}
    out = {}
    for f in range(12):
        beyond = {}
        for du, dv in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            edge = [(u, v) for u, v in product((0, 1), repeat=2) if (du and u == (du > 0)) or (dv and v == (dv > 0))]
            shared = {corners[f][e] for e in edge}
            g = next(g for g in range(12) if g != f and shared <= set(corners[g].values()))
            place = {p: e for e, p in corners[g].items()}
            there = {(e[0] - du, e[1] - dv): place[corners[f][e]] for e in edge}
            (a, pa), (b, pb) = there.items()
            # The square beyond has corners a, b on this side and two on the far side.
            far = {}
            for here, own in ((a, pa), (b, pb)):
                other = pb if own == pa else pa
                along = (other[0] - own[0], other[1] - own[1])
                far[here] = (own[0], 1 - own[1]) if along[0] else (1 - own[0], own[1])
            full = dict(there)
            for here, image in far.items():
                full[here[0] + du, here[1] + dv] = image
            o = full[0, 0]
            beyond[du, dv] = out[f, du, dv] = (g, o, (full[1, 0][0] - o[0], full[1, 0][1] - o[1]), (full[0, 1][0] - o[0], full[0, 1][1] - o[1]))
        for du, dv in product((-1, 1), repeat=2):
            point = corners[f][int(du > 0), int(dv > 0)]
            near = {f, beyond[du, 0][0], beyond[0, dv][0]}
            g = [g for g in range(12) if g not in near and point in corners[g].values()]
            if not g:
                out[f, du, dv] = None
                continue
            own = next(e for e, p in corners[g[0]].items() if p == point)
            out[f, du, dv] = (g[0], own, None, None)
    return out


_ADJACENT = _adjacent()


def _step(steps: Column, n: Column, x: Column, y: Column, face: Column, dx: int, dy: int):
    """(x, y, face) of the pixel one step away; face is null where there is none."""
    u, v = x + dx, y + dy
    code = F.when(u < 0, 0).when(u >= n, 2).otherwise(1) * 3 + F.when(v < 0, 0).when(v >= n, 2).otherwise(1)
    first = record(row=F.element_at(steps, (face * 9 + code).cast("int") + 1), a=F.pmod(u, n), b=F.pmod(v, n))

    def place(r):
        g, ox, oy, xx, xy, yx, yy = (F.element_at(r["row"], k) for k in range(1, 8))
        return record(x=ox * (n - 1) + xx * r["a"] + yx * r["b"], y=oy * (n - 1) + xy * r["a"] + yy * r["b"], face=g)

    return let(first, place)


def _steps() -> list[list]:
    """For each face and each of nine steps off it: face, origin and the images of both axes beyond; nulls where nothing is."""
    out = []
    for f, du, dv in product(range(12), (-1, 0, 1), (-1, 0, 1)):
        found = (f, (0, 0), (1, 0), (0, 1)) if du == dv == 0 else _ADJACENT[f, du, dv]
        g, o, ex, ey = found or (None, (0, 0), None, None)
        out.append([g, *o, *(ex or (0, 0)), *(ey or (0, 0))])
    return out


_STEPS = _steps()


def neighbours(nside, pix, nest: bool = False) -> Column:
    """The neighbours SW, W, NW, N, NE, E, SE, S of a pixel; -1 where there is none."""
    n = long(nside)

    def around(r):
        found = []
        for dx, dy in _DIRECTIONS:
            there = _step(r["steps"], n, r["at"]["x"], r["at"]["y"], r["at"]["face"], dx, dy)
            found.append(let(there, lambda t: F.coalesce(F.when(t["face"].isNotNull(), xyf2pix(nside, t["x"], t["y"], t["face"], nest)), F.lit(-1).cast("long"))))
        return F.array(*found)

    steps = F.array(*[F.array(*[F.lit(w).cast("long") for w in r]) for r in _STEPS])
    return let(record(at=pix2xyf(nside, pix, nest), steps=steps), around)


def interp_weights(nside, theta, phi, nest: bool = False, lonlat: bool = False) -> Column:
    """Four (pix, weight) structs whose weighted values interpolate a map at a position."""
    if lonlat:
        theta, phi = lonlat2theta(phi), lonlat2phi(theta)
    n, npix, d = long(nside), nside2npix(nside), long(nside).cast("double")
    last = 4 * n - 1

    def rings(r):
        z = F.cos(r["theta"])
        cap = whole(d * F.sqrt((1 - F.abs(z)) * 3))
        above = F.when(F.abs(z) <= 2 / 3, whole(d * (2 - z * 1.5))).when(z > 0, cap).otherwise(4 * n - cap - 1)
        return record(theta=r["theta"], phi=r["phi"], above=above)

    def pair(phi, i):
        def two(info):
            at = phi / (F.lit(TWO_PI) / info["ringpix"]) - F.when(info["shifted"], 0.5).otherwise(0.0)
            k = whole(at)
            return record(p=info["startpix"] + F.pmod(k, info["ringpix"]), q=info["startpix"] + F.pmod(k + 1, info["ringpix"]), w=at - k, theta=F.atan2(info["sintheta"], info["costheta"]))

        return let(ringinfo(nside, F.greatest(F.lit(1), F.least(i, last))), two)

    def both(r):
        return record(theta=r["theta"], top=r["above"] < 1, bottom=r["above"] >= last, a=pair(r["phi"], r["above"]), b=pair(r["phi"], r["above"] + 1))

    def weights(r):
        a, b, top, bottom = r["a"], r["b"], r["top"], r["bottom"]
        t = (r["theta"] - a["theta"]) / (b["theta"] - a["theta"])
        up, down = r["theta"] / b["theta"], (F.lit(math.pi) - r["theta"]) / (math.pi - a["theta"])
        spread_up, spread_down = (1 - up) * 0.25, (1 - down) * 0.25
        pix = [F.when(top, (b["p"] + 2) % 4).otherwise(a["p"]), F.when(top, (b["q"] + 2) % 4).otherwise(a["q"])]
        pix += [F.when(bottom, (a["p"] - npix + 6) % 4 + npix - 4).otherwise(b["p"]), F.when(bottom, (a["q"] - npix + 6) % 4 + npix - 4).otherwise(b["q"])]
        weight = [
            F.when(top, spread_up).when(bottom, (1 - a["w"]) * down + spread_down).otherwise((1 - a["w"]) * (1 - t)),
            F.when(top, spread_up).when(bottom, a["w"] * down + spread_down).otherwise(a["w"] * (1 - t)),
            F.when(top, (1 - b["w"]) * up + spread_up).when(bottom, spread_down).otherwise((1 - b["w"]) * t),
            F.when(top, b["w"] * up + spread_up).when(bottom, spread_down).otherwise(b["w"] * t),
        ]
        return F.array(*[record(pix=ring2nest(nside, p) if nest else p, weight=w) for p, w in zip(pix, weight, strict=True)])

    first = record(theta=col(theta).cast("double"), phi=F.pmod(col(phi).cast("double"), F.lit(TWO_PI)))
    return let(let(let(first, rings), both), weights)
