"""Geodesy and local frames as column expressions. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth, metres of a degree, WGS84.
EARTH_RADIUS = 6371008.8
METRES_PER_DEGREE = 111320.0
SEMI_MAJOR = 6378137.0
ECC2 = 6.69437999014e-3
SEMI_MINOR = SEMI_MAJOR * math.sqrt(1 - ECC2)
ECC2_SECOND = (SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: large expressions stay small."""
    return F.get(F.transform(F.array(value), body), 0)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), F.lit(2))
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def flat_distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance on the plane that touches between the points; for neighbours."""
    x = (lng2 - lng1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    y = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(x * x + y * y)


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Compass bearing from the first point to the second, in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def signed_bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The bearing in (-180, 180]."""
    b = bearing_deg(lat1, lng1, lat2, lng2)
    return F.when(b > 180, b - 360).otherwise(b)


def xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return xyz(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def scale(a: Column, k: Column) -> Column:
    return xyz(a["x"] * k, a["y"] * k, a["z"] * k)


def dot3(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross3(a: Column, b: Column) -> Column:
    return xyz(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def distance3(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)) + F.pow(a["z"] - b["z"], F.lit(2)))


def rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q (struct w, x, y, z): v + 2w(u x v) + 2 u x (u x v)."""

    def turned(s):
        u, p = xyz(s["q"]["x"], s["q"]["y"], s["q"]["z"]), s["v"]
        return let(cross3(u, p), lambda once: add(add(p, scale(once, 2 * s["q"]["w"])), scale(cross3(u, once), F.lit(2.0))))

    return let(F.struct(q.alias("q"), v.alias("v")), turned)


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.cast("double").alias("w"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def multiply(a: Column, b: Column) -> Column:
    """Hamilton product: first b, then a."""
    signs = {"w": ("w+w", "x-x", "y-y", "z-z"), "x": ("w+x", "x+w", "y+z", "z-y"), "y": ("w+y", "x-z", "y+w", "z+x"), "z": ("w+z", "x+y", "y-x", "z+w")}

    def product(s):
        term = lambda t: (1.0 if t[1] == "+" else -1.0) * s["a"][t[0]] * s["b"][t[2]]
        return quaternion(*[sum((term(t) for t in signs[c]), F.lit(0.0)) for c in "wxyz"])

    return let(F.struct(a.alias("a"), b.alias("b")), product)


def conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def view_quaternion(theta: Column, phi: Column) -> Column:
    """Turn to a direction: about up by theta, then up by phi. Assumed order; the original was not to be seen."""
    turn = quaternion(F.cos(theta / 2), F.lit(0.0), F.sin(-theta / 2), F.lit(0.0))
    lift = quaternion(F.cos(phi / 2), F.sin(phi / 2), F.lit(0.0), F.lit(0.0))
    return multiply(turn, lift)


def observation_quaternion(pose: Column, theta: Column, phi: Column) -> Column:
    """The pose's orientation followed by the view's."""
    return multiply(pose, view_quaternion(theta, phi))


def opengl_ray(theta: Column, phi: Column) -> Column:
    """Unit ray in a camera that looks along -z, for an angle right of and above the centre of the panorama."""
    return xyz(F.cos(phi) * F.sin(theta), F.sin(phi), -F.cos(phi) * F.cos(theta))


def lift(position: Column, orientation: Column, theta: Column, phi: Column, depth: Column) -> Column:
    """The point at `depth` along a view from a pose; null where the depth is null or NaN."""
    usable = depth.isNotNull() & ~F.isnan(depth)
    return F.when(usable, add(position, scale(rotate(orientation, opengl_ray(theta, phi)), depth)))


def geodetic_to_ecef(lat: Column, lng: Column, alt: Column) -> Column:
    a, o = F.radians(lat), F.radians(lng)
    n = SEMI_MAJOR / F.sqrt(1 - ECC2 * F.sin(a) * F.sin(a))
    return xyz((n + alt) * F.cos(a) * F.cos(o), (n + alt) * F.cos(a) * F.sin(o), (n * (1 - ECC2) + alt) * F.sin(a))


def ecef_to_geodetic(p: Column) -> Column:
    """struct lat, lng, alt by one step of Bowring's method."""
    r = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
    t = F.atan2(p["z"] * SEMI_MAJOR, r * SEMI_MINOR)
    lat = F.atan2(p["z"] + ECC2_SECOND * SEMI_MINOR * F.pow(F.sin(t), F.lit(3)), r - ECC2 * SEMI_MAJOR * F.pow(F.cos(t), F.lit(3)))
    n = SEMI_MAJOR / F.sqrt(1 - ECC2 * F.sin(lat) * F.sin(lat))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lng"), (r / F.cos(lat) - n).alias("alt"))


def enu_to_ecef(origin_lat: Column, origin_lng: Column, origin_alt: Column, e: Column, n: Column, u: Column) -> Column:
    a, o = F.radians(origin_lat), F.radians(origin_lng)
    p = geodetic_to_ecef(origin_lat, origin_lng, origin_alt)
    return xyz(
        p["x"] - F.sin(o) * e - F.sin(a) * F.cos(o) * n + F.cos(a) * F.cos(o) * u,
        p["y"] + F.cos(o) * e - F.sin(a) * F.sin(o) * n + F.cos(a) * F.sin(o) * u,
        p["z"] + F.cos(a) * n + F.sin(a) * u,
    )


def eus_to_geodetic(origin_lat: Column, origin_lng: Column, origin_alt: Column, p: Column) -> Column:
    """East-up-south metres about an origin, as lat, lng, alt."""
    return ecef_to_geodetic(enu_to_ecef(origin_lat, origin_lng, origin_alt, p["x"], -p["z"], p["y"]))


def wds_to_eus(p: Column) -> Column:
    """West-down-south axes to east-up-south ones, and back."""
    return xyz(-p["x"], -p["y"], p["z"])


def heading_of_orientation(q: Column) -> Column:
    """Compass heading of a pose in east-up-south axes: where its camera's -z points; [0, 360)."""
    return let(rotate(q, xyz(F.lit(0.0), F.lit(0.0), F.lit(-1.0))), lambda f: F.pmod(F.degrees(F.atan2(f["x"], -f["z"])), F.lit(360.0)))


def rigid_inverse(q: Column, t: Column) -> Column:
    """struct q, t of the inverse of x -> rotate(q, x) + t."""
    back = conjugate(q)
    return F.struct(back.alias("q"), scale(rotate(back, t), F.lit(-1.0)).alias("t"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against an array of structs x, y; the ring may be open or closed. Decimals are compared and subtracted exactly."""
    n = F.size(ring)
    crossed = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda s, i: s
        + F.when(
            ((F.element_at(ring, i)["y"] > y) != (F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))["y"] > y))
            & (
                x.cast("double")
                < ((F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))["x"] - F.element_at(ring, i)["x"]) * (y - F.element_at(ring, i)["y"])).cast("double")
                / (F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))["y"] - F.element_at(ring, i)["y"]).cast("double")
                + F.element_at(ring, i)["x"].cast("double")
            ),
            1,
        ).otherwise(0),
    )
    return F.when(n >= 3, crossed % 2 == 1).otherwise(F.lit(False))


def level_of_height(height: Column, bands: Column) -> Column:
    """Value of the first band (array of structs value, low, high; sorted by value) that holds the height, bounds included; a null bound is open."""
    inside = F.filter(bands, lambda b: (b["low"].isNull() | (height >= b["low"])) & (b["high"].isNull() | (height <= b["high"])))
    return F.when(height.isNotNull() & ~F.isnan(height), F.get(inside, 0)["value"])


def ray_closest_approach(oi: Column, di: Column, oj: Column, dj: Column, parallel: float = 1e-8) -> Column:
    """struct distance, ti, tj of two lines with unit directions; of nearly parallel ones the distance of the second origin from the first ray.

    Parameters of nearly parallel lines are the shortest pair: offset along the first, halved between both.
    """

    def solved(s):
        c = cross3(s["di"], s["dj"])
        rel = xyz(s["oi"]["x"] - s["oj"]["x"], s["oi"]["y"] - s["oj"]["y"], s["oi"]["z"] - s["oj"]["z"])
        return F.struct((F.sqrt(dot3(c, c)) < parallel).alias("near"), dot3(s["di"], s["dj"]).alias("d"), dot3(s["di"], rel).alias("pi"), dot3(s["dj"], rel).alias("pj"), s.alias("s"))

    def placed(k):
        s, d, pi, pj, near = k["s"], k["d"], k["pi"], k["pj"], k["near"]
        den = F.when(near, F.lit(1.0)).otherwise(1 - d * d)
        sign = F.when(d >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        ti, tj = (d * pj - pi) / den, (pj - d * pi) / den
        apart = distance3(add(s["oi"], scale(s["di"], ti)), add(s["oj"], scale(s["dj"], tj)))
        flat = distance3(s["oj"], add(s["oi"], scale(s["di"], F.greatest(F.lit(0.0), -pi))))
        return F.struct(F.when(near, flat).otherwise(apart).alias("distance"), F.when(near, -pi / 2).otherwise(ti).alias("ti"), F.when(near, pi / 2 * sign).otherwise(tj).alias("tj"))

    return let(let(F.struct(oi.alias("oi"), di.alias("di"), oj.alias("oj"), dj.alias("dj")), solved), placed)
