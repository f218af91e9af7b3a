"""Geodesy, panorama geometry, boxes and joins by distance over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import boxes as B
from terravane.functions import geodesy as G
from terravane.functions import panorama as P
from terravane.operators import spatial as S
from terravane.operators import suppression as U
from terravane.plans import inputs as I

R = lambda c, n, name: F.round(c, n).alias(name)


def distances_and_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.points(spark, sf_dir)
    a = (F.col("lat"), F.col("lng"), F.lit(48.86), F.lit(2.36))
    return p.select("id", R(G.haversine_m(*a), 3, "metres"), R(G.flat_distance_m(*a), 3, "flat"), R(G.bearing_deg(*a), 4, "bearing"), R(G.signed_bearing_deg(*a), 4, "signed"))


def earth_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the globe there and back."""
    p = I.points(spark, sf_dir).withColumn("e", G.geodetic_to_ecef(F.col("lat"), F.col("lng"), F.col("accuracy") * 10))
    b = G.ecef_to_geodetic(F.col("e"))
    return p.select("id", *[R(F.col(f"e.{k}"), 3, k) for k in "xyz"], R(b["lat"], 7, "lat"), R(b["lng"], 7, "lng"), R(b["alt"], 3, "alt"))


def lifted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates at their depth along their view from their pose."""
    c, p = I.candidates(spark, sf_dir), I.poses(spark, sf_dir)
    j = c.join(F.broadcast(p), ["geo_ref", "keyframe"])
    q = G.quaternion(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz"))
    at = G.lift(G.xyz(F.col("px"), F.col("py"), F.col("pz")), q, F.col("theta"), F.col("phi"), F.col("depth"))
    return j.select("id", R(at["x"], 4, "x"), R(at["y"], 4, "y"), R(at["z"], 4, "z"), R(G.heading_of_orientation(q), 4, "heading"))


def panorama_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of views as ratios, one row for each part of a wrapped box, and areas."""
    c = I.candidates(spark, sf_dir).select("id", (F.col("theta") * 2.2).alias("theta"), "phi", "width", "height")
    b = c.withColumn("box", P.box_ratios(F.col("theta"), F.col("phi"), F.col("width"), F.col("height")))
    parts = b.select("id", R(P.area_deg2(F.col("width"), F.col("height")), 4, "area"), P.renderable(F.col("width"), F.col("height")).alias("renderable"), F.posexplode(P.wrapped_boxes(F.col("box"))).alias("part", "r"))
    return parts.select("id", "area", "renderable", "part", *[R(F.col(f"r.{k}"), 6, k) for k in ("u0", "u1", "v0", "v1")])


def cutout_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir)
    uv = P.cutout_to_uv(F.col("theta"), F.col("phi"), F.col("width"), F.col("height"), F.lit(0.25), F.lit(0.8))
    return c.select("id", R(uv["u"], 6, "u"), R(uv["v"], 6, "v"))


def view_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit quaternions of views composed with poses (the order is an assumption)."""
    j = I.candidates(spark, sf_dir).join(F.broadcast(I.poses(spark, sf_dir)), ["geo_ref", "keyframe"])
    q = G.observation_quaternion(G.quaternion(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")), F.col("theta"), F.col("phi"))
    return j.select("id", *[R(q[k], 6, k) for k in "wxyz"], R(sum((q[k] * q[k] for k in "wxyz"), F.lit(0.0)), 6, "length"))


def box_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes clipped to an image, with their share of it and aspect within bounds."""
    w, h = B.clipped_size(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 100, 100)
    b = I.boxes(spark, sf_dir).select("id", w.alias("w"), h.alias("h")).where("w > 0 AND h > 0")
    sized = b.select("id", (F.col("w") * F.col("h") / 10000).alias("share"), (F.col("w") / F.greatest(F.col("h"), F.lit(1e-6))).alias("aspect"))
    return sized.where(F.col("share").between(0.002, 0.12) & F.col("aspect").between(0.25, 4.0)).select("id", R(F.col("share"), 6, "share"), R(F.col("aspect"), 6, "aspect"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of boxes of one keyframe, planar and on the sphere."""
    names = ("x0", "y0", "x1", "y1")
    box = lambda s: B.box(*[F.col(f"{s}_{n}") for n in names])
    view = lambda s: P.bfov(*[F.col(f"{s}_{n}") for n in names], F.lit(200.0), F.lit(100.0))
    measures = [R(B.iou(box("a"), box("b")), 6, "iou"), R(P.bfov_iou(view("a"), view("b")), 6, "spherical")]
    j = U.overlapping_pairs(I.boxes(spark, sf_dir), ["keyframe"], list(names), 0.55, measures)
    return j.select(F.col("a").alias("id"), F.col("b").alias("id2"), "iou", "spherical")


def cubemap_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panorama boxes on the cube's faces, at most four of the best of each face and keyframe."""
    b = I.boxes(spark, sf_dir).withColumn("f", P.box_on_face(F.col("x0") * 2, F.col("y0"), F.col("x1") * 2, F.col("y1"), F.lit(260.0), F.lit(140.0), 512)).where("f IS NOT NULL")
    top = U.best_of(b.select("id", "keyframe", "score", F.col("f.face").alias("face"), *[F.col(f"f.{k}").alias(f"f{k}") for k in ("x0", "y0", "x1", "y1")]), ["keyframe", "face"], 4, [F.desc("score"), F.asc("id")])
    return top.select("id", "keyframe", "face", *[R(F.col(f"f{k}"), 3, k) for k in ("x0", "y0", "x1", "y1")])


def depth_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 331 % 65536).alias("raw"))
    return raw.select("id", R(P.decode_depth(F.col("raw")), 6, "metres"), R(P.decode_depth(F.col("raw"), root=False), 6, "linear"))


def nearest_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir)
    p = P.nearest_pixel(F.col("theta"), F.col("phi"), F.lit(5760), F.lit(2880))
    return c.select("id", p["col"].alias("col"), p["row"].alias("row"))


def level_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first band that holds each candidate's height."""
    bands = spark.createDataFrame([(-1, None, -0.5), (0, -0.5, 0.2), (1, 0.2, 0.9), (2, 0.8, None)], "value int, low double, high double")
    return S.in_band(I.candidates(spark, sf_dir).select("id", "y"), bands, "y").select("id", "level")


def points_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each class inside a region on a level, most first; some lie on its edges' ends, so degrees are decimals of five places."""
    exact = lambda c: c.cast("decimal(10,5)")
    ring = F.array(*[F.struct(exact(F.lit(x)).alias("x"), exact(F.lit(y)).alias("y")) for x, y in ((2.352, 48.852), (2.372, 48.853), (2.378, 48.866), (2.36, 48.858))])
    p = I.points(spark, sf_dir).where(G.point_in_ring(exact(F.col("lng")), exact(F.col("lat")), ring) & F.col("level").eqNullSafe(F.lit(1)))
    return p.groupBy("class_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class_name")


def near_point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of candidates of a map within 3 m."""
    c = I.candidates(spark, sf_dir).where("placed").select("geo_ref", "id", "x", "y", "z")
    p = S.near_pairs(c, 3.0, ["geo_ref"])
    return p.select("geo_ref", "a", "b", R(F.col("distance"), 6, "distance"))


def nearest_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prediction with its nearest annotation of the prompt within 60 m, else -1."""
    a = I.points(spark, sf_dir).select("prompt", F.col("id").alias("annotation"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    n = S.nearest(I.predictions(spark, sf_dir), a, ["prompt"], 60.0, "id", "annotation")
    return n.select("id", "annotation", R(F.col("distance"), 4, "distance"))


def nearest_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = I.points(spark, sf_dir).select(F.col("id").alias("marker"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("level").alias("r_level"))
    p = I.predictions(spark, sf_dir).select("id", "lat", "lng", F.when(F.col("level") < 3, F.col("level")).alias("level"))
    return S.nearest_marker(p, a, 40.0, "id").select("id", "marker", R(F.col("distance"), 4, "distance"))


def annotation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of annotations of one prompt and class within 40 m."""
    p = I.points(spark, sf_dir).select("prompt", "class_name", "id", "lat", "lng")
    o = p.select("prompt", "class_name", F.col("id").alias("other"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    return S.within_accuracy(p, o, ["prompt", "class_name"], F.lit(40.0), 40.0).where("id < other").select("id", "other", R(F.col("distance"), 4, "distance"))


def neighbour_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other keyframes of a map on the same level, on the floor about each keyframe."""
    p = I.poses(spark, sf_dir).select("geo_ref", "keyframe", (F.col("keyframe") % 3).alias("level"), "px", "pz")
    o = p.select("geo_ref", F.col("keyframe").alias("other"), F.col("level"), F.col("px").alias("ox"), F.col("pz").alias("oz"))
    return p.join(o, ["geo_ref", "level"]).where("keyframe <> other").select("geo_ref", "keyframe", "other", R(F.col("ox") - F.col("px"), 4, "x"), R(F.col("oz") - F.col("pz"), 4, "z"))


def view_cones(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.poses(spark, sf_dir)
    c = P.view_cone(F.col("px"), F.col("pz"), F.col("keyframe") * 30.0, 60.0, 5.0)
    return p.select("geo_ref", "keyframe", F.posexplode(c).alias("i", "p")).select("geo_ref", "keyframe", "i", R(F.col("p.x"), 4, "x"), R(F.col("p.z"), 4, "z"))


def ray_approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest approach of the views of each candidate and the next one by id of its map."""
    j = I.candidates(spark, sf_dir).join(F.broadcast(I.poses(spark, sf_dir)), ["geo_ref", "keyframe"])
    r = j.select("geo_ref", "id", G.xyz(F.col("px"), F.col("py"), F.col("pz")).alias("o"), G.opengl_ray(F.col("theta"), F.col("phi")).alias("d"))
    n = r.withColumn("next", F.lead(F.struct("id", "o", "d")).over(Window.partitionBy("geo_ref").orderBy("id"))).where("next IS NOT NULL")
    a = G.ray_closest_approach(F.col("o"), F.col("d"), F.col("next.o"), F.col("next.d"))
    return n.select("geo_ref", "id", F.col("next.id").alias("other"), R(a["distance"], 5, "distance"), R(a["ti"], 4, "ti"), R(a["tj"], 4, "tj"))


def thinned_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' places thinned to 2 m by descending id, map by map."""
    c = I.candidates(spark, sf_dir).select("geo_ref", "id", "x", "y", "z")
    return S.thin(c, ["geo_ref"], 2.0).select("geo_ref", "id")


def suppressed_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.boxes(spark, sf_dir)
    return U.suppress(b, ["keyframe"], ["x0", "y0", "x1", "y1"], "score", 0.3, "below").select("keyframe", "id")


def suppressed_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir).withColumn("score", F.col("width"))
    return U.suppress(c, ["keyframe"], ["theta", "phi", "width", "height"], "score", 0.1, "at_most", spherical=True).select("keyframe", "id")


def best_after_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps within a cutout go first, then the 200 best stay."""
    b = I.boxes(spark, sf_dir)
    return U.suppress(b, ["keyframe", "label"], ["x0", "y0", "x1", "y1"], "score", 0.5, "drop_above").orderBy(F.desc("score"), "id").limit(200).select("id")


def diverse_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight candidates of each label, one of each keyframe first."""
    b = I.boxes(spark, sf_dir)
    return U.diverse(b, ["label"], "keyframe", 8, "score").select("label", "keyframe", "id")


def capped_reading_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.boxes(spark, sf_dir).withColumn("prior", F.when(F.col("keyframe") % 4 == 1, F.lit(3)))
    return U.capped_attempts(b, "keyframe", "id", "prior", 5).select("keyframe", "id")


def anchored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest annotation of each prediction if it is nearer than the second by 5 m."""
    a = I.points(spark, sf_dir).select("prompt", F.col("id").alias("anchor"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    p = S.nearest_pairs(I.predictions(spark, sf_dir).select("prompt", "id", "lat", "lng"), a, ["prompt"], 80.0, "id", "anchor", 2)
    return U.nearest_anchor(p, ["id"], "distance", "anchor", 5.0).select("id", "anchor", R(F.col("distance"), 4, "distance"))


QUERIES = {f.__name__: f for f in (distances_and_bearings, earth_centred, lifted_points, panorama_boxes, cutout_points, view_quaternions, box_predicates, overlaps, cubemap_faces, depth_decoding, nearest_pixels, level_bands, points_in_polygon, near_point_pairs, nearest_annotations, nearest_markers, annotation_pairs, neighbour_floor, view_cones, ray_approaches, thinned_poses, suppressed_planar, suppressed_spherical, best_after_suppression, diverse_readings, capped_reading_attempts, anchored_labels)}
_H = I.haversine_sql("lat", "lng", "48.86", "2.36")
_BEAR = "degrees(atan2(sin(radians(2.36 - lng)) * cos(radians(48.86)), cos(radians(lat)) * sin(radians(48.86)) - sin(radians(lat)) * cos(radians(48.86)) * cos(radians(2.36 - lng))))"
_PAIRS = "pairs AS (SELECT p.id, a.id AS other, p.prompt, a.level AS r_level, p.level, p.lat, p.lng, a.lat AS r_lat, a.lng AS r_lng, " + I.haversine_sql("p.lat", "p.lng", "a.lat", "a.lng") + " AS d FROM predictions p, points a)"
_FLAT = "sqrt(pow((r_lng - lng) * 111320 * cos(radians((lat + r_lat) / 2)), 2) + pow((r_lat - lat) * 111320, 2))"
_A, _E2 = 6378137.0, 6.69437999014e-3
ORACLE_SQL = {
    "distances_and_bearings": f"""WITH {I.POINTS}, b AS (SELECT *, (({_BEAR} % 360) + 360) % 360 AS w FROM points)
        SELECT id, round({_H}, 3) AS metres, round(sqrt(pow((2.36 - lng) * 111320 * cos(radians((lat + 48.86) / 2)), 2) + pow((48.86 - lat) * 111320, 2)), 3) AS flat,
               round(w, 4) AS bearing, round(CASE WHEN w > 180 THEN w - 360 ELSE w END, 4) AS signed FROM b""",
    "earth_centred": f"""WITH {I.POINTS}, n AS (SELECT *, {_A} / sqrt(1 - {_E2} * pow(sin(radians(lat)), 2)) AS n, accuracy * 10 AS h FROM points)
        SELECT id, round((n + h) * cos(radians(lat)) * cos(radians(lng)), 3) AS x, round((n + h) * cos(radians(lat)) * sin(radians(lng)), 3) AS y, round((n * (1 - {_E2}) + h) * sin(radians(lat)), 3) AS z,
               round(lat, 7)::DOUBLE AS lat, round(lng, 7)::DOUBLE AS lng, round(h, 3)::DOUBLE AS alt FROM n""",
    "lifted_points": f"""WITH {I.CANDIDATES}, {I.POSES}, r AS (SELECT *, cos(phi) * sin(theta) AS a, sin(phi) AS b, -cos(phi) * cos(theta) AS c FROM candidates JOIN poses USING (geo_ref, keyframe))
        SELECT id, round(px + depth * ((1 - 2 * qy * qy) * a + 2 * qy * qw * c), 4) AS x, round(py + depth * b, 4) AS y, round(pz + depth * (-2 * qy * qw * a + (1 - 2 * qy * qy) * c), 4) AS z,
               round(((degrees(atan2(-2 * qy * qw, 1 - 2 * qy * qy)) % 360) + 360) % 360, 4) AS heading FROM r""",
    "panorama_boxes": f"""WITH {I.CANDIDATES}, b AS (
            SELECT id, degrees(width) * degrees(height) AS area, width > 0 AND degrees(width) < 179 AND height > 0 AND degrees(height) < 179 AS renderable, width / (2 * pi()) AS w, (theta * 2.2 - width / 2 + pi()) / (2 * pi()) AS u,
                   greatest(0.0, least(1.0, (pi() / 2 - phi - height / 2) / pi())) AS v0, greatest(0.0, least(1.0, (pi() / 2 - phi + height / 2) / pi())) AS v1 FROM candidates
        ), s AS (SELECT *, u - floor(u) AS s, least(1.0, w) AS k FROM b)
        SELECT id, round(area, 4) AS area, renderable, 0 AS part, round(s, 6) AS u0, round(least(1.0, s + k), 6) AS u1, round(v0, 6) AS v0, round(v1, 6) AS v1 FROM s
        UNION ALL SELECT id, round(area, 4), renderable, 1, 0.0, round(s + k - 1, 6), round(v0, 6), round(v1, 6) FROM s WHERE s + k > 1""",
    "cutout_points": f"""WITH {I.CANDIDATES}, p AS (SELECT *, -0.5 * tan(width / 2) AS a, -0.6 * tan(height / 2) AS b FROM candidates),
        q AS (SELECT id, a / n AS x, b / n AS y, 1 / n AS z, theta, phi FROM (SELECT *, sqrt(a * a + b * b + 1) AS n FROM p)),
        w AS (SELECT id, cos(phi) * sin(theta) * z + cos(theta) * x - sin(phi) * sin(theta) * y AS wx, sin(phi) * z + cos(phi) * y AS wy, cos(phi) * cos(theta) * z - sin(theta) * x - sin(phi) * cos(theta) * y AS wz FROM q),
        r AS (SELECT id, (atan2(wx, wz) + pi()) / (2 * pi()) AS u, (pi() / 2 - asin(greatest(-1.0, least(1.0, wy)))) / pi() AS v FROM w)
        SELECT id, round(u - floor(u), 6) AS u, round(v, 6) AS v FROM r""",
    "box_predicates": f"""WITH {I.BOXES}, c AS (SELECT id, greatest(0, least(100, x1)) - greatest(0, least(100, x0)) AS w, greatest(0, least(100, y1)) - greatest(0, least(100, y0)) AS h FROM boxes)
        SELECT id, round(w * h / 10000, 6) AS share, round(w / greatest(h, 1e-6), 6) AS aspect FROM c WHERE w > 0 AND h > 0 AND w * h / 10000 BETWEEN 0.002 AND 0.12 AND w / greatest(h, 1e-6) BETWEEN 0.25 AND 4.0""",
    "overlaps": f"""WITH {I.BOXES}, o AS (SELECT * FROM boxes), j AS (
            SELECT a.id, b.id AS id2, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS t,
                   ((a.x0 + a.x1) / 400 - 0.5) * 2 * pi() AS ta, ((b.x0 + b.x1) / 400 - 0.5) * 2 * pi() AS tb, ((a.y0 + a.y1) / 200 - 0.5) * pi() AS pa, ((b.y0 + b.y1) / 200 - 0.5) * pi() AS pb,
                   (a.x1 - a.x0) / 200 * 2 * pi() AS wa, (b.x1 - b.x0) / 200 * 2 * pi() AS wb, (a.y1 - a.y0) / 100 * pi() AS ha, (b.y1 - b.y0) / 100 * pi() AS hb
            FROM o a JOIN o b ON a.keyframe = b.keyframe AND a.id < b.id
        ), k AS (SELECT *, greatest(pa - ha / 2, pb - hb / 2) AS low, least(pa + ha / 2, pb + hb / 2) AS high, abs(atan2(sin(ta - tb), cos(ta - tb))) AS apart FROM j WHERE i / (s + t - i) > 0.55
        ), m AS (SELECT *, least(greatest(0, (wa + wb) / 2 - apart), wa, wb) * greatest(0, cos((low + high) / 2)) * greatest(0, high - low) AS x, wa * greatest(1e-6, cos(pa)) * ha AS aa, wb * greatest(1e-6, cos(pb)) * hb AS ab FROM k)
        SELECT id, id2, round(i / (s + t - i), 6) AS iou, round(x / (aa + ab - x), 6) AS spherical FROM m""",
    "depth_decoding": """WITH r AS (SELECT p_partkey AS id, p_partkey * 331 % 65536 AS raw FROM part)
        SELECT id, CASE WHEN raw > 0 THEN round(pow((raw >> 6) / 1023.0 * (sqrt(200.0) - sqrt(0.1)) + sqrt(0.1), 2), 6) END AS metres, CASE WHEN raw > 0 THEN round((raw >> 6) / 1023.0 * 199.9 + 0.1, 6)::DOUBLE END AS linear FROM r""",
    "nearest_pixels": f"""WITH {I.CANDIDATES} SELECT id, (round_even((theta + pi()) / (2 * pi()) * 5760, 0)::BIGINT % 5760 + 5760) % 5760 AS col, greatest(0, least(2879, round_even((pi() / 2 - phi) / pi() * 2880, 0)::BIGINT)) AS row FROM candidates""",
    "level_bands": f"WITH {I.CANDIDATES} SELECT id, CASE WHEN y <= -0.5 THEN -1 WHEN y <= 0.2 THEN 0 WHEN y <= 0.9 THEN 1 ELSE 2 END AS level FROM candidates",
    "points_in_polygon": f"""WITH {I.POINTS}, e AS (SELECT * FROM (VALUES (2.352, 48.852, 2.36, 48.858), (2.372, 48.853, 2.352, 48.852), (2.378, 48.866, 2.372, 48.853), (2.36, 48.858, 2.378, 48.866)) t(x, y, px, py)),
        i AS (SELECT p.id, class_name FROM points p, e WHERE level = 1 GROUP BY p.id, class_name HAVING count(*) FILTER ((y > lat) <> (py > lat) AND lng < (px - x) * (lat - y) / nullif(py - y, 0) + x) % 2 = 1)
        SELECT class_name, count(*) AS n FROM i GROUP BY class_name""",
    "near_point_pairs": f"""WITH {I.CANDIDATES}, d AS (SELECT a.geo_ref, a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS distance FROM candidates a JOIN candidates b ON a.geo_ref = b.geo_ref AND a.id < b.id AND a.placed AND b.placed)
        SELECT geo_ref, a, b, round(distance, 6) AS distance FROM d WHERE distance <= 3""",
    "nearest_annotations": f"""WITH {I.POINTS}, {I.PREDICTIONS}, {_PAIRS}, n AS (SELECT x.id, min(row(d, other)) AS m FROM pairs x JOIN points a ON a.id = x.other AND a.prompt = x.prompt WHERE d <= 60 GROUP BY x.id)
        SELECT p.id, coalesce(m[2], -1) AS annotation, round(m[1], 4) AS distance FROM predictions p LEFT JOIN n USING (id)""",
    "nearest_markers": f"""WITH {I.POINTS}, {I.PREDICTIONS}, {_PAIRS}, f AS (SELECT id, other, {_FLAT} AS f FROM pairs WHERE level = 3 OR level = r_level), n AS (SELECT id, min(row(f, other)) AS m FROM f WHERE f <= 40 GROUP BY id)
        SELECT id, m[2] AS marker, round(m[1], 4) AS distance FROM n""",
    "annotation_pairs": f"""WITH {I.POINTS}, d AS (SELECT a.id, b.id AS other, {I.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d FROM points a JOIN points b ON a.prompt = b.prompt AND a.class_name = b.class_name AND a.id < b.id)
        SELECT id, other, round(d, 4) AS distance FROM d WHERE d <= 40""",
    "neighbour_floor": f"WITH {I.POSES} SELECT a.geo_ref, a.keyframe, b.keyframe AS other, round(b.px - a.px, 4)::DOUBLE AS x, round(b.pz - a.pz, 4)::DOUBLE AS z FROM poses a JOIN poses b ON a.geo_ref = b.geo_ref AND a.keyframe % 3 = b.keyframe % 3 AND a.keyframe <> b.keyframe",
    "view_cones": f"""WITH {I.POSES}, i AS (SELECT geo_ref, keyframe, px, pz, unnest(range(0, 50)) AS i FROM poses)
        SELECT geo_ref, keyframe, i::INTEGER AS i, round(CASE WHEN i = 0 THEN px ELSE px + 5 * sin(radians(keyframe * 30.0 - 30 + (i - 1) * 60.0 / 48)) END, 4)::DOUBLE AS x, round(CASE WHEN i = 0 THEN pz ELSE pz - 5 * cos(radians(keyframe * 30.0 - 30 + (i - 1) * 60.0 / 48)) END, 4)::DOUBLE AS z FROM i""",
    "diverse_readings": f"""WITH {I.BOXES}, a AS (SELECT *, row_number() OVER (PARTITION BY label, keyframe ORDER BY score DESC, id) > 1 AS again FROM boxes)
        SELECT label, keyframe, id FROM a QUALIFY row_number() OVER (PARTITION BY label ORDER BY again, score DESC, id) <= 8""",
    "capped_reading_attempts": f"WITH {I.BOXES} SELECT keyframe, id FROM boxes QUALIFY row_number() OVER (PARTITION BY keyframe ORDER BY id) + CASE WHEN keyframe % 4 = 1 THEN 3 ELSE 0 END <= 5",
    "anchored_labels": f"""WITH {I.POINTS}, {I.PREDICTIONS}, {_PAIRS}, o AS (SELECT x.id, other, d, lead(d) OVER w AS nd, row_number() OVER w AS n FROM pairs x JOIN points a ON a.id = x.other AND a.prompt = x.prompt WHERE d <= 80 WINDOW w AS (PARTITION BY x.id ORDER BY d, other))
        SELECT id, CASE WHEN nd IS NULL OR nd - d >= 5 THEN other END AS anchor, round(d, 4) AS distance FROM o WHERE n = 1""",
    "view_quaternions": f"""WITH {I.CANDIDATES}, {I.POSES}, v AS (
            SELECT id, qw, qy, cos(theta / 2) * cos(phi / 2) AS a, cos(theta / 2) * sin(phi / 2) AS b, -sin(theta / 2) * cos(phi / 2) AS c, sin(theta / 2) * sin(phi / 2) AS d
            FROM candidates JOIN poses USING (geo_ref, keyframe)
        ), q AS (SELECT id, qw * a - qy * c AS w, qw * b + qy * d AS x, qw * c + qy * a AS y, qw * d - qy * b AS z FROM v)
        SELECT id, round(w, 6) AS w, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(w * w + x * x + y * y + z * z, 6) AS length FROM q""",
    "ray_approaches": f"""WITH {I.CANDIDATES}, {I.POSES}, r AS (
            SELECT geo_ref, id, {{'x': px::DOUBLE, 'y': py::DOUBLE, 'z': pz::DOUBLE}} AS o, {{'x': cos(phi) * sin(theta), 'y': sin(phi), 'z': -cos(phi) * cos(theta)}} AS d
            FROM candidates JOIN poses USING (geo_ref, keyframe)
        ), n AS (SELECT geo_ref, id, o, d, lead(id) OVER w AS other, lead(o) OVER w AS oj, lead(d) OVER w AS dj FROM r WINDOW w AS (PARTITION BY geo_ref ORDER BY id)
        ), s AS (
            SELECT *, d.x * dj.x + d.y * dj.y + d.z * dj.z AS dd, d.x * (o.x - oj.x) + d.y * (o.y - oj.y) + d.z * (o.z - oj.z) AS pi_,
                   dj.x * (o.x - oj.x) + dj.y * (o.y - oj.y) + dj.z * (o.z - oj.z) AS pj_,
                   sqrt(pow(d.y * dj.z - d.z * dj.y, 2) + pow(d.z * dj.x - d.x * dj.z, 2) + pow(d.x * dj.y - d.y * dj.x, 2)) < 1e-8 AS near
            FROM n WHERE other IS NOT NULL
        ), t AS (
            SELECT *, CASE WHEN near THEN -pi_ / 2 ELSE (dd * pj_ - pi_) / (1 - dd * dd) END AS ti,
                   CASE WHEN near THEN pi_ / 2 * CASE WHEN dd >= 0 THEN 1 ELSE -1 END ELSE (pj_ - dd * pi_) / (1 - dd * dd) END AS tj,
                   CASE WHEN near THEN greatest(0.0, -pi_) END AS flat FROM s
        )
        SELECT geo_ref, id, other, round(CASE WHEN near
                   THEN sqrt(pow(oj.x - o.x - d.x * flat, 2) + pow(oj.y - o.y - d.y * flat, 2) + pow(oj.z - o.z - d.z * flat, 2))
                   ELSE sqrt(pow(o.x + d.x * ti - oj.x - dj.x * tj, 2) + pow(o.y + d.y * ti - oj.y - dj.y * tj, 2) + pow(o.z + d.z * ti - oj.z - dj.z * tj, 2)) END, 5) AS distance,
               round(ti, 4) AS ti, round(tj, 4) AS tj FROM t""",
    "thinned_poses": f"""WITH RECURSIVE {I.CANDIDATES},
        {I.greedy_sql("candidates", "geo_ref", "id DESC", "sqrt(pow(x - k['x'], 2) + pow(y - k['y'], 2) + pow(z - k['z'], 2)) < 2", "id, x, y, z")}
        SELECT geo_ref, k.id AS id FROM stay""",
    "suppressed_planar": f"""WITH RECURSIVE {I.BOXES},
        {I.greedy_sql("boxes", "keyframe", "score DESC, id, x0, y0, x1, y1", I.iou_sql(">= 0.3"), "id, x0, y0, x1, y1")}
        SELECT keyframe, id FROM boxes WHERE (keyframe, id) IN (SELECT (keyframe, k.id) FROM stay)""",
    "best_after_suppression": f"""WITH RECURSIVE {I.BOXES},
        {I.greedy_sql("boxes", "keyframe, label", "score DESC, id, x0, y0, x1, y1", I.iou_sql("> 0.5"), "id, x0, y0, x1, y1, score")}
        SELECT k.id AS id FROM stay ORDER BY k.score DESC, k.id LIMIT 200""",
}
