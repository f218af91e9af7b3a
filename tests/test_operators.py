"""Operators and expressions on literals: the corner cases the stand-in tables don't have."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geodesy as G
from terravane.functions import metrics as M
from terravane.functions import panorama as P
from terravane.functions import text as T
from terravane.operators import annotations as A
from terravane.operators import association as S
from terravane.operators import enrichment as E
from terravane.operators import evaluation as V
from terravane.operators import explorer as X
from terravane.operators import ranking as R
from terravane.operators import spatial as Z
from terravane.operators import suppression as U
from terravane.params import LocalizationParams
from terravane.sources import capture as C
from terravane.sources import manifest as N
from terravane.sources import writers as W
from terravane.streaming import resume


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_prefilter_counts_then_cuts(spark):
    h = spark.createDataFrame([(i, s) for i, s in enumerate([1.0, 0.5, 0.4, 0.2, 0.1, 0.05, 0.01])], "id long, similarity double")
    assert [r.id for r in R.prefilter(h, []).orderBy("id").collect()] == [0, 1, 2, 3, 4, 5]
    negative = spark.createDataFrame([(0, -0.1), (1, -0.5)], "id long, similarity double")
    assert R.prefilter(negative, []).count() == 0


def test_ratio_of_a_worthless_best_is_one(spark):
    c = spark.createDataFrame([(0, 0.0), (1, -1.0)], "cluster_id long, similarity double")
    assert {r.match_score for r in R.ratio_score(c, []).collect()} == {1.0}


def test_robust_scores_of_a_constant_are_zero(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "id long, v double")
    assert [r.v for r in E.robust_scores(rows, [], "v").orderBy("id").collect()] == [0.0, 0.0, None]


def test_boost_is_clipped(spark):
    r = one(spark, M.boosted(F.lit(0.9), F.lit(3.0), F.lit(None).cast("double"), 0.5, 0.5), M.boosted(F.lit(-0.9), F.lit(0.0), F.lit(4.0), 0.5, 0.5))
    assert (r.c0, r.c1) == (1.0, -1.0)


def test_rotation_and_lift(spark):
    half = math.sqrt(0.5)
    q = G.quaternion(F.lit(half), F.lit(0.0), F.lit(half), F.lit(0.0))  # a quarter turn about up
    r = one(spark, G.rotate(q, G.xyz(F.lit(0.0), F.lit(0.0), F.lit(-1.0))), G.heading_of_orientation(q), G.lift(G.xyz(F.lit(1.0), F.lit(2.0), F.lit(3.0)), q, F.lit(0.0), F.lit(0.0), F.lit(float("nan"))))
    assert np.allclose(tuple(r.c0), (-1, 0, 0), atol=1e-12) and r.c1 == pytest.approx(270) and r.c2 is None


def test_ecef_round_trip(spark):
    p = G.eus_to_geodetic(F.lit(48.8566), F.lit(2.3522), F.lit(35.0), G.xyz(F.lit(0.0), F.lit(4.0), F.lit(0.0)))
    r = one(spark, p).c0
    assert (round(r.lat, 9), round(r.lng, 9), round(r.alt, 6)) == (48.8566, 2.3522, 39.0)
    north = one(spark, G.eus_to_geodetic(F.lit(48.8566), F.lit(2.3522), F.lit(35.0), G.xyz(F.lit(0.0), F.lit(0.0), F.lit(-100.0)))).c0
    assert north.lat > 48.8566 and abs(north.lng - 2.3522) < 1e-9


def test_levels_at_shared_bounds_and_open_ends(spark):
    bands = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high")) for v, a, b in ((0, -2, 4), (1, 4, None))])
    r = one(spark, *[G.level_of_height(F.lit(h), bands) for h in (4.0, 4.1, -3.0, float("nan"))])
    assert tuple(r) == (0, 1, None, None)


def test_wrapped_boxes_and_their_corner_cases(spark):
    box = lambda t, w: P.wrapped_boxes(P.box_ratios(F.lit(t), F.lit(0.0), F.lit(w), F.lit(0.1)))
    r = one(spark, box(math.pi, 0.2), box(0.0, 0.0), box(0.0, 0.2))
    assert [len(x) for x in r] == [2, 0, 1] and r.c0[0].u1 == 1.0 and r.c0[1].u0 == 0.0


def test_spherical_overlap_crosses_the_seam(spark):
    b = lambda t: F.struct(F.lit(t).alias("theta"), F.lit(0.0).alias("phi"), F.lit(0.4).alias("fx"), F.lit(0.4).alias("fy"))
    r = one(spark, P.bfov_iou(b(math.pi - 0.05), b(-math.pi + 0.05)), P.bfov_iou(b(0.0), b(1.0)), P.bfov_iou(b(0.0), b(0.0)))
    assert r.c0 > 0.5 and r.c1 == 0 and r.c2 == pytest.approx(1, abs=1e-6)


def test_faces_are_rotations():
    for rows in P.FACES.values():
        m = np.array(rows, float)
        assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)


def test_face_pixels_there_and_back(spark):
    for face in P.FACES:
        ray = P.face_pixel_ray(face, F.lit(100.0), F.lit(300.0), 512)
        r = one(spark, P.best_face(ray), P.face_pixel(F.lit(face), ray, 512))
        assert r.c0 == face and r.c1.u == pytest.approx(100) and r.c1.v == pytest.approx(300)


def test_overlap_rules_differ_at_the_threshold(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 2.0, 1.0), (2, 1, 0.8, 1.0, 0.0, 3.0, 1.0)], "id long, k long, score double, x0 double, y0 double, x1 double, y1 double")
    box, third = ["x0", "y0", "x1", "y1"], 1 / 3
    assert U.suppress(rows, ["k"], box, "score", third, "below").count() == 1
    assert U.suppress(rows, ["k"], box, "score", third, "at_most").count() == 2
    assert U.suppress(rows, ["k"], box, "score", 1.0, "below").count() == 2 == U.suppress(rows, ["k"], box, "score", 0.0, "at_most").count()


def test_localize_literals(spark):
    """Two groups seven metres apart and a row without a place."""
    at = [(2.0, 1.6, -3.0), (2.2, 1.6, -3.1), (1.9, 1.6, -2.9), (9.0, 1.6, -3.0), (9.1, 1.6, -3.2), (8.9, 1.6, -2.8), None]
    rows = [(5, i, k, 0.9 - i / 100, p, (0.0, 1.6, 0.0), 0) for i, (k, p) in enumerate(zip([1, 2, 3, 1, 2, 3, 1], at, strict=True))]
    point = "struct<x:double,y:double,z:double>"
    d = spark.createDataFrame(rows, f"geo_ref long, id long, keyframe long, similarity double, position {point}, origin {point}, level int")
    out = S.localize(d.withColumns({"positive": F.lit(0.0), "negative": F.lit(0.0)}), ["geo_ref"], LocalizationParams(), None, (F.lit(48.8566), F.lit(2.3522), F.lit(35.0))).orderBy("rank").collect()
    assert [(r.cluster_id, r.n, r.keyframe_ids) for r in out] == [(0, 3, ["1", "2", "3"]), (1, 3, ["1", "2", "3"])]
    assert out[0].match_score == 1.0 and out[1].match_score == pytest.approx(0.87 / 0.9) and [o.object_id for o in out[0].observations] == [0, 1, 2]
    assert {r.cluster_id for r in S.associate(d, ["geo_ref"], LocalizationParams(association="multicut", geo_pivot=2.0)).collect()} == {0, 1}
    # rays that leave from one point meet there, not in front of it
    assert {r.cluster_id for r in S.associate(d, ["geo_ref"], LocalizationParams(association="cdog", epipolar_m=3.0, delta=0.0)).collect()} == {-1}
    rays = S.localize(d.withColumns({"positive": F.lit(0.0), "negative": F.lit(0.0)}), ["geo_ref"], LocalizationParams(centroid_from="rays"))
    assert rays.count() == 2


def test_median_level_counts_keyframes_and_unresolved(spark):
    rows = [(i, k, 0.5, (0.0, 0.0, 0.0), lv, 0) for i, (k, lv) in enumerate([(1, 2), (1, 2), (1, 2), (2, 0), (3, None)])]
    d = spark.createDataFrame(rows, "id long, keyframe long, similarity double, position struct<x:double,y:double,z:double>, level int, cluster_id long")
    assert S.cluster_statistics(d, [], LocalizationParams(level_strategy="median")).first().level == 0
    assert S.cluster_statistics(d, [], LocalizationParams()).first().level == 2


def test_parameters_are_checked():
    for bad in ({"candidate_count": 0}, {"candidate_count": 5001}, {"alpha": 1.5}, {"association": "x"}, {"range_m": (2.0, 1.0)}, {"semantic_gate": 2.0}, {"eps_m": 0.0}):
        with pytest.raises(ValueError):
            LocalizationParams(**bad)
    with pytest.raises(ValueError):
        LocalizationParams().with_(unknown=1)
    assert not LocalizationParams(association="multicut").needs_embeddings and LocalizationParams(association="incremental").needs_embeddings


def test_matchers_disagree_on_purpose(spark):
    pairs = spark.createDataFrame([("p", 1, 7, 1.0, 0.2), ("p", 2, 7, 2.0, 0.9)], "prompt string, prediction long, target long, distance double, score double")
    assert [r.prediction for r in V.match(pairs, ["prompt"]).collect()] == [1]
    preds = spark.createDataFrame([("p", 1, 0.2), ("p", 2, 0.9)], "prompt string, id long, score double")
    ranked = {r.prediction: r.hit for r in V.score_ordered(preds, pairs, ["prompt"]).collect()}
    assert ranked == {1: False, 2: True}


def test_average_precision_literals(spark):
    ranked = spark.createDataFrame([("p", i, s, h) for i, (s, h) in enumerate([(0.9, True), (0.8, False), (0.7, True), (0.7, False)])], "prompt string, prediction long, score double, hit boolean")
    totals = spark.createDataFrame([("p", 2)], "prompt string, n_targets long")
    points = V.curve(ranked, totals, ["prompt"])
    assert points.count() == 3  # ties are one point
    assert V.average_precision(points, ["prompt"]).first().average_precision == pytest.approx(0.5 + 0.5 * 0.5)
    assert V.accepted(ranked, 0.7).count() == 2  # strictly more


def test_auc_of_ties_is_a_half(spark):
    rows = spark.createDataFrame([(0.5, True), (0.5, False)], "s double, y boolean")
    assert V.rank_auc(rows, [], "s", F.col("y")).first().auc == 0.5
    assert V.rank_auc(rows.where("y"), [], "s", F.col("y")).first().auc is None


def test_partition_metrics_of_noise_and_unlabelled(spark):
    rows = spark.createDataFrame([(1, -1, "a"), (2, -1, "a"), (3, 0, None)], "id long, cluster_id long, truth string")
    r = V.partition_metrics(rows, []).first()
    assert (r.n, r.pair_precision, r.pair_recall, r.rand_index) == (2, 0.0, 0.0, 0.0)


def test_nearest_takes_the_smallest_of_equals(spark):
    left = spark.createDataFrame([("p", 1, 48.0, 2.0), ("q", 2, 48.0, 2.0)], "prompt string, id long, lat double, lng double")
    right = spark.createDataFrame([("p", 9, 48.0, 2.0), ("p", 8, 48.0, 2.0)], "prompt string, a long, r_lat double, r_lng double")
    assert {r.id: r.a for r in Z.nearest(left, right, ["prompt"], 10.0, "id", "a").collect()} == {1: 8, 2: -1}


def test_groups_by_single_linkage(spark):
    p = spark.createDataFrame([("p", i, 48.0 + i * 0.0001, 2.0) for i in range(4)] + [("p", 9, 49.0, 2.0)], "prompt string, id long, lat double, lng double")
    assert {r.id: r.group_id for r in Z.clusters_within(p, ["prompt"], 12.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    assert {r.id: r.group_id for r in Z.clusters_within(p, ["prompt"], 0.0).collect()} == {i: i for i in (0, 1, 2, 3, 9)}


def test_texts(spark):
    r = one(spark, T.normalised_query(F.lit("  Straße ")), T.basename(F.lit("https://x/a/b.jpg?s=1/2#f")), T.slug(F.lit(" Hé llo-- W! ")), T.level_text(F.lit("-1.7")), T.level_text(F.lit("x")), T.normalised_reading(F.lit("Répère|12÷B")))
    assert tuple(r) == ("strasse", "b.jpg", "h-llo-w", "-1", None, "repere 12 b")


def test_reading_scores_ladder(spark):
    q = lambda s: T.reading_query(F.lit(s))
    score = lambda query, key, text: T.reading_score(q(query), F.lit(key), F.lit(""), F.lit(text))
    r = one(spark, score("voie 7A", "", "quai 7a"), score("voie 7 A", "numbers=7;letters=a", ""), score("voie 7 A", "numbers=7", "b"), score("voie 7", "", "voie 7"), score("voie 7", "numbers=8", ""), score("voie", "numbers=8", ""), score("hall b", "letters=b", ""), score("hall b", "", "b"))
    assert tuple(r) == (1.0, 1.0, 0.85, 0.8, 0.0, 0.0, 0.7, 0.6)


def test_features_as_annotations(spark):
    rows = [(0, "Point", [[2.0, 48.0]], {"name": "Bench", "accuracy": "bad"}), (1, "Polygon", [[0.0, 0.0], [0.0, 3.0], [3.0, 0.0], [0.0, 0.0]], {"class": "a", "id": "0", "prompt": "x"}), (2, "LineString", [[0.0, 0.0]], {})]
    f = spark.createDataFrame(rows, "index long, geometry_type string, coordinates array<array<double>>, properties map<string,string>")
    out = A.annotation_rows(f).collect()
    assert [(r.id, r.class_name, r.prompt, r.lat, r.lng, r.accuracy) for r in out] == [("0", "Bench", "Bench", 48.0, 2.0, 5.0), ("1", "a", "x", 0.75, 0.75, 5.0)]


def test_membership_refuses_two_keyframes(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0), (1, 1, 2, 0)], "cluster long, cutout long, keyframe long, level int")
    with pytest.raises(Exception, match="several keyframes"):
        A.membership(rows).collect()
    none = spark.createDataFrame([(1, 1, 1, None)], "cluster long, cutout long, keyframe long, level int")
    with pytest.raises(Exception, match="no known level"):
        A.membership(none).collect()


def test_pages_are_bounded(spark):
    rows = spark.range(50)
    assert [r.id for r in X.page(rows, -3, 2, [F.desc("id")]).collect()] == [49, 48]
    assert X.page(rows, 0, 0, ["id"]).count() == 1


MANIFEST = """{"local_origin": [2.3522, 48.8566, 35.0], "map": {"name": "m"}, "geo_levels": [{"value": 1, "min_altitude": 4, "geo_ref": 7}, {"value": 0, "max_altitude": 4, "geo_ref": 7}],
 "geo_keyframes": [{"image_url": "s3://b/a.jpg?x=1", "depth_url": "d/a.tif", "x": 1, "y": 2, "z": 3, "orientation": [1, 0, 0, 0]}, {"image_url": "b.jpg", "x": 0, "y": 0, "z": 0, "orientation": [0.7071067811865476, 0, 0.7071067811865476, 0]}]}"""


def test_manifests(spark, tmp_path):
    for stamp in ("20260101_000000", "20260102_000000"):
        (tmp_path / f"hotel_2_{stamp}.json").write_text(MANIFEST)
    (tmp_path / "notes.json").write_text("{}")
    found = N.find_manifests(spark, str(tmp_path)).collect()
    assert [(r.map_id, r.version, r.stamp) for r in found] == [("hotel", 2, "20260102_000000")]
    m = N.read_manifests(spark, found[0].path)
    k = N.keyframes(m).orderBy("keyframe").collect()
    assert [(r.keyframe, r.image, r.geo_ref_id) for r in k] == [(0, "a.jpg", 7), (1, "b.jpg", 7)] and k[0].heading == pytest.approx(0) and k[1].heading == pytest.approx(270)
    assert [b.value for b in N.levels(m).first().bands] == [0.0, 1.0]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x_1_20260101_000000.json").write_text(MANIFEST.replace("b.jpg", "a.jpg"))
    with pytest.raises(Exception, match="share an image"):
        N.keyframes(N.read_manifests(spark, str(bad))).collect()


def test_graph_edges(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features": [{"geometry": {"type": "LineString", "coordinates": [[0,1],[2,3],[4,5]]}, "properties": {"levels": [1,1,2]}}, {"geometry": {"type": "Point", "coordinates": [0,1]}}, {"geometry": {"type": "LineString", "coordinates": [[0,1]]}}]}')
    out = N.graph_edges(spark, str(tmp_path / "g.json")).orderBy("index").collect()
    assert [(r.start, r.end, r.levels, r.malformed) for r in out] == [([0.0, 1.0], [4.0, 5.0], [1, 2], False), (None, None, [], True)]


def test_captures(spark, tmp_path):
    cap = tmp_path / "cap1"
    cap.mkdir()
    import pandas as pd

    pd.DataFrame({"row_index": [0, 1], "video_keyframe_id": [3, 3], "depth": [float("nan"), 2.0]}).to_parquet(cap / "metadata.parquet")
    np.arange(8, dtype="<f2").tofile(cap / "embeddings.npy")
    meta, vec = C.read_metadata(spark, str(tmp_path)), C.read_vectors(spark, str(tmp_path), 4)
    both = C.aligned(meta, vec).orderBy("row_index").collect()
    assert both[1].embedding == [4.0, 5.0, 6.0, 7.0] and both[0].depth is None and both[0].label is None and both[0].capture == "cap1"
    with pytest.raises(Exception, match="differ in length"):
        C.aligned(meta.where("row_index = 0"), vec).collect()


def test_blobs(spark):
    values = (0.5, -1.25, 3.0e-5, 2.0)
    d = spark.createDataFrame([(bytearray(struct.pack("<4f", *values)),), (bytearray(b"abc"),)], "b binary")
    r = d.select(C.unpacked_floats(F.col("b"), 4).alias("f"), C.polygon_points(F.col("b")).alias("p")).collect()
    assert np.allclose(r[0].f, np.array(values, np.float32)) and [(round(x.u, 6), round(x.v, 6)) for x in r[0].p] == [(0.5, -1.25), (0.00003, 2.0)] and r[1].p == []


def tiff(image):
    h, w = image.shape
    data = image.astype("<u2").tobytes()
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, len(data))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd


def test_depths_are_sampled_and_lifted(spark):
    image = np.zeros((4, 8), np.uint16)
    image[2, 4] = 65535
    rows = spark.createDataFrame([(1, 10, 0.0, 0.0), (1, 11, 3.0, 1.0), (2, 12, 0.0, 0.0)], "keyframe long, id long, theta double, phi double")
    rasters = spark.createDataFrame([(1, bytearray(b"broken")), (1, bytearray(tiff(image)))], "keyframe long, content binary")
    out = {r.id: r.depth for r in C.sampled_depths(rows, rasters).collect()}
    assert out[10] == pytest.approx(200.0) and out[11] is None and out[12] is None


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame([(1, 1, float("nan"), ""), (2, 2, 1.0, "a")], "geo_ref_id long, id long, depth double, label string")
    for _ in range(2):  # again changes nothing
        W.replace_maps(W.storable(rows), path)
    W.replace_maps(W.storable(rows.where("geo_ref_id = 2").withColumn("id", F.lit(9).cast("long"))), path)
    out = spark.read.parquet(path).orderBy("geo_ref_id").collect()
    assert [(r.geo_ref_id, r.id, r.depth, r.label) for r in out] == [(1, 1, None, None), (2, 9, 1.0, "a")]
    with pytest.raises(Exception, match="exist"):
        W.write_new(rows, path)
    with pytest.raises(ValueError, match="missing columns: z"):
        W.with_schema_checked(rows, "id long, z int")
    assert W.upsert(rows, rows.where("id = 1").withColumn("label", F.lit("new")), ["id"]).where("label = 'new'").count() == 1
    assert W.not_done(rows, rows.where("id = 1"), ["id"]).count() == 1
    requests = spark.createDataFrame([("a", 1), ("b", 2)], "prompt string, k int")
    made = []

    def compute(todo):
        made.append(todo.count())
        return todo.withColumn("result", F.col("k") * 10)

    for _ in range(2):
        assert sorted(r.result for r in W.cached_by_key(spark, requests, str(tmp_path / "cache"), compute).collect()) == [10, 20]
    assert made == [2]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(5).write.parquet(str(source / "a"))

    def handle(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    for k in range(3):
        if k == 2:
            spark.range(5, 8).write.parquet(str(source / "b"))
        q = resume.process_new_files(spark, str(source / "*"), "id long", str(tmp_path / "check"), handle)
        q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_job_states(spark):
    lines = [(1, '{"job":"a","event":"progress","done":1,"total":3}'), (2, "noise"), (3, '{"job":"a","event":"finished","done":3,"total":3,"message":"ok"}'), (4, '{"job":"b","event":"error","message":"no"}')]
    out = resume.job_states(resume.progress_events(spark.createDataFrame(lines, "at long, value string"))).orderBy("job").collect()
    assert [(r.job, r.state, r.done, r.message) for r in out] == [("a", "finished", 3, "ok"), ("b", "failed", None, "no")]


def test_config_with_comments(spark, tmp_path):
    (tmp_path / "c.json").write_text('{ // maps\n "maps": [{"map_id": "a//b", "path": ""}, /* two */ {"map_id": "c", "path": "/x",},],\n}')
    rows = N.read_config(spark, str(tmp_path / "c.json"), "maps array<struct<map_id:string,path:string>>").select(F.inline("maps"))
    assert [tuple(r) for r in N.registry(rows, "/maps/").orderBy("map_id").collect()] == [("a//b", "/maps/a//b"), ("c", "/x")]
    with pytest.raises(Exception, match="configured twice"):
        N.registry(rows.union(rows), "/maps").collect()


def test_window_median():
    from terravane.operators.kernels import window_median

    image = np.full((4, 6), np.nan)
    image[0, 5], image[0, 0], image[1, 1] = 1.0, 2.0, 9.0
    assert window_median(image, 0, 0, 1) == 2.0 and np.isnan(window_median(image, 3, 3, 1))


def test_projection_undoes_the_lift(spark):
    q = G.quaternion(F.lit(math.cos(0.4)), F.lit(0.0), F.lit(math.sin(0.4)), F.lit(0.0))
    o = G.xyz(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = one(spark, P.project_point(o, q, G.lift(o, q, F.lit(0.7), F.lit(-0.2), F.lit(5.0)))).c0
    assert (r.theta, r.phi, r.distance) == (pytest.approx(0.7), pytest.approx(-0.2), pytest.approx(5.0))


def test_geojson_files(spark, tmp_path):
    from terravane.sources import geojson

    (tmp_path / "a.json").write_text(
        '{"features": [{"geometry": {"type": "Point", "coordinates": [2.0, 48.0]}, "properties": {"class": "Bench", "theta": 1, "phi": "0.5", "width": 1, "height": 1, "depth": 3}},'
        ' {"geometry": {"type": "Polygon", "coordinates": [[[0,0],[0,3],[3,0],[0,0]]]}, "properties": {"name": "b", "theta": "NaN"}}, {"geometry": {"type": "LineString", "coordinates": [[0,0],[1,1]]}}]}'
    )
    f = geojson.read_features(spark, str(tmp_path / "a.json"))
    assert [(r.class_name, r.lat, r.lng) for r in A.annotation_rows(f).collect()] == [("Bench", 48.0, 2.0), ("b", 0.75, 0.75)]
    s = [r.s for r in f.select(geojson.source_block(F.col("properties")).alias("s")).collect()]
    assert s[0].depth == 3.0 and s[1] is None and s[2] is None


def test_encoders_are_made_once_a_task(spark):
    from terravane.operators import detections

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, text string")
    assert [r.embedding for r in detections.encoded(rows, "text", load).orderBy("id").collect()] == [[2.0, 1.0], [3.0, 1.0]]


def test_first_usable_level_and_headings(spark):
    from terravane.operators import detections

    o = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 3, 9)], "cluster long, place long, keyframe long")
    k = spark.createDataFrame([(7, None), (8, 2), (9, 0)], "keyframe long, level int")
    assert detections.first_usable_level(o, ["cluster"], k).first().level == 2


def test_an_annotation_s_group_has_at_least_the_radius(spark):
    m = spark.createDataFrame([("p", 1, 48.0, 2.0, 3.0), ("p", 1, 48.2, 2.2, 9.0)], "prompt string, group_id long, lat double, lng double, accuracy double")
    assert A.group_centres(m, ["prompt"], 5.0).first().radius == 9.0 and A.group_centres(m, ["prompt"], 20.0).first().radius == 20.0


def test_normalisation_modes(spark):
    rows = spark.createDataFrame([("a", 1, 0.80, 0.5), ("a", 2, 0.82, 0.5), ("a", 3, 0.84, 0.5), ("a", 4, 0.98, None), ("b", 5, 7.0, 1.0)], "q string, id long, p double, n double")
    got = lambda mode: [(r.p, r.n) for r in E.normalised_scores(rows, ["q"], ["p", "n"], mode).orderBy("id").collect()]
    assert got("none") == [(0.80, 0.5), (0.82, 0.5), (0.84, 0.5), (0.98, None), (7.0, 1.0)]
    centred = [p for p, _ in got("center")]
    assert centred == pytest.approx([-0.03, -0.01, 0.01, 0.15, 0.0])
    unit = 1.4826 * 0.02
    assert [p for p, _ in got("standardize")] == pytest.approx([x / unit for x in centred[:4]] + [0.0])
    assert [n for _, n in got("standardize")] == [0.0, 0.0, 0.0, None, 0.0]


def test_bounds_of_parameters():
    from terravane.params import LocalizationParams as P

    assert P(min_similarity=-3.0, feedback_normalization="center").min_similarity == -3.0
    for bad in ({"delta": 1.5}, {"min_observations": 0}, {"max_spread_m": 0.0}, {"feedback_normalization": "median_mad"}, {"alpha": 2.0}):
        with pytest.raises(ValueError):
            P(**bad)


def test_clusters_of_two_maps_are_two(spark):
    rows = [("c", g, 10 * g + i, 0, t) for g in (0, 1) for i, t in enumerate("xxy")]
    d = spark.createDataFrame(rows, "config string, geo_ref long, id long, cluster_id long, truth string")
    r = V.partition_metrics(d, ["config"], within=("geo_ref",)).first()
    assert (r.n, r.pair_precision, r.pair_recall) == (6, pytest.approx(2 / 6), pytest.approx(2 / 7))


def test_refinement_by_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [
        (0, 1, 0, a), (0, 2, 0, near(a)), (0, 3, 0, b), (0, 4, 0, near(b)), (0, 5, 0, c),  # two parts and one row
        (0, 6, 1, a), (0, 7, 1, b),  # under the least size: stays
        (0, 8, 2, a), (0, 9, 2, near(a)), (0, 10, 2, a),  # one part
        (0, 11, 3, a), (0, 12, 3, b), (0, 13, 3, c),  # no part is large enough: stays
        (0, 14, -1, a), (1, 1, 0, b),
    ]
    d = spark.createDataFrame(rows, "geo_ref long, id long, cluster_id long, embedding array<double>")
    got = {(r.geo_ref, r.id): (r.cluster_id, r.score) for r in S.refine_by_vectors(d, ["geo_ref"], 0.9, 3, 2).collect()}
    labels = {k: v[0] for k, v in got.items()}
    assert [labels[0, i] for i in range(1, 15)] == [0, 0, 4, 4, -1, 1, 1, 2, 2, 2, 3, 3, 3, -1] and labels[1, 1] == 0
    assert got[0, 1][1] > 0.99 and got[0, 5][1] is None or got[0, 5][1] != got[0, 5][1]


def test_observations_of_the_answer_and_the_boost(spark):
    from terravane.params import LocalizationParams

    vector = [1.0, 0.0]
    rows = [(0, i, i, 0.5 + 0.01 * i, (float(i % 2) * 50, 0.0, 0.0), (0.0, 0.0, 5.0), 0, 0.8 + 0.1 * (i % 2), 0.0, vector) for i in range(6)]
    d = spark.createDataFrame(rows, "geo_ref long, id long, keyframe long, similarity double, position struct<x: double, y: double, z: double>, origin struct<x: double, y: double, z: double>, level long, positive double, negative double, embedding array<double>")
    p = LocalizationParams(eps_m=1.0, min_keyframes=1, max_observations=2, alpha=0.5, feedback_normalization="center")
    out = {r.observations[0].object_id: r for r in S.localize(d, ["geo_ref"], p).collect()}
    assert set(out) == {4, 5} and out[5]["rank"] == 1
    first = out[5].observations
    assert [o.object_id for o in first] == [5, 3] and first[0].keyframe_id == "5" and first[0].position.x == 50.0
    assert first[0].positive == pytest.approx(0.05) and first[0].boosted_score == pytest.approx(0.55 + 0.5 * 0.05)
    assert out[4].similarity == pytest.approx(0.54 - 0.5 * 0.05) and out[4].keyframe_ids == ["0", "2", "4"]


def test_thumbnails_of_many_rows_and_stripped_queries(spark):
    d = spark.createDataFrame([(7,), (1_234_567,)], "i long")
    assert [r.f for r in d.select(T.thumbnail_file(F.lit("k"), F.col("i")).alias("f")).collect()] == ["k/000007.jpg", "k/1234567.jpg"]
    q = spark.createDataFrame([("\t Red\u00a0Door\n\x0b",)], "q string")
    assert q.select(T.normalised_query(F.col("q")).alias("q")).first().q == "red\u00a0door"
