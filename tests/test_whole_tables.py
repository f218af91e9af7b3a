"""Queries that join or group whole tables, held against their SQL or against brute force."""

import os

import pytest

import __spark_entry__ as entry
from tests.test_entry import TABLES, plain
from terravane.plans import inputs as I

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def agree(spark, con, name):
    """The query has the rows of its SQL."""
    sql = entry.oracle_sql()[name]
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert len(got) == len(want), name
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4) if all(isinstance(v, (int, float)) for v in a) else a == b, name


def test_points_and_predictions_are_whole(spark, con):
    for rows, table in ((I.points, "customer"), (I.predictions, "part")):
        assert rows(spark, SF).count() == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0] > 600


@pytest.mark.parametrize("name", "earth_centred points_in_polygon nearest_annotations nearest_markers annotation_pairs anchored_labels annotation_status prompt_classes displayed_results flat_results headings admissible_pairs curve_of_hits average_precision_of_hits shared_threshold accepted_by_class distances_and_bearings".split())
def test_whole_points_and_predictions(spark, con, name):
    agree(spark, con, name)


@pytest.mark.parametrize("name", ["overlaps", "diverse_readings"])
def test_whole_boxes(spark, con, name):
    agree(spark, con, name)


def stay(rows, keys, keep):
    """Ids of rows (id, keyframe, label, score, box) that stay when better ones of the group go first, all pairs compared."""

    def overlap(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    kept = {}
    for r in sorted(rows, key=lambda r: (-r.score, r.id)):
        own = kept.setdefault(tuple(r[k] for k in keys), [])
        box = (r.x0, r.y0, r.x1, r.y1)
        if all(keep(overlap(box, o)) for _, o, _ in own):
            own.append((r.id, box, r.score))
    return [(i, s) for own in kept.values() for i, _, s in own]


def test_suppression_of_all_boxes(spark):
    small = "/root/testdata/sf0.001"
    rows, run = I.boxes(spark, small).collect(), entry.queries()
    got = {r.id for r in run["suppressed_planar"](spark, small).collect()}
    assert got == {i for i, _ in stay(rows, ["keyframe"], lambda o: o < 0.3)}
    best = sorted(stay(rows, ["keyframe", "label"], lambda o: o <= 0.5), key=lambda r: (-r[1], r[0]))[:200]
    assert [r.id for r in run["best_after_suppression"](spark, small).collect()] == [i for i, _ in best]


@pytest.mark.parametrize("name", ["review_feedback", "built_ground_truth", "class_dictionary", "supported_readings", "coverage_area"])
def test_whole_explorer_tables(spark, con, name):
    agree(spark, con, name)


def test_readings_and_detections_are_whole(spark, con):
    run = entry.queries()
    assert run["reading_scores"](spark, SF).count() == con.execute("SELECT count(*) FROM part").fetchone()[0]
    small = "/root/testdata/sf0.001"
    rows = []
    for r in I.boxes(spark, small).collect():
        r = type(r)(**(r.asDict() | {"x0": max(0.0, r.x0), "y0": max(0.0, r.y0), "x1": min(100.0, r.x1), "y1": min(100.0, r.y1)}))
        if r.score >= 0.05 and 0.002 < (r.x1 - r.x0) * (r.y1 - r.y0) / 10000 < 0.2:
            rows.append(r)
    got = {r.id for r in run["postprocessed_detections"](spark, small).collect()}
    assert got == {i for i, _ in stay(rows, ["keyframe"], lambda o: o <= 0.4)}


@pytest.mark.parametrize("name", ["view_quaternions", "ray_approaches", "wire_columns", "thinned_poses", "suppressed_planar", "best_after_suppression", "postprocessed_detections"])
def test_greedy_and_geometric_queries(spark, con, name):
    agree(spark, con, name)


def test_all_hits_are_counted_for_support(spark, con):
    agree(spark, con, "supported_clusters")


@pytest.mark.parametrize("name", ["neighbour_floor", "view_cones"])
def test_all_maps(spark, con, name):
    agree(spark, con, name)
    assert {r.geo_ref for r in entry.queries()[name](spark, SF).select("geo_ref").distinct().collect()} == {0, 1, 2, 3}


def test_rays_of_all_neighbours_of_a_map(spark):
    import numpy as np

    from terravane.operators import kernels as K

    maps = {}
    for r in sorted(I.candidates(spark, SF).join(I.poses(spark, SF), ["geo_ref", "keyframe"]).collect(), key=lambda r: r.id):
        d = (np.cos(r.phi) * np.sin(r.theta), np.sin(r.phi), -np.cos(r.phi) * np.cos(r.theta))
        maps.setdefault(r.geo_ref, []).append((r.id, (r.px, r.py, r.pz), d))
    want = {}
    for g, own in maps.items():
        o, d = np.array([x[1] for x in own]), np.array([x[2] for x in own])
        gap, ti, tj = K.ray_approach(o[:-1], d[:-1], o[1:], d[1:])
        want |= {(g, a[0], b[0]): (x, y, z) for a, b, x, y, z in zip(own, own[1:], gap, ti, tj, strict=False)}
    got = {(r.geo_ref, r.id, r.other): (r.distance, r.ti, r.tj) for r in entry.queries()["ray_approaches"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 60
    assert all(got[k] == pytest.approx(want[k], rel=1e-4, abs=2e-4) for k in got)


def test_late_reviews_count(spark, tmp_path):
    rows = [(3999, "click", 1), (4000, "click", 2), (400_001, "click", 3), (400_002, "view", 4)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["query"]: (r.positive, r.negative) for r in entry.queries()["review_feedback"](spark, str(tmp_path)).collect()}
    assert got == {"click": ("2,3", "1"), "view": ("", "4")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_pairs_of_far_annotations(spark):
    import duckdb

    con, large = duckdb.connect(), "/root/testdata/sf0.1"
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{large}/customer.parquet'")
    want = {r[:2] for r in con.execute(entry.oracle_sql()["annotation_pairs"]).fetchall()}
    assert {(r.id, r.other) for r in entry.queries()["annotation_pairs"](spark, large).collect()} == want and want
