"""Searches among near points, held against all pairs; parts that stay small where one group is large."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import text as T
from terravane.operators import evaluation as V
from terravane.operators import kernels as K
from terravane.operators import spatial as S

PLACES = [(48.85, 2.35, 0.002), (0.0, 179.9995, 0.001), (89.9995, 10.0, 0.0004), (-60.0, -20.0, 0.002)]


def scattered(rng, lat, lng, spread, n):
    """Points about a place, some of them twice; longitudes wrap."""
    a, b = lat + rng.uniform(-spread, spread, n), lng + rng.uniform(-spread, spread, n) / max(np.cos(np.radians(lat)), 0.001)
    a[: n // 8], b[: n // 8] = a[-(n // 8) :], b[-(n // 8) :]
    return np.clip(a, -90, 90), (b + 180) % 360 - 180


def all_distances(lat, lng, lat2, lng2):
    return K.haversine(np.radians(lat)[:, None], np.radians(lng)[:, None], np.radians(lat2), np.radians(lng2))


@pytest.mark.parametrize("place", PLACES)
def test_near_places_matches_and_choices_are_those_of_all_pairs(place):
    rng = np.random.default_rng(3)
    (lat, lng), (lat2, lng2) = scattered(rng, *place, 150), scattered(rng, *place, 120)
    score, reach = rng.integers(0, 5, 150) / 5.0, rng.uniform(10, 60, 120)
    ids, targets = np.arange(150), rng.permutation(120)
    d = all_distances(lat, lng, lat2, lng2)
    found = [p for part in K.near_places(lat, lng, lat2, lng2, 50.0) for p in zip(part[0].tolist(), part[1].tolist(), strict=True)]
    assert sorted(found) == sorted(zip(*(a.tolist() for a in np.nonzero(d <= 50.0)), strict=True))
    i, j = np.nonzero(d <= reach)
    take = K.one_to_one(ids[i], targets[j], d[i, j], score[i])
    a, b, _ = K.matched_places(ids, lat, lng, score, targets, lat2, lng2, reach)
    assert len(a) and set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(i[take].tolist(), j[take].tolist(), strict=True))
    free, want = set(range(120)), []
    for r in range(150):
        near = min(((d[r, c], targets[c], c) for c in free if d[r, c] <= reach[c]), default=None)
        want.append(-1 if near is None else near[2])
        free.discard(want[-1])
    assert K.taken_in_order(lat, lng, targets, lat2, lng2, reach).tolist() == want
    i, j, _ = K.nearest_places(lat, lng, lat2, lng2, targets, 60.0, 2)
    near = {r: [c for _, _, c in sorted((d[r, c], targets[c], c) for c in range(120) if d[r, c] <= 60.0)[:2]] for r in range(150)}
    assert {r: j[i == r].tolist() for r in range(150)} == near


@pytest.mark.parametrize("place", PLACES)
def test_joins_by_cells_are_those_of_all_pairs(spark, place):
    rng = np.random.default_rng(4)
    (lat, lng), (lat2, lng2) = scattered(rng, *place, 90), scattered(rng, *place, 80)
    reach = rng.uniform(10, 60, 80)
    a = spark.createDataFrame([("k", i, *map(float, p)) for i, p in enumerate(zip(lat, lng, strict=True))], "k string, id long, lat double, lng double")
    b = spark.createDataFrame([("k", i, *map(float, p)) for i, p in enumerate(zip(lat2, lng2, reach, strict=True))], "k string, target long, r_lat double, r_lng double, radius double")
    d = all_distances(lat, lng, lat2, lng2)
    pairs = S.within_accuracy(a, b, ["k"], F.col("radius"), 60.0, F.col("radius"))
    got = sorted((r.id, r.target) for r in pairs.collect())
    assert got == sorted(zip(*(x.tolist() for x in np.nonzero(d <= reach)), strict=True)) and got
    near = S.nearest_pairs(a, b, ["k"], 60.0, "id", "target", 2).collect()
    want = [(i, c) for i in range(90) for _, c in sorted((d[i, c], c) for c in range(80) if d[i, c] <= 60.0)[:2]]
    assert sorted((r.id, r.target) for r in near) == sorted(want)
    scored = a.withColumn("score", (F.col("id") % 7).cast("double"))
    named, admissible = scored.withColumnRenamed("id", "prediction"), pairs.join(scored.select("id", "score"), "id").withColumnRenamed("id", "prediction")
    assert {(r.prediction, r.target) for r in V.match_near(named, b, ["k"]).collect()} == {(r.prediction, r.target) for r in V.match(admissible, ["k"]).collect()}
    hits = lambda rows: sorted((r.prediction, r.score, r.hit) for r in rows.collect())
    assert hits(V.score_ordered_near(scored, b, ["k"])) == hits(V.score_ordered(scored, admissible, ["k"]))


def test_pairs_of_one_dense_group_come_in_parts():
    rng = np.random.default_rng(5)
    xyz = rng.normal(0, 1, (4000, 3))
    parts = list(K.near_pair_parts(xyz, 2.0))
    assert max(len(i) for i, _ in parts) <= K.AT_ONCE + 4000 and sum(len(i) for i, _ in parts) > 4 * K.AT_ONCE / 2
    boxes = np.hstack([np.zeros((900, 2)), 10 + rng.uniform(0, 1, (900, 2))])
    from terravane.operators.suppression import planar_overlap

    parts = list(K.overlapping_parts(boxes, planar_overlap(boxes), 0.5, 10000))
    assert max(len(i) for i, _ in parts) < 10900 and sum(len(i) for i, _ in parts) == 900 * 899 // 2


@pytest.mark.parametrize("threshold", [0.05, 0.55, 0.95])
def test_boxes_of_one_group_meet_in_cells(threshold):
    from terravane.operators.suppression import planar_overlap

    rng = np.random.default_rng(7)
    at, size = rng.uniform(-50, 50, (1500, 2)), np.exp(rng.uniform(-2, 4, (1500, 2)))
    some = np.vstack([np.hstack([at, at + size]), np.hstack([at, at + size])[:300], [[0, 0, 0, 5], [3, 3, 2, 2], [0, 0, np.inf, 1], [0, 0, np.inf, 1], [0, 0, 1e-9, 1e9], [0, 0, 1e-9, 1e9]]])
    boxes = some[np.argsort(some[:, 0], kind="stable")]
    with np.errstate(invalid="ignore"):
        want = {(i, j) for p in K.overlapping_parts(boxes, planar_overlap(boxes), threshold) for i, j in zip(*(x.tolist() for x in p), strict=True)}
    found = [(i, j) for p in K.overlapping_boxes(boxes, threshold, 1000) for i, j in zip(*(x.tolist() for x in p), strict=True)]
    assert set(found) == want and len(found) == len(want) > 300
    assert list(K.overlapping_boxes(boxes[:0], threshold)) == list(K.overlapping_boxes(boxes[:1], threshold)) == []


def test_few_boxes_of_a_large_group_are_compared(spark):
    from terravane.operators import suppression as U

    rng = np.random.default_rng(8)
    at, size = rng.uniform(0, 200, (3000, 2)), rng.uniform(3, 50, (3000, 2))
    boxes = np.hstack([at, at + size])[np.argsort(at[:, 0])]
    assert 0 < sum(len(i) for i, _ in K._near_boxes(boxes, 0.55, 1 << 17)) < 0.02 * 3000 * 2999 / 2
    rows = spark.createDataFrame([(str(k % 2), k, *map(float, b)) for k, b in enumerate(boxes)] + [("0", None, *map(float, boxes[0])), ("2", None, *map(float, boxes[0])), ("0", -1, None, 0.0, 1.0, 1.0)], "g string, id long, x0 double, y0 double, x1 double, y1 double")
    found = U.overlapping_pairs(rows, ["g"], ["x0", "y0", "x1", "y1"], 0.55, [(F.col("a_x0") + F.col("b_x0")).alias("sum")]).collect()
    got, want = {(r.g, r.a, r.b, r["sum"]) for r in found}, set()
    for g in (0, 1):
        own, ids = boxes[g::2], range(g, 3000, 2)
        for p in K.overlapping_parts(own, U.planar_overlap(own), 0.55):
            want |= {(str(g), ids[i], ids[j], own[i, 0] + own[j, 0]) for i, j in zip(*(x.tolist() for x in p), strict=True)}
    assert got == want and len(found) == len(got) > 500


def test_equal_boxes_of_a_group_are_compared_once(spark, monkeypatch):
    from terravane.operators import suppression as U

    monkeypatch.setattr(U, "PART", 7)
    kinds = [(0.0, 0.0, 10.0, 10.0), (1.0, 0.0, 10.0, 10.0), (0.0, 0.0, 0.0, 10.0), (50.0, 50.0, 60.0, 60.0)]
    rows = [(k % 2, (37 * k) % 120, *kinds[k % 8 // 2]) for k in range(120)] + [(0, 0, *kinds[1])]  # an id of two boxes
    table = spark.createDataFrame(rows, "g int, id long, x0 double, y0 double, x1 double, y1 double")
    got = U.overlapping_pairs(table, ["g"], ["x0", "y0", "x1", "y1"], 0.55, [F.lit(1).alias("one")]).collect()
    near = lambda p, q: p[0] == q[0] and p[1] < q[1] and p[4] > p[2] and (p[2:] == q[2:] or p[4] == q[4] == 10.0 and q[2] < q[4])
    want = sorted((p[1], q[1]) for p in rows for q in rows if near(p, q))
    assert sorted((r.a, r.b) for r in got) == want and len(want) > 1000
    pairs = U.overlapping_pairs(table, ["g"], ["x0", "y0", "x1", "y1"], 0.55, [F.monotonically_increasing_id().alias("pair")])
    assert pairs.select("g", "pair").distinct().count() == 2 * 4  # each of three boxes with itself, and two with each other


@pytest.mark.parametrize("delta", [0.2, 0.7])
def test_neighbourhoods_as_bits_give_what_sets_give(monkeypatch, delta):
    rng = np.random.default_rng(6)
    xyz, origins = rng.normal(0, 3, (150, 3)), rng.normal(0, 3, (150, 3))
    ray = (xyz - origins) / np.linalg.norm(xyz - origins, axis=1, keepdims=True)
    rows = (xyz, origins, ray, rng.integers(0, 9, 150), np.where(rng.random(150) < 0.5, np.nan, 1.0), 0.6, 4.0, (0.3, 30.0), delta)
    bits = K.cdog(*rows)
    monkeypatch.setattr(K, "BITS", 0)
    assert bits.tolist() == K.cdog(*rows).tolist() and 1 < len(set(bits.tolist())) < 150


def test_row_numbers_of_seven_digits_come_back(spark):
    f = T.thumbnail_file(F.lit("cap"), F.col("id"))
    rows = spark.range(999999, 1000002).select("id", f.alias("file"), T.thumbnail_index(f).alias("row")).collect()
    assert [r.row for r in rows] == [r.id for r in rows] and len({r.file for r in rows}) == 3


def test_points_on_the_ends_of_edges_as_in_sql(spark, tmp_path):
    import duckdb

    from terravane.plans import geometry

    rows = spark.range(90000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("c_mktsegment"))
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(geometry.ORACLE_SQL["points_in_polygon"]).fetchall()
    assert sorted(map(tuple, geometry.points_in_polygon(spark, str(tmp_path)).collect())) == sorted(want)


def test_text_codes_of_seven_digits_agree_with_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'Brand#' || (i % 25) AS p_brand FROM range(999990, 1000025) t(i)")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    columns = ["id", "file", "row", "keyframe", "face", "level", "labels", "key"]
    got = sorted(tuple(r[c] for c in columns) for r in entry.queries()["text_codes"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()['text_codes']})").fetchall())
