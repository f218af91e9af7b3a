"""Matching, curves, thresholds and partition metrics over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import annotations as A
from terravane.operators import evaluation as V
from terravane.operators import spatial as S
from terravane.plans import inputs as I

R = lambda c, n, name: F.round(c, n).alias(name)


def _targets(spark: SparkSession, sf_dir: str, stretch: float = 10.0) -> DataFrame:
    """Annotations with the radius in which a prediction is admissible: their accuracy, times a factor."""
    return I.points(spark, sf_dir).select("prompt", F.col("id").alias("target"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), (F.col("accuracy") * stretch).alias("radius"))


def admissible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction within the annotation's accuracy (times ten) of the prompt's annotations."""
    a = _targets(spark, sf_dir)
    p = S.within_accuracy(I.predictions(spark, sf_dir).select("prompt", F.col("id").alias("prediction"), "lat", "lng"), a, ["prompt"], F.col("radius"), 70.0, F.col("radius"))
    return p.select("prompt", "prediction", "target", R(F.col("distance"), 4, "distance"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.match_near(I.predictions(spark, sf_dir).where("score > 0.3").withColumnRenamed("id", "prediction"), _targets(spark, sf_dir), ["prompt"])


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("prompt", "prediction", "target", R(F.col("distance"), 4, "distance"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = V.score_ordered_near(I.predictions(spark, sf_dir), _targets(spark, sf_dir), ["prompt"])
    return V.curve(ranked, I.points(spark, sf_dir).groupBy("prompt").agg(F.count("*").alias("n_targets")), ["prompt"])


def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("prompt", R(F.col("threshold"), 4, "threshold"), "tp", "fp", "fn", R(F.col("f1"), 6, "f1"))


def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.average_precision(_curve(spark, sf_dir), ["prompt"])
    return a.select("prompt", R(F.col("average_precision"), 6, "average_precision"), R(F.col("best_f1"), 6, "best_f1"), R(F.col("best_threshold"), 4, "best_threshold"))


def leave_one_out_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.f1_table(_curve(spark, sf_dir), "prompt")
    return V.left_out(t, "prompt").select("prompt", R(F.col("threshold"), 4, "threshold"), R(F.col("others_f1"), 6, "others_f1"), R(F.col("held_out_f1"), 6, "held_out_f1"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free stand-in for a ranked list: hit by a rule on the id."""
    return I.predictions(spark, sf_dir).select("prompt", F.col("id").alias("prediction"), "score", (F.col("id") * 11 % 7 < 3).alias("hit"))


def curve_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    c = V.curve(h, h.groupBy("prompt").agg((F.count_if("hit") + 5).alias("n_targets")), ["prompt"])
    return c.select("prompt", R(F.col("threshold"), 4, "threshold"), "tp", "fp", "fn", R(F.col("precision"), 6, "precision"), R(F.col("recall"), 6, "recall"), R(F.col("f1"), 6, "f1"))


def average_precision_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    c = V.curve(h, h.groupBy("prompt").agg((F.count_if("hit") + 5).alias("n_targets")), ["prompt"])
    a = V.average_precision(c, ["prompt"])
    return a.select("prompt", R(F.col("average_precision"), 6, "average_precision"), R(F.col("best_f1"), 6, "best_f1"), R(F.col("best_threshold"), 4, "best_threshold"))


def shared_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    c = V.curve(h, h.groupBy("prompt").agg((F.count_if("hit") + 5).alias("n_targets")), ["prompt"])
    s = V.shared_threshold(V.f1_table(c, "prompt"))
    return s.select(R(F.col("threshold"), 4, "threshold"), R(F.col("macro_f1"), 6, "macro_f1"))


def accepted_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro precision, recall and f1 by class of accepted predictions."""
    h = _hits(spark, sf_dir)
    ok = V.accepted(h, 0.4).groupBy("prompt").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    rows = ok.join(h.groupBy("prompt").agg(F.count_if("hit").alias("all")), "prompt").select("prompt", "tp", "fp", (F.col("all") - F.col("tp") + 2).alias("fn"))
    p = V.prf(rows.withColumn("class_name", F.substring("prompt", 1, 1)).union(rows.withColumn("class_name", F.col("prompt"))), ["class_name"])
    return p.select("class_name", "tp", "fp", "fn", R(F.col("precision"), 6, "precision"), R(F.col("recall"), 6, "recall"), R(F.col("f1"), 6, "f1"))


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as outcomes by language: micro figures and means over those without error and with targets."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    r = d.groupBy("lang").agg(F.count_if((F.col("quality") == 1) & (F.col("n_chars") > 1000)).alias("tp"), F.count_if((F.col("quality") == 0) & (F.col("n_chars") > 1000)).alias("fp"), F.count_if((F.col("quality") == 1) & (F.col("n_chars") <= 1000)).alias("fn"))
    r = r.select("lang", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("n_targets"), F.when(F.col("lang") == "de", "timeout").alias("error"), (F.col("tp") / 1000.0).alias("average_precision"), (F.col("fp") / 1000.0).alias("best_f1"))
    s = V.summary(r)
    return s.select("tp", "fp", "fn", *[R(F.col(c), 6, c) for c in ("precision", "recall", "f1", "mean_ap", "mean_best_f1")], "n_errors")


def partition_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    r = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 13 - 1).alias("cluster_id"), F.when(F.col("label") != 4, F.col("label")).alias("truth"))
    m = V.partition_metrics(r, [])
    return m.select("n", *[R(F.col(c), 6, c) for c in ("pair_precision", "pair_recall", "pair_f1", "rand_index")])


def cue_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well closeness tells pairs of one label from others, map by map."""
    p = _cues(spark, sf_dir)
    return V.rank_auc(p.withColumn("near", -F.floor("distance")), ["geo_ref"], "near", F.col("same")).select("geo_ref", R(F.col("auc"), 6, "auc"), "n_positive", "n_negative")


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir).select("geo_ref", "id", "keyframe", "x", "y", "z")
    p = S.near_pairs(c, 4.0, ["geo_ref"]).join(c.select(F.col("id").alias("a"), F.col("keyframe").alias("ka")), "a").join(c.select(F.col("id").alias("b"), F.col("keyframe").alias("kb")), "b")
    return p.select("geo_ref", "distance", (F.col("ka") == F.col("kb")).alias("same"), F.when((F.col("a") + F.col("b")) % 5 != 0, F.round("distance", 4)).alias("cue"))


def cue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.cue_report(_cues(spark, sf_dir), ["geo_ref"], "cue", "same")
    q = lambda c, n: F.round(F.get(c, 2), 4).alias(n)
    return r.select("geo_ref", "n_same", "n_other", "unusable_same", "unusable_other", q("same_quantiles", "same_median"), q("other_quantiles", "other_median"))


def annotation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations grouped by single linkage within 25 m of prompt and class, with centres."""
    p = I.points(spark, sf_dir).withColumn("class_name", F.substring("class_name", 1, 1))
    g = S.clusters_within(p, ["prompt"], 25.0)
    c = A.group_centres(p.join(g, ["prompt", "id"]), ["prompt"], 25.0)
    return c.select("prompt", "group_id", R(F.col("lat"), 6, "lat"), R(F.col("lng"), 6, "lng"), "radius", "n")


def group_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against groups of annotations, by the least distance to a member."""
    p = I.points(spark, sf_dir)
    g = p.join(S.clusters_within(p, ["prompt"], 25.0), ["prompt", "id"])
    r = g.join(A.group_centres(g, ["prompt"], 25.0).select("prompt", "group_id", "radius"), ["prompt", "group_id"])
    r = r.select("prompt", "group_id", "radius", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    pairs = S.within_accuracy(I.predictions(spark, sf_dir).withColumnRenamed("id", "prediction"), r, ["prompt"], F.col("radius"), 25.0)
    return V.match(V.group_distances(pairs, ["prompt"]), ["prompt"]).select("prompt", "prediction", "target", R(F.col("distance"), 4, "distance"))


def outcome_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, a = I.predictions(spark, sf_dir).where("score > 0.3"), I.points(spark, sf_dir)
    f = A.outcome_features(p, a, _matches(spark, sf_dir))
    return f.select("kind", "id", A.as_feature(F.col("kind"), F.round("lng", 6), F.round("lat", 6), F.struct("id", "score")).alias("feature"))


QUERIES = {f.__name__: f for f in (admissible_pairs, matched_pairs, precision_recall_curve, mean_average_precision, leave_one_out_threshold, curve_of_hits, average_precision_of_hits, shared_threshold, accepted_by_class, benchmark_summary, partition_agreement, cue_auc, cue_report, annotation_groups, group_matches, outcome_geojson)}
_PAIR = f"""pairs AS (SELECT p.prompt, p.id AS prediction, a.id AS target, p.score, {I.haversine_sql('p.lat', 'p.lng', 'a.lat', 'a.lng')} AS d, a.accuracy * 10 AS radius FROM predictions p JOIN points a USING (prompt))"""
_HITS = "hits AS (SELECT prompt, id, score, id * 11 % 7 < 3 AS hit FROM predictions)"
_CURVE = """c0 AS (SELECT prompt, score, count(*) FILTER (hit) AS h, count(*) AS k FROM hits GROUP BY ALL),
    c1 AS (SELECT prompt, score AS threshold, sum(h) OVER w AS tp, sum(k) OVER w - sum(h) OVER w AS fp, sum(h) OVER (PARTITION BY prompt) + 5 - sum(h) OVER w AS fn FROM c0 WINDOW w AS (PARTITION BY prompt ORDER BY score DESC)),
    curve AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c1)"""
_TABLE = """t AS (SELECT p.prompt, th.threshold, coalesce((SELECT max_by(f1, -c.threshold) FROM curve c WHERE c.prompt = p.prompt AND c.threshold >= th.threshold), 0) AS f1
    FROM (SELECT DISTINCT prompt FROM curve) p, (SELECT DISTINCT threshold FROM curve) th)"""
ORACLE_SQL = {
    "admissible_pairs": f"WITH {I.POINTS}, {I.PREDICTIONS}, {_PAIR} SELECT prompt, prediction, target, round(d, 4) AS distance FROM pairs WHERE d <= radius",
    "curve_of_hits": f"""WITH {I.PREDICTIONS}, {_HITS}, {_CURVE} SELECT prompt, round(threshold, 4) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM curve""",
    "average_precision_of_hits": f"""WITH {I.PREDICTIONS}, {_HITS}, {_CURVE}, i AS (SELECT *, r - coalesce(lag(r) OVER w, 0) AS step, max(p) OVER (PARTITION BY prompt ORDER BY threshold DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM curve WINDOW w AS (PARTITION BY prompt ORDER BY threshold DESC))
        SELECT prompt, round(sum(step * best), 6)::DOUBLE AS average_precision, round(max(f1), 6)::DOUBLE AS best_f1, round(max(row(f1, threshold))[2], 4) AS best_threshold FROM i GROUP BY prompt""",
    "shared_threshold": f"WITH {I.PREDICTIONS}, {_HITS}, {_CURVE}, {_TABLE}, m AS (SELECT threshold, avg(f1) AS f FROM t GROUP BY threshold) SELECT round(threshold, 4) AS threshold, round(f, 6) AS macro_f1 FROM m ORDER BY round(f, 9) DESC, m.threshold DESC LIMIT 1",
    "accepted_by_class": f"""WITH {I.PREDICTIONS}, {_HITS}, r AS (SELECT prompt, count(*) FILTER (hit AND score > 0.4) AS tp, count(*) FILTER (NOT hit AND score > 0.4) AS fp, count(*) FILTER (hit) - count(*) FILTER (hit AND score > 0.4) + 2 AS fn FROM hits GROUP BY prompt),
        s AS (SELECT c AS class_name, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (SELECT *, 'p' AS c FROM r UNION ALL SELECT *, prompt FROM r) GROUP BY c)
        SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""",
    "benchmark_summary": """WITH r AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang)
        SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / sum(tp + fp), 6) AS precision, round(sum(tp) / sum(tp + fn), 6) AS recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS f1,
               round(avg(tp / 1000) FILTER (lang <> 'de' AND tp + fn > 0), 6) AS mean_ap, round(avg(fp / 1000) FILTER (lang <> 'de' AND tp + fn > 0), 6) AS mean_best_f1, count(*) FILTER (lang = 'de') AS n_errors FROM r""",
    "partition_agreement": """WITH r AS (SELECT CASE WHEN vec_id % 13 >= 1 THEN 'c' || (vec_id % 13) ELSE 'n' || vec_id END AS c, label AS t, vec_id FROM embeddings WHERE label <> 4),
        p AS (SELECT count(*) AS pairs, count(*) FILTER (a.c = b.c AND a.t = b.t) AS same, count(*) FILTER (a.c = b.c) AS tog, count(*) FILTER (a.t = b.t) AS alike FROM r a JOIN r b ON a.vec_id < b.vec_id)
        SELECT (SELECT count(*) FROM r) AS n, round(same / tog, 6) AS pair_precision, round(same / alike, 6) AS pair_recall, round(2 * same / (tog + alike), 6) AS pair_f1, round((pairs + 2 * same - tog - alike) / pairs, 6) AS rand_index FROM p""",
    "cue_auc": f"""WITH {I.CANDIDATES}, p AS (SELECT a.geo_ref, -floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS s, a.keyframe = b.keyframe AS same FROM candidates a JOIN candidates b ON a.geo_ref = b.geo_ref AND a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 4),
        n AS (SELECT geo_ref, s, count(*) FILTER (same) AS y, count(*) FILTER (NOT same) AS z FROM p GROUP BY ALL)
        SELECT a.geo_ref, round(sum(a.y * b.z * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END)::DOUBLE / (any_value(t.y) * any_value(t.z)), 6) AS auc, any_value(t.y)::BIGINT AS n_positive, any_value(t.z)::BIGINT AS n_negative
        FROM n a JOIN n b USING (geo_ref) JOIN (SELECT geo_ref, sum(y) AS y, sum(z) AS z FROM n GROUP BY 1) t USING (geo_ref) GROUP BY a.geo_ref""",
    "cue_report": f"""WITH {I.CANDIDATES}, p AS (SELECT a.geo_ref, a.id + b.id AS k, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d, a.keyframe = b.keyframe AS same FROM candidates a JOIN candidates b ON a.geo_ref = b.geo_ref AND a.id < b.id)
        SELECT geo_ref, count(*) FILTER (same) AS n_same, count(*) FILTER (NOT same) AS n_other, count(*) FILTER (same AND k % 5 = 0) AS unusable_same, count(*) FILTER (NOT same AND k % 5 = 0) AS unusable_other,
               round(quantile_cont(round(d, 4), 0.5) FILTER (same AND k % 5 <> 0), 4) AS same_median, round(quantile_cont(round(d, 4), 0.5) FILTER (NOT same AND k % 5 <> 0), 4) AS other_median FROM p WHERE d <= 4 GROUP BY geo_ref""",
}
