"""Association of candidates into places, its statistics, sweeps and refinements over `embeddings`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import association as A
from terravane.operators import kernels as K
from terravane.operators import spatial as S
from terravane.params import LocalizationParams
from terravane.plans import inputs as I

R = lambda c, n, name: F.round(c, n).alias(name)
BY = ["geo_ref"]

def bands():
    """Three stand-in levels."""
    return F.array(*[F.struct(F.lit(v).alias("value"), F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high")) for v, a, b in ((-1, None, -0.4), (0, -0.4, 0.4), (1, 0.4, None))])


def _associated(spark: SparkSession, sf_dir: str, params: LocalizationParams) -> DataFrame:
    return A.associate(I.detections(spark, sf_dir), BY, params)


def leader_canopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir, LocalizationParams(eps_m=3.0))


def gated_leader_canopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir, LocalizationParams(eps_m=5.0, semantic_gate=0.2))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir, LocalizationParams(association="incremental", eps_m=4.0, sim_threshold=0.9))


def conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir, LocalizationParams(association="incremental", combination="conjunctive", descriptor="seed", eps_m=4.0, semantic_gate=0.0))


def cdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir, LocalizationParams(association="cdog", epipolar_m=1.5, pair_radius_m=6.0, delta=0.2))


def multicut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir, LocalizationParams(association="multicut", geo_pivot=2.5))


def semantic_multicut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir, LocalizationParams(association="multicut", geo_pivot=2.5, sem_weight=0.5, sem_pivot=0.1, geo_source="ray"))


def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage with a semantic gate, map by map."""
    d = I.candidates(spark, sf_dir).where("placed").select("geo_ref", "id", "x", "y", "z", F.col("level").cast("double").alias("level"), "embedding")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id", kind="stable")
        label = K.single_linkage(df[["x", "y", "z"]].to_numpy(float), df["level"].to_numpy(float), 2.0, np.vstack(df["embedding"].tolist()), 0.0)
        return df[["geo_ref", "id"]].assign(cluster_id=label)

    return d.groupBy("geo_ref").applyInPandas(run, "geo_ref long, id long, cluster_id long")


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in clusters that a rule on the id makes, so that SQL can say the same."""
    d = I.detections(spark, sf_dir).where("position IS NOT NULL AND similarity > 0.3")
    return d.withColumn("cluster_id", (F.col("id") % 23 - 1).cast("long"))


def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.cluster_statistics(_clustered(spark, sf_dir), BY, LocalizationParams(), bands(), (F.lit(48.8566), F.lit(2.3522), F.lit(35.0)))
    return s.select("geo_ref", "cluster_id", *[R(F.col(c), 5, c) for c in ("x", "y", "z", "spread", "confidence")], "n", "level", R(F.col("lat"), 6, "lat"), R(F.col("lng"), 6, "lng"), R(F.col("alt"), 3, "alt"))


def plain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.with_geometry(A.cluster_statistics(_clustered(spark, sf_dir), BY, LocalizationParams()), 4, 5.0)
    return s.select("geo_ref", "cluster_id", *[R(F.col(c), 5, c) for c in ("x", "y", "z", "spread", "confidence")], "n", "level")


def median_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.cluster_statistics(_clustered(spark, sf_dir), BY, LocalizationParams(level_strategy="median"))
    return s.select("geo_ref", "cluster_id", "level")


def ray_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.ray_centroids(_clustered(spark, sf_dir).where("cluster_id >= 0"), BY)
    return r.select("geo_ref", "cluster_id", *[R(F.col(f"ray.{c}"), 4, c) for c in "xyz"])


def localized_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole query: candidates to ranked places with their observations."""
    p = LocalizationParams(eps_m=3.0, min_similarity=0.2, num_results=15, max_observations=3, alpha=0.1)
    r = A.localize(I.detections(spark, sf_dir), BY, p, bands(), (F.lit(48.8566), F.lit(2.3522), F.lit(35.0)))
    return r.select("geo_ref", "cluster_id", "rank", "n", R(F.col("match_score"), 6, "match_score"), R(F.col("lat"), 6, "lat"), R(F.col("lng"), 6, "lng"), "level", F.array_join("keyframe_ids", ",").alias("keyframes"), F.to_json("observations").alias("observations"))


def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings against maps in one job: clusters, noise, and agreement with labels as truth."""
    from terravane.operators import evaluation as V

    base = LocalizationParams(min_keyframes=1)
    grid = {"eps1": base.with_(eps_m=1.0), "eps3": base.with_(eps_m=3.0), "cut": base.with_(association="multicut", geo_pivot=2.0)}
    d = I.detections(spark, sf_dir)
    s = A.sweep(d, BY, grid).join(d.select("geo_ref", "id", F.col("keyframe").alias("truth")), ["geo_ref", "id"])
    m = V.partition_metrics(s, ["config"], within=("geo_ref",))  # each map numbers its clusters from 0
    return m.select("config", "n", *[R(F.col(c), 6, c) for c in ("pair_precision", "pair_recall", "pair_f1", "rand_index")])


def visual_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each map, split where their vectors fall apart; each row's cosine with its part's medoid."""
    c = I.candidates(spark, sf_dir).select("geo_ref", F.col("keyframe").cast("long").alias("cluster_id"), "id", "embedding")
    r = A.refine_by_vectors(c, ["geo_ref"], 0.22, min_cluster=5, min_component=3)
    return r.select("geo_ref", "id", "cluster_id", R(F.col("score"), 5, "score"))


def geometric_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir).select("geo_ref", "keyframe", "x", "y", "z")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        at = np.round(K.geometric_median(df[["x", "y", "z"]].to_numpy(float)), 3)
        return pd.DataFrame({"geo_ref": [df["geo_ref"].iloc[0]], "keyframe": [df["keyframe"].iloc[0]], "x": [at[0]], "y": [at[1]], "z": [at[2]]})

    return c.groupBy("geo_ref", "keyframe").applyInPandas(run, "geo_ref long, keyframe int, x double, y double, z double")


def reading_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: readings of one key that lie within 4 m of each other; members of clusters with anchors go to the nearest, if it is clearly nearest."""
    from terravane.operators import suppression as U

    c = I.candidates(spark, sf_dir).where("placed").select("geo_ref", "id", "x", "y", "z", F.when(F.col("id") % 6 == 0, (F.col("keyframe") % 4).cast("string")).alias("key"))
    anchors = c.where("key IS NOT NULL")
    flat = anchors.select("geo_ref", "key", "id", "x", "y", "z")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id", kind="stable").reset_index(drop=True)
        i, j = K.near_pairs(df[["x", "y", "z"]].to_numpy(float), 4.0)
        own = K.components(len(df), i, j)
        return df[["geo_ref", "key", "id"]].assign(anchor=df["id"].to_numpy()[own])

    group = flat.groupBy("geo_ref", "key").applyInPandas(run, "geo_ref long, key string, id long, anchor long").join(flat.select("id", "x", "y", "z"), "id")
    centre = group.groupBy("geo_ref", "anchor").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n")).where("n >= 2")
    both = c.where("key IS NULL").select("geo_ref", F.col("id"), "x", "y", "z").unionByName(centre.select("geo_ref", (-F.col("anchor") - 1).alias("id"), "x", "y", "z"))
    pairs = S.near_pairs(both, 6.0, ["geo_ref"]).where("a < 0 AND b >= 0").select(F.col("b").alias("id"), (-F.col("a") - 1).alias("anchor"), "distance")
    return U.nearest_anchor(pairs, ["id"], "distance", "anchor", 0.5).select("id", "anchor", R(F.col("distance"), 4, "distance"))


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components of the vectors; signs are fixed by the first row's."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e).select("id", vector_to_array("p").alias("p"))
    first = out.where("id = 0").select(F.get("p", 0).alias("a"), F.get("p", 1).alias("b"))
    return out.join(F.broadcast(first)).select("id", R(F.get("p", 0) * F.signum("a"), 4, "first"), R(F.get("p", 1) * F.signum("b"), 4, "second"))


QUERIES = {f.__name__: f for f in (leader_canopy, gated_leader_canopy, incremental, conjunctive, cdog, multicut, semantic_multicut, single_linkage, cluster_statistics, plain_statistics, median_levels, ray_centroids, localized_places, parameter_sweep, visual_refinement, geometric_medians, reading_refinement, principal_components)}
_CL = f"""{I.CANDIDATES}, q AS (SELECT embedding AS v FROM candidates WHERE id = 0), cl AS (
    SELECT geo_ref, id, keyframe, level, x, y, z, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) + 0.5 AS s, id % 23 - 1 AS cluster_id FROM candidates, q WHERE placed AND id % 23 >= 1 AND list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) + 0.5 > 0.3)"""
ORACLE_SQL = {
    "plain_statistics": f"""WITH {_CL}, g AS (SELECT geo_ref, cluster_id, sum(s * x) / sum(s) AS x, sum(s * y) / sum(s) AS y, sum(s * z) / sum(s) AS z, count(*) AS n, (stddev_pop(x) + stddev_pop(y) + stddev_pop(z)) / 3 AS spread, max(row(s, -id, level))[3] AS level FROM cl c GROUP BY geo_ref, cluster_id)
        SELECT geo_ref, cluster_id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, round(spread, 5) AS spread, round(least(1.0, n / 5) * (0.5 + 0.5 * greatest(0.0, 1 - spread / 2)), 5) AS confidence, n, level FROM g WHERE n >= 4 AND spread <= 5""",
    "median_levels": f"""WITH {_CL}, v AS (SELECT geo_ref, cluster_id, keyframe, coalesce(min(row(id, level))[2], -9999) AS l FROM cl GROUP BY ALL), m AS (SELECT geo_ref, cluster_id, list_sort(list(l)) AS l FROM v GROUP BY ALL)
        SELECT geo_ref, cluster_id, nullif(l[(len(l) - 1) // 2 + 1], -9999) AS level FROM m""",
}
