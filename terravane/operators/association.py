"""Association of detections into clusters, one group per query (and map), and what is computed of the clusters.

Columns of a detection: id, keyframe, similarity, position (struct x, y, z), origin (the camera's position, same struct),
level (int, null if unresolved), and embedding where the parameters need it. The kernels see one query's rows, which the parameters bound
(candidate_count is at most 5,000); queries and parameter settings run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import geodesy as G
from terravane.functions import metrics as M
from terravane.operators import kernels as K
from terravane.params import LocalizationParams


def _columns(df: pd.DataFrame):
    xyz = df[["x", "y", "z"]].to_numpy(float)
    origin = df[["ox", "oy", "oz"]].to_numpy(float)
    ray = xyz - origin
    length = np.linalg.norm(ray, axis=1, keepdims=True)
    vectors = np.vstack(df["embedding"].tolist()) if "embedding" in df and df["embedding"].notna().all() and len(df) else None
    return xyz, origin, ray / np.where(length > 0, length, 1.0), length[:, 0] > 0, df["level"].to_numpy(float), vectors


def label_rows(df: pd.DataFrame, p: LocalizationParams) -> np.ndarray:
    """Cluster of each row, -1 for noise; rows without a direction take no part where rays decide."""
    xyz, origin, ray, seen, level, vectors = _columns(df)
    sim, keyframe = df["similarity"].to_numpy(float), df["keyframe"].to_numpy()
    if p.association == "leader_canopy":
        out = K.leader_canopy(xyz, sim, level, p.eps_m, vectors, p.semantic_gate)
    elif p.association == "incremental":
        out = K.incremental(xyz, sim, level, vectors, p.eps_m, p.combination, p.sim_threshold, p.semantic_gate, p.descriptor)
    else:
        use = seen if p.association == "cdog" or p.geo_source == "ray" else np.ones(len(df), bool)
        own = None if vectors is None else vectors[use]
        if p.association == "cdog":
            part = K.cdog(xyz[use], origin[use], ray[use], keyframe[use], level[use], p.epipolar_m, p.pair_radius_m, p.range_m, p.delta, own, p.cdog_semantic)
        else:
            part = K.multicut(xyz[use], origin[use], ray[use], level[use], p.multicut_radius_m, p.geo_weight, p.geo_pivot, p.sem_weight, p.sem_pivot, p.geo_source, p.range_m, own)
        out = np.full(len(df), -1, np.int64)
        out[use] = part
    return K.with_support(out, keyframe, p.min_keyframes)


def associate(detections: DataFrame, by: list[str], params: LocalizationParams) -> DataFrame:
    """by, id and cluster_id of every detection with a position; -1 is noise."""
    keys = [f.name for f in detections.schema.fields if f.name in by]
    flat = detections.where("position IS NOT NULL").select(
        *by, "id", "keyframe", F.col("similarity").cast("double").alias("similarity"), F.col("level").cast("double").alias("level"),
        *[F.col(f"position.{c}").alias(c) for c in "xyz"], *[F.col(f"origin.{c}").alias(f"o{c}") for c in "xyz"], *(["embedding"] if params.needs_embeddings else []),
    )
    schema = ", ".join([*(f"{k} {detections.schema[k].dataType.simpleString()}" for k in keys), "id long", "cluster_id long"])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id", kind="stable").reset_index(drop=True)
        return df[[*keys, "id"]].assign(cluster_id=label_rows(df, params))

    return flat.groupBy(*by).applyInPandas(run, schema)


def sweep(detections: DataFrame, by: list[str], grid: dict[str, LocalizationParams]) -> DataFrame:
    """config, by, id, cluster_id for each setting of a grid: detections are read once and meet every setting."""
    names = list(grid)
    needed = any(p.needs_embeddings for p in grid.values())
    every = detections.withColumn("config", F.explode(F.array(*[F.lit(n) for n in names])))
    if not needed and "embedding" in every.columns:
        every = every.drop("embedding")
    flat = every.where("position IS NOT NULL").select(
        "config", *by, "id", "keyframe", F.col("similarity").cast("double").alias("similarity"), F.col("level").cast("double").alias("level"),
        *[F.col(f"position.{c}").alias(c) for c in "xyz"], *[F.col(f"origin.{c}").alias(f"o{c}") for c in "xyz"], *(["embedding"] if needed else []),
    )
    schema = ", ".join(["config string", *(f"{k} {detections.schema[k].dataType.simpleString()}" for k in by), "id long", "cluster_id long"])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id", kind="stable").reset_index(drop=True)
        return df[["config", *by, "id"]].assign(cluster_id=label_rows(df, grid[df["config"].iloc[0]]))

    return flat.groupBy("config", *by).applyInPandas(run, schema)


def supported(clustered: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of clusters that at least `least` keyframes saw, the clusters of a query numbered anew from 0; the others become -1."""
    n = clustered.where("cluster_id >= 0").groupBy(*by, "cluster_id").agg(F.count_distinct("keyframe").alias("__n")).where(F.col("__n") >= least)
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    new = n.withColumn("__new", F.dense_rank().over(w.orderBy("cluster_id")) - 1).drop("__n")
    return clustered.join(new, [*by, "cluster_id"], "left").withColumn("cluster_id", F.coalesce("__new", F.lit(-1)).cast("long")).drop("__new")


def _seed_level() -> Column:
    return F.max_by("level", F.struct(F.col("similarity"), -F.col("id")))


def cluster_statistics(clustered: DataFrame, by: list[str], params: LocalizationParams, bands: Column | None = None, origin: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """One row per cluster: x, y, z, n, spread, confidence, level and, with an origin (lat, lng, alt), lat, lng, alt.

    The centroid is weighted by similarity (by a zero sum it is null); with centroid_from "rays" it is the point nearest
    to all rays where they determine one. The level is the best detection's, or the lower median of one vote per keyframe, unresolved ones (below all) included.
    The centroid's height is held within the level's band before it is placed on the globe; an unresolved level is then taken from its
    height, except by the median strategy.
    """
    c = clustered.where("cluster_id >= 0")
    weight = F.sum("similarity")
    at = [(F.sum(F.col("similarity") * F.col(f"position.{k}")) / F.when(weight != 0, weight)).alias(k) for k in "xyz"]
    spread = sum((F.stddev_pop(f"position.{k}") for k in "xyz"), F.lit(0.0)) / 3
    out = c.groupBy(*by, "cluster_id").agg(*at, F.count("*").alias("n"), spread.alias("spread"), _seed_level().alias("level"), F.max("similarity").alias("similarity"))
    if params.level_strategy == "median":
        votes = c.groupBy(*by, "cluster_id", "keyframe").agg(F.min_by("level", "id").alias("v"))
        sorted_ = F.array_sort(F.collect_list(F.coalesce("v", F.lit(-9999))))
        middle = votes.groupBy(*by, "cluster_id").agg(sorted_.alias("v")).select(*by, "cluster_id", F.element_at("v", F.floor((F.size("v") - 1) / 2).cast("int") + 1).alias("m"))
        out = out.drop("level").join(middle, [*by, "cluster_id"]).withColumn("level", F.when(F.col("m") != -9999, F.col("m"))).drop("m")
    if params.centroid_from == "rays":
        out = out.join(ray_centroids(c, by), [*by, "cluster_id"], "left")
        for k in "xyz":
            out = out.withColumn(k, F.coalesce(F.col(f"ray.{k}"), F.col(k)))
        out = out.drop("ray")
    if bands is not None:
        own = F.get(F.filter(bands, lambda b: b["value"].cast("int") == F.col("level")), 0)
        out = out.withColumn("__band", own)
        y = F.when(F.col("__band.low").isNotNull(), F.greatest("y", "__band.low")).otherwise(F.col("y"))
        y = F.when(F.col("__band.high").isNotNull(), F.least(y, F.col("__band.high"))).otherwise(y)
        out = out.withColumn("y", y).drop("__band")
        if params.level_strategy != "median":
            out = out.withColumn("level", F.coalesce("level", G.level_of_height(F.col("y"), bands).cast("int")))
    if origin is not None:
        out = out.withColumn("__g", G.eus_to_geodetic(*origin, G.xyz(F.col("x"), F.col("y"), F.col("z"))))
        out = out.withColumn("lat", F.col("__g.lat")).withColumn("lng", F.col("__g.lng")).withColumn("alt", F.col("__g.alt")).drop("__g")
    return out.withColumn("confidence", M.confidence(F.col("n"), F.col("spread")))


def ray_centroids(clustered: DataFrame, by: list[str]) -> DataFrame:
    """by, cluster_id, ray: the least-squares meeting point of a cluster's rays; null where their system is ill-conditioned."""
    flat = clustered.select(*by, "cluster_id", *[F.col(f"position.{c}").alias(c) for c in "xyz"], *[F.col(f"origin.{c}").alias(f"o{c}") for c in "xyz"])
    keys = [*by, "cluster_id"]
    schema = ", ".join([*(f"{k} {clustered.schema[k].dataType.simpleString()}" for k in keys), "x double, y double, z double"])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ray = df[["x", "y", "z"]].to_numpy(float) - df[["ox", "oy", "oz"]].to_numpy(float)
        length = np.linalg.norm(ray, axis=1, keepdims=True)
        at = K.ray_centroid(df[["ox", "oy", "oz"]].to_numpy(float), ray / np.where(length > 0, length, 1.0))
        row = {k: [df[k].iloc[0]] for k in keys} | {c: [None if at is None else float(at[i])] for i, c in enumerate("xyz")}
        return pd.DataFrame(row).astype({c: float for c in "xyz"})

    out = flat.groupBy(*keys).applyInPandas(run, schema)
    none = F.isnan("x") | F.col("x").isNull()
    return out.select(*keys, F.when(~none, G.xyz(F.col("x"), F.col("y"), F.col("z"))).alias("ray"))


def with_geometry(stats: DataFrame, least: int = 1, most_spread: float | None = None) -> DataFrame:
    """Clusters with enough observations and a spread that is small enough; before they are ranked."""
    out = stats.where(F.col("n") >= least)
    return out if most_spread is None else out.where(F.col("spread") <= most_spread)


def observations(clustered: DataFrame, by: list[str], most: int) -> DataFrame:
    """The `most` best observations of each cluster by raw similarity, with their place."""
    w = Window.partitionBy(*by, "cluster_id").orderBy(F.desc("similarity"), F.asc("id"))
    return clustered.where("cluster_id >= 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def keyframe_sets(clustered: DataFrame, by: list[str]) -> DataFrame:
    """Each cluster's keyframes as text, in text order."""
    return clustered.where("cluster_id >= 0").groupBy(*by, "cluster_id").agg(F.array_sort(F.collect_set(F.col("keyframe").cast("string"))).alias("keyframe_ids"))


#: Columns of a detection that an observation of the answer carries where they are there.
SHOWN = ("position", "theta", "phi", "width", "height", "depth", "thumbnail", "level", "positive", "negative")


def localize(
    detections: DataFrame, by: list[str], params: LocalizationParams, bands: Column | None = None, origin: tuple[Column, Column, Column] | None = None
) -> DataFrame:
    """The whole query: best candidates, association, statistics, filters, floor, ratio, rank, and nested observations.

    With a gain, score is the boosted similarity (columns positive and negative, normalised over the query's candidates as the
    parameters say); everything but the score goes by the raw one. An observation has object_id, keyframe_id, similarity_score,
    boosted_score and what the detections have of SHOWN.
    """
    from terravane.operators import enrichment as E
    from terravane.operators import ranking as R

    top = R.top_candidates(detections, params.candidate_count, by)
    boost = params.alpha or params.beta
    if boost:
        top = E.normalised_scores(top, by, ["positive", "negative"], params.feedback_normalization)
    score = M.boosted(F.col("similarity"), F.col("positive"), F.col("negative"), params.alpha, params.beta) if boost else F.col("similarity")
    clustered = top.join(associate(top, by, params), [*by, "id"])
    stats = with_geometry(cluster_statistics(clustered, by, params, bands, origin), params.min_observations, params.max_spread_m).drop("similarity")
    # best score, keyframes and observations from one aggregate
    shown = [F.col(c) for c in SHOWN if c in detections.columns]
    keyframe = F.col("keyframe").cast("string")
    one = F.struct(
        (-F.col("similarity")).alias("order"), F.col("id").alias("object_id"), keyframe.alias("keyframe_id"), F.col("similarity").alias("similarity_score"),
        score.alias("boosted_score"), *shown,
    )
    cluster = clustered.where("cluster_id >= 0").groupBy(*by, "cluster_id").agg(
        F.max(score).alias("similarity"), F.array_sort(F.collect_set(keyframe)).alias("keyframe_ids"),
        F.transform(F.slice(F.array_sort(F.collect_list(one)), 1, params.max_observations), lambda o: o.dropFields("order")).alias("observations"),
    )
    return R.rank_clusters(stats.join(cluster, [*by, "cluster_id"]), by, params.min_similarity, params.num_results)


def refine_by_vectors(
    clustered: DataFrame, by: list[str], threshold: float, min_cluster: int = 3, min_component: int = 2
) -> DataFrame:
    """by, id, cluster_id and score of each row of clusters (cluster_id >= 0, embedding): clusters split where their vectors fall apart.

    A cluster's parts are the components of rows whose cosine reaches the threshold. Clusters of fewer than min_cluster rows, of one
    part, or without a part of min_component rows stay as they are. Of other ones the first part of that many rows keeps the
    number, further ones get numbers after the largest of the group (in the order of the clusters, then of the parts), and
    smaller parts become noise (-1). The score is the cosine with the part's medoid, null for noise. One group is one query or map.
    """
    keys = ", ".join(f"{k} {clustered.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{keys}, id {clustered.schema['id'].dataType.simpleString()}, cluster_id long, score double"

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id", kind="stable").reset_index(drop=True)
        old = df["cluster_id"].to_numpy(np.int64)
        new, score, following = old.copy(), np.full(len(df), np.nan), int(old.max()) + 1
        for k in np.unique(old[old >= 0]):
            rows = np.flatnonzero(old == k)
            vectors = np.vstack(df["embedding"].iloc[rows].tolist())
            part = K.similar_components(vectors, threshold)
            large = [p for p in np.unique(part) if (part == p).sum() >= min_component]
            if len(rows) < min_cluster or part.max() == 0 or not large:
                score[rows] = K.medoid(vectors)[1]
                continue
            new[rows] = -1
            for n, p in enumerate(large):
                own = np.flatnonzero(part == p)
                new[rows[own]] = k if n == 0 else following
                following += n > 0
                score[rows[own]] = K.medoid(vectors[own])[1]
        return df[[*by, "id"]].assign(cluster_id=new, score=score)

    return clustered.select(*by, "id", F.col("cluster_id").cast("long").alias("cluster_id"), "embedding").groupBy(*by).applyInPandas(run, schema)
